import random

import pytest


@pytest.mark.parametrize("window", [1, 3, 8, 9, 17, 40, 400])
@pytest.mark.parametrize("table", [1, 1 << 22])
def test_suffixes_sorted_without_an_order_by_key(monkeypatch, window, table):
    """The suffix array is that of the strings, and a batch that fits takes no argsort."""
    from plumbline.llm import suffix_index

    r = random.Random(window)
    parts = [b"", b"a" * 450, b"ab c" * 150, bytes(range(256)) * 3, b"\0" * 410, b"z" * (window - 1)]
    parts += [bytes(r.choice(b"abc \xff\0") for _ in range(r.randint(0, 600))) for _ in range(5)]
    parts += [parts[-1][:-1] + b"!", parts[-2]]
    monkeypatch.setattr(suffix_index, "TABLE", table, raising=False)
    monkeypatch.setattr(suffix_index.np, "argsort", lambda *_: pytest.fail("sorted by key"))
    level = suffix_index.Level(parts, list(range(len(parts))), window)
    text = b"".join(parts)
    strings = [text[a : a + window] for a in level.at.tolist()]
    assert strings == [p[k : k + window] for p in parts for k in range(len(p) - window + 1)]
    number = {s: k for k, s in enumerate(sorted(set(strings)))}
    assert level.rank.tolist() == [number[s] for s in strings]
    assert [level.rank[k] for k in level.order.tolist()] == sorted(level.rank.tolist())
    assert level.hit.tolist() == [strings.count(s) > 1 for s in strings]
