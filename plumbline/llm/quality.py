"""Quality rules by repetition coverage: the share of a text's word characters inside repeated n-grams and lines.

For each n-gram length every word that a repeated n-gram covers is found by rolling hashes of many documents at
once.  The verdict counts what the second and later occurrences cover, as published practice for web text does
whose limits it takes (duplicate n-gram and duplicate line shares): one line that a page says twice is no fault.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm.common import grams, mix, slabs, small_batches, word_hashes, words

MIN_WORDS, BASE_N, BASE_PERCENT = 10, 5, 20
#: n-gram length -> largest share of word characters inside n-grams seen before; and inside the most frequent n-gram.
GRAM_LIMITS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
TOP_LIMITS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share of word characters inside lines seen before, and of lines seen before.
LINE_LIMIT, LINES_LIMIT = 0.20, 0.30

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _sums(flags: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def repeated(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the words that an n-gram found twice or more in their own document covers, and of those that its
    second or a later occurrence covers."""
    at, _, later = _sorted_grams(h, first, n)
    twice = later.copy()
    twice[:-1] |= later[1:]
    return _covered(at[twice], n, len(h)), _covered(at[later], n, len(h))


def top(h: np.ndarray, first: np.ndarray, n: int, chars: np.ndarray) -> np.ndarray:
    """Flags of the words that the most frequent n-gram of their document covers, if it is found twice or more;
    of n-grams equally frequent the one of most characters counts."""
    at, doc, later = _sorted_grams(h, first, n)
    begin = np.flatnonzero(~later)
    times = np.diff(np.append(begin, len(at)))
    total = np.concatenate([[0], np.cumsum(chars, dtype=np.int64)])
    many = np.flatnonzero(times > 1)
    of, a = doc[begin[many]], at[begin[many]]
    order = np.lexsort((total[a + n] - total[a], times[many], of))
    last = np.ones(len(order), bool)
    last[:-1] = of[order][1:] != of[order][:-1]
    chosen = np.zeros(len(begin), bool)
    chosen[many[order[last]]] = True
    return _covered(at[np.repeat(chosen, times)], n, len(h))


def _sorted_grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word and document of all n-grams, equal ones of a document together and in order, and flags of those
    that follow an equal one."""
    g = grams(h, n)
    windows = np.maximum(np.diff(first) - n + 1, 0)
    total = int(windows.sum())
    doc = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(total) - np.repeat(np.cumsum(windows) - windows, windows) + np.repeat(first[:-1], windows)
    key = mix(g[at] ^ (doc.astype(np.uint64) * _SALT))
    order = np.argsort(key, kind="stable")
    key = key[order]
    later = np.zeros(total, bool)
    later[1:] = key[1:] == key[:-1]
    return at[order], doc[order], later


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    edge = np.zeros(size + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + n, -1)
    return np.cumsum(edge)[:size] > 0


def measures(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """All measures of the documents of a slab, as columns."""
    s, e, first = words(raw, offsets)
    h = word_hashes(raw, s, e)
    points = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80, dtype=np.int64)])
    chars = points[e] - points[s]
    n_words = np.diff(first)
    word_chars = _sums(chars, first)
    five, again = repeated(h, first, BASE_N)
    n_repeat = _sums(five, first)
    whole = np.maximum(word_chars, 1)
    gram_share, top_share, worst = np.zeros(len(n_words)), np.zeros(len(n_words)), np.zeros(len(n_words), bool)
    for n, limit in GRAM_LIMITS.items():
        share = _sums(chars * (again if n == BASE_N else repeated(h, first, n)[1]), first) / whole
        worst |= share > limit
        gram_share = np.maximum(gram_share, share)
    for n, limit in TOP_LIMITS.items():
        share = _sums(chars * top(h, first, n, chars), first) / whole
        worst |= share > limit
        top_share = np.maximum(top_share, share)
    lines, all_lines, line_chars = [], [], []
    data = raw.tobytes()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        seen, n, c = set(), 0, 0
        for line in data[a:b].split(b"\n"):
            if line in seen:
                n += 1
                c += sum(map(len, (w.decode() for w in line.split())))
            elif line.strip():
                seen.add(line)
        lines.append(n)
        all_lines.append(n + len(seen))
        line_chars.append(c)
    line_share = np.array(line_chars, np.int64) / whole
    worst |= (line_share > LINE_LIMIT) | (np.array(lines, np.int64) > LINES_LIMIT * np.array(all_lines, np.int64))
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > BASE_PERCENT * n_words)
    return {
        "n_words": n_words.astype(np.int64), "word_chars": word_chars, "n_symbols": _sums(_SYMBOL[raw], offsets), "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": n_repeat, "base_failed": failed, "kept": ~failed & ~worst, "gram_share": gram_share, "top_share": top_share, "line_share": line_share,
    }


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, gram_share double, top_share double, line_share double"


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, measures, kept, coverage) for each row of docs, repeated rows included; null and empty texts have no words
    and fail.  The coverage figures are the largest shares of word characters inside n-grams seen before, inside the most
    frequent n-gram, and inside lines seen before.  Of n-grams equally frequent the one of most characters counts.  A very
    long text is measured whole in one task; further columns play no part."""
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(1)):
                found = measures(raw, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *map(pa.array, found.values())], names=["doc_id", *found])

    return small_batches(docs).select(id_col, text_col).mapInArrow(work, f"doc_id {kind}, {SCHEMA}")


def keep(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are whatever their names, whose text passes the rules; a null or empty text does
    not, repeated rows pass or fail alike."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text_col))
            flags = [measures(raw, offsets)["kept"] for _, _, raw, offsets in slabs(column, column)]
            yield batch.filter(pa.array(np.concatenate(flags) if flags else np.zeros(0, bool)))

    return small_batches(docs).mapInArrow(work, docs.schema)


def brute(text: str | None) -> tuple:
    """The contract's base measures of one text, for tests."""
    import re

    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    g = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {i + j for i, x in enumerate(g) if g.count(x) > 1 for j in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w))
