import random

import numpy as np
import pytest


@pytest.fixture(scope="module")
def codec():
    pytest.importorskip("public_tokenizers")
    from plumbline.llm import bpe

    return bpe.Codec(bpe.default_path(), bpe.default_pattern())


def test_bpe_pieces_are_whole_matches(codec):
    """Cuts lie between matches of the public pattern, whatever stands beside them."""
    from plumbline.llm import bpe

    r = random.Random(8)
    alphabet = [*"ab Zé×÷ñ 09.,'-(\n\t\r\x1c", " ", "  ", "\n\n", "'s", "'re", " '", "\x85", " ", " ", "　", "字", "ſ", "Ⅷ", "²", "😀", "é", "ü."]
    for _ in range(3000):
        docs = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 9))) for _ in range(3)]
        raw = "".join(docs).encode()
        at = bpe.cuts(np.frombuffer(raw, np.uint8), np.cumsum([0, *(len(d.encode()) for d in docs)]))
        pieces = [raw[a:b] for a, b in zip(at, at[1:])]
        assert [m for p in pieces for m in codec.split(p)] == [m for d in docs for m in codec.split(d.encode())], docs
        assert all(codec.split(p) == [p] for p in pieces if bpe._WORD(p))
    raw = "Un été, deux (mots); trois.\nFin 12ab".encode()
    at = bpe.cuts(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    assert [raw[a:b].decode() for a, b in zip(at, at[1:])] == ["Un", " été", ",", " deux", " (", "mots", ");", " trois", ".", "\n", "Fin", " 12", "ab"]


def test_bpe_asks_a_word_once(codec, monkeypatch):
    """Alone, before a stop or inside a piece that the pattern has to split, a word is coded once."""
    from plumbline.llm import bpe

    asked, coded = [], codec.encode_words
    monkeypatch.setattr(codec, "encode_words", lambda words: asked.extend(words) or coded(words))
    names = ["".join(chr(97 + int(d)) for d in str(k)) for k in range(50)]
    text = "".join(f" word{k} wört{k} word{k}, word{k}. wört{k}! word{k}  word{k} '{k}'word{k}" for k in names).encode()
    for part in (text, text):
        tokens, _ = codec.ids(np.frombuffer(part, np.uint8), bpe.cuts(np.frombuffer(part, np.uint8), np.array([0, len(part)])))
        assert codec.decode(tokens, np.array([0, len(tokens)])) == [part]
    assert len(asked) == len(set(asked)) > 2
