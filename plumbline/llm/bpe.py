"""Byte-level BPE by recursive queries of a DuckDB that each task runs in memory.

The distinct words of a batch become rows of token positions.  A recursive query joins neighbouring tokens
with the merge table, finds each word's pair of least rank (the leftmost of equal ones), contracts it, and
goes on with the words that changed until none does.  Decoding joins the token positions of each document with
the vocabulary and aggregates their bytes in order.  Words and pieces a task has met before are not asked again;
the memory for that is bounded, those not met for longest go first.

A text is first cut where the public splitting pattern always starts a new match (single spaces between other
characters, letters next to digits or punctuation), so that most pieces are words and the pattern itself runs on what is
left; under another pattern a text is one piece.

A long word is cut first where no token can lie across: no vocabulary entry occurs there.  Where entries occur
everywhere, the contractions are done by layers of rank: as long as a pair of rank R or less exists, no other
pair is contracted, hence only entries of rank R or less tie the parts together.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from plumbline.llm.common import slabs, small_batches

#: Words or pieces a task remembers; words a query takes at once; bytes from which a word or piece is not remembered;
#: from which a word is cut up; tokens from which a part of it is cut by rank; and bytes of text coded at once.
MEMO, BATCH, LONG, WHOLE, PART, LOT = 100_000, 16_000, 200, 64, 96, 2 << 20

ENCODE = """
WITH RECURSIVE state(w, toks) USING KEY (w) AS (
  SELECT w, toks FROM seed
  UNION ALL
  (WITH pair AS (SELECT w, unnest(toks[:-2]) AS l, unnest(toks[2:]) AS r, generate_subscripts(toks[2:], 1) AS p FROM state),
   best AS (SELECT w, min(m.id::BIGINT << 32 | p) AS b FROM pair JOIN merges m ON m.l = pair.l AND m.r = pair.r WHERE m.id <= ? GROUP BY w)
   SELECT s.w, s.toks[:(b & 4294967295) - 1] || [(b >> 32)::INT] || s.toks[(b & 4294967295) + 2:] FROM state s JOIN best b ON s.w = b.w)
)
SELECT w, toks FROM state ORDER BY w
"""
DECODE = "SELECT w, list(v.bytes ORDER BY p) AS bytes FROM coded JOIN vocabulary v ON v.id = coded.t GROUP BY w ORDER BY w"


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Memo:
    """A mapping of at most `size` entries; a full half makes way for those that were asked since."""

    def __init__(self, size: int) -> None:
        self.half, self.young, self.old = size // 2, {}, {}

    def get(self, keys: list[bytes]) -> list[bytes | None]:
        """What is known of distinct keys."""
        out = list(map(self.young.get, keys))
        for i in [i for i, x in enumerate(out) if x is None] if self.old else ():
            if (value := self.old.get(keys[i])) is not None:
                out[i] = self.young[keys[i]] = value
        return out

    def put(self, keys: list[bytes], values: list[bytes]) -> None:
        self.young.update((k, v) for k, v in zip(keys, values) if len(k) < LONG)
        if len(self.young) >= self.half:
            self.old, self.young = self.young, {}


class Codec:
    """A DuckDB with the merge table and vocabulary of one rank file."""

    def __init__(self, path: str, pattern: str) -> None:
        import duckdb
        import regex

        white = r"\p{White_Space}"  # \s of Python would also take 0x1C-0x1F
        self.pattern = regex.compile(pattern.replace(r"\s", white).replace(r"\S", r"\P{White_Space}"))
        self.public = pattern == default_pattern()
        self.rank = rank = ranks(path)
        merges = [(a, b, r) for t, r in rank.items() for i in range(1, len(t)) if (a := rank.get(t[:i])) is not None and (b := rank.get(t[i:])) is not None]
        self.byte = np.array([rank[bytes([i])] for i in range(256)], np.int32)
        self.most = max(rank.values())
        self.size = np.zeros(self.most + 1, np.int64)
        self.size[list(rank.values())] = list(map(len, rank))
        self.name = pa.array([str(i) for i in range(self.most + 1)], pa.large_string())
        self.longest = max(map(len, rank))
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB"})
        table = pa.table({k: pa.array(v, pa.int32()) for k, v in zip("l r id".split(), zip(*merges))})
        words = pa.table({"id": pa.array(rank.values(), pa.int32()), "bytes": pa.array(list(rank), pa.binary())})
        self.db.register("given_merges", table)
        self.db.register("given_words", words)
        self.db.execute("CREATE TABLE merges AS SELECT * FROM given_merges; CREATE TABLE vocabulary AS SELECT * FROM given_words")
        self.db.unregister("given_merges")
        self.db.unregister("given_words")
        self.words, self.pieces = Memo(4 * MEMO), Memo(MEMO // 2)

    def __enter__(self) -> Codec:
        return self

    def __exit__(self, *_) -> None:
        """Gives back what a task has held: its worker goes on to other tasks, of other operators too."""
        self.db.close()
        self.words, self.pieces = Memo(0), Memo(0)
        _entries.cache_clear()
        pa.default_memory_pool().release_unused()

    def contract(self, flat: np.ndarray, ends: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Lists of tokens (flat, with their ends) after all contractions of rank `limit` or less."""
        toks = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))
        self.db.register("seed", pa.table({"w": pa.array(np.arange(len(ends) - 1, dtype=np.int32)), "toks": toks}))
        got = self.db.sql(ENCODE, params=[limit]).to_arrow_table()["toks"].combine_chunks()
        self.db.unregister("seed")
        return got.flatten().to_numpy(), got.offsets.to_numpy() - got.offsets[0].as_py()

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The tokens of each word (not empty), as bytes of 32-bit numbers."""
        out: list[bytes] = [b""] * len(words)
        for many, size, long in ((BATCH, LOT, False), (LOT, LOT // 4, True)):
            which = [i for i, w in enumerate(words) if (len(w) > WHOLE) == long]
            a = 0
            while a < len(which):
                b, held = a, 0
                while b < len(which) and b - a < many and (b == a or held + len(words[which[b]]) <= size):
                    held += len(words[which[b]])
                    b += 1
                lot = [words[i] for i in which[a:b]]
                if long:
                    flat, ends = LongWords(self, lot).tokens()
                else:
                    flat, ends = self.contract(self.byte[np.frombuffer(b"".join(lot), np.uint8)], np.cumsum([0, *map(len, lot)]), self.most)
                data, ends = flat.tobytes(), (4 * ends).tolist()
                for i, x, y in zip(which[a:b], ends, ends[1:]):
                    out[i] = data[x:y]
                a = b
        return out

    def split(self, piece: bytes) -> list[bytes]:
        """The matches of the pattern."""
        return [m.encode() for m in self.pattern.findall(piece.decode())]

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        """The tokens of each of distinct pieces, as bytes of 32-bit numbers; new words are asked together, each once, whether
        alone or inside a piece."""
        out = self.words.get(pieces)
        several, parts, new = [], [], []
        for i in [i for i, x in enumerate(out) if x is None]:
            if self.public and _WORD(pieces[i]):
                new.append(pieces[i])
            else:
                several.append(i)
        for i, x in zip(several, self.pieces.get([pieces[i] for i in several])):
            out[i] = x
        several = [i for i in several if out[i] is None]
        parts = [self.split(pieces[i]) for i in several]
        found: dict[bytes, bytes | None] = dict.fromkeys(new)
        inside = list({w for ws in parts for w in ws} - found.keys())
        found.update(zip(inside, self.words.get(inside)))
        new = sorted(w for w, x in found.items() if x is None)
        coded = self.encode_words(new)
        found.update(zip(new, coded))
        self.words.put(new, coded)
        for i, ws in zip(several, parts):
            out[i] = b"".join([found[w] for w in ws])
        self.pieces.put([pieces[i] for i in several], [out[i] for i in several])
        return [found[p] if x is None else x for p, x in zip(pieces, out)]

    def ids(self, raw: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of neighbouring pieces (starts and the end) of a text, and the number of them up to each cut."""
        every = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(np.ascontiguousarray(cuts)), pa.py_buffer(raw)]).dictionary_encode()
        coded = self.encode(every.dictionary.to_pylist())
        size = np.fromiter(map(len, coded), np.int64, len(coded)) >> 2
        flat, begin, at = np.frombuffer(b"".join(coded), np.int32), np.cumsum(size) - size, every.indices.to_numpy()
        size = size[at]
        total = np.concatenate([[0], np.cumsum(size)])
        return flat[np.arange(int(total[-1])) - np.repeat(total[:-1] - begin[at], size)], total

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of each list of tokens: ids[offsets[k] : offsets[k + 1]]."""
        n = len(offsets) - 1
        w = np.repeat(np.arange(n), np.diff(offsets))
        table = pa.table({"w": w, "p": np.arange(len(ids)), "t": ids})
        self.db.register("coded", table)
        got = self.db.sql(DECODE).to_arrow_table()
        self.db.unregister("coded")
        out = [b""] * n
        for i, text in zip(got["w"].to_pylist(), pc.binary_join(got["bytes"].cast(pa.large_list(pa.large_binary())), pa.scalar(b"", pa.large_binary())).to_pylist()):
            out[i] = text
        return out

    def names(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Each list of tokens as decimals joined by commas."""
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), self.name.take(pa.array(ids))), pa.scalar(",", pa.large_string())).to_pylist()


class LongWords:
    """Words that are cut up before they are coded: where no entry of the vocabulary, of rank `limit` or less, occurs across
    the cut with both ends at present token ends, no contraction up to that limit can cross."""

    def __init__(self, codec: Codec, words: list[bytes]) -> None:
        word, self.bounds = b"".join(words), np.cumsum([0, *map(len, words)])
        self.codec, self.toks = codec, codec.byte[np.frombuffer(word, np.uint8)]
        n = len(word)
        start, stop, by = [], [], []
        for size in range(2, min(codec.longest, n) + 1):
            some = _entries(codec, size)
            if not len(some[0]):
                continue
            key = _window_keys(word, size)
            at = np.minimum(np.searchsorted(some[0], key), len(some[0]) - 1)
            hit = np.flatnonzero(some[0][at] == key)
            start.append(hit)
            stop.append(hit + size)
            by.append(some[1][at[hit]])
        start, stop, by = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (start, stop, by))
        inside = np.searchsorted(self.bounds, start, "right") == np.searchsorted(self.bounds, stop, "left")
        self.start, self.stop, self.by = start[inside], stop[inside], by[inside]

    def _parts(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """Cuts (token numbers, with both ends), and the occurrences that tie tokens together, up to the limit."""
        ends = np.concatenate([[0], np.cumsum(self.codec.size[self.toks])])
        place = np.full(ends[-1] + 1, -1, np.int64)
        place[ends] = np.arange(len(ends))
        x, y = place[self.start], place[self.stop]
        tie = np.flatnonzero((x >= 0) & (y > x + 1) & (self.by <= limit))
        edge = np.zeros(len(ends), np.int64)
        np.add.at(edge, x[tie] + 1, 1)
        np.add.at(edge, y[tie], -1)
        across = np.cumsum(edge)
        across[[0, -1]] = 0
        return np.flatnonzero(across == 0), tie

    def contract(self, limit: int, done: int = -1) -> None:
        """All contractions of rank `limit` or less, those up to `done` having been made."""
        cuts, tie = self._parts(limit)
        if (np.diff(cuts) > PART).any():
            ends = np.concatenate([[0], np.cumsum(self.codec.size[self.toks])])
            where = np.searchsorted(ends[cuts], self.start[tie], "right") - 1
            steps = np.unique(self.by[tie[np.diff(cuts)[where] > PART]])
            steps = steps[steps > done]
            if len(steps) > 1:
                middle = int(steps[(len(steps) - 1) // 2])
                self.contract(middle, done)
                return self.contract(limit, middle)
            if len(steps) == 1:
                cuts = self._alternate(cuts, ends, tie, int(steps[0]))
        size = np.diff(cuts)
        some = np.flatnonzero(size > 1)
        new = np.split(self.toks, cuts[1:-1])
        for a in range(0, len(some), BATCH):
            lot = some[a : a + BATCH].tolist()
            flat, ends = self.codec.contract(np.concatenate([new[k] for k in lot]), np.cumsum([0, *(len(new[k]) for k in lot)]), limit)
            for k, x, y in zip(lot, ends.tolist(), ends[1:].tolist()):
                new[k] = flat[x:y]
        self.toks = np.concatenate(new)

    def _alternate(self, cuts: np.ndarray, ends: np.ndarray, tie: np.ndarray, step: int) -> np.ndarray:
        """More cuts for parts over PART tokens in which only pairs of one rank can be contracted: the leftmost of
        overlapping pairs comes first, so that every second token begins a pair of its own."""
        more = []
        place = np.full(ends[-1] + 1, -1, np.int64)
        place[ends] = np.arange(len(ends))
        x, y = place[self.start[tie]], place[self.stop[tie]]
        of = np.searchsorted(cuts, x, "right") - 1
        for k in np.flatnonzero(np.diff(cuts) > PART).tolist():
            mine = of == k
            if (self.by[tie[mine]] == step).all() and (y[mine] - x[mine] == 2).all():
                at = np.sort(x[mine])
                begin = np.flatnonzero(np.diff(at, prepend=-9) != 1)
                run = np.repeat(at[begin], np.diff(np.append(begin, len(at))))
                first = at[(at - run) % 2 == 0]
                more += [first, first + 2]
        return np.unique(np.concatenate([cuts, *more])) if more else cuts

    def tokens(self) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, and their ends by word."""
        self.contract(self.codec.most)
        return self.toks, np.searchsorted(np.concatenate([[0], np.cumsum(self.codec.size[self.toks])]), self.bounds)


def _window_keys(word: bytes, size: int) -> np.ndarray:
    """A 64-bit number for the bytes from each position on; equal bytes, equal numbers."""
    raw = np.frombuffer(word, np.uint8).astype(np.uint64)
    key = np.full(len(raw) - size + 1, size, np.uint64)
    for j in range(size):
        key = key * np.uint64(0x100000001B3) + raw[j : len(raw) - size + 1 + j] + np.uint64(1)
        key ^= key >> np.uint64(29)
    return key


@lru_cache(maxsize=256)
def _entries(codec: Codec, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the entries of so many bytes, sorted, and their ranks."""
    some = [t for t in codec.rank if len(t) == size]
    key = np.array([_window_keys(t, size)[0] for t in some], np.uint64)
    order = np.argsort(key)
    return key[order], np.array([codec.rank[t] for t in some], np.int64)[order]


_INNER = np.ones(256, bool)  # bytes between which a single space may be a cut: no white space, nor a first byte of such
_INNER[[0x20, *range(0x09, 0x0E)]] = False
_FIRST = _INNER.copy()
_FIRST[[0xC2, 0xE1, 0xE2, 0xE3]] = False
_CLASS = np.full(256, 3, np.uint8)  # 0 white space, 1 letter, 2 digit, 3 other; 4 beyond ASCII
_CLASS[~_INNER], _CLASS[0x80:], _CLASS[0x30:0x3A] = 0, 4, 2
_CLASS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_LATIN = np.zeros(256, bool)  # second bytes of letters whose first is 0xC3: all but those of the signs of multiplication and division
_LATIN[[x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)]] = True
#: A letter run of ASCII and Latin-1, with a space before it or not: one match of the public pattern.
_WORD = re.compile(rb" ?(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch


def cuts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of pieces whose tokens do not depend on each other, and the end: documents; single spaces between other
    characters (not next to one that may be white space beyond ASCII); ends of runs of letters, digits or other ASCII characters, but
    for an apostrophe with a letter; and what follows a single white character other than a space."""
    at = np.flatnonzero(raw == 0x20)
    at = at[(at > 2) & (at < len(raw) - 1)]
    lead = raw[at - 3] | np.where(raw[at - 1] < 0x80, 0xFF, 0)
    good = _INNER[raw[at - 1]] & _FIRST[raw[at + 1]] & ((raw[at - 1] < 0x80) | ((raw[at - 2] != 0xC2) & ~np.isin(lead, (0xE1, 0xE2, 0xE3))))
    cut = np.zeros(len(raw) + 1, bool)
    cut[at[good]] = True
    cut[np.maximum(offsets[1:] - 1, 0)] = False
    if len(raw) > 1:
        kind = _CLASS[raw]
        before = kind.copy()
        before[1:][(raw[:-1] == 0xC3) & _LATIN[raw[1:]]] = 1
        left, right = before[:-1], kind[1:]
        cut[1:-1] |= (left > 0) & (left < 4) & (right < 4) & (left != right) & ~((raw[:-1] == 0x27) & (right == 1))
        alone = (before[:-2] > 0) & (before[:-2] < 4) & (kind[1:-1] == 0) & (raw[1:-1] != 0x20) & (kind[2:] > 0) & (kind[2:] < 4)
        cut[2:-1] |= alone
    cut[offsets] = True
    return np.flatnonzero(cut)


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def lots(own: Codec, raw: np.ndarray, offsets: np.ndarray, limit: int = LOT) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tokens, their offsets by document) of a slab; a long document comes in several lots."""
    at = cuts(raw, offsets) if own.public else np.unique(offsets)
    if len(offsets) > 2 or len(raw) <= limit:
        tokens, total = own.ids(raw, at) if len(at) > 1 else (np.zeros(0, np.int32), np.zeros(1, np.int64))
        yield tokens, total[np.searchsorted(at, offsets)]
        return
    a = 0
    while a < len(at) - 1:
        b = max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1)
        tokens, total = own.ids(raw[at[a] : at[b]], at[a : b + 1] - at[a])
        yield tokens, np.array([0, len(tokens)])
        a = b


def encoded(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of each row; null and empty texts have no tokens.

    `path` names the rank file, which every executor must have; without it the public file of the tokenizer
    package is found on each executor.  Special tokens are ordinary text.  Rows stand for themselves: repeated ones
    give repeated results, a null doc_id stays null, further columns play no part.  A very long text is coded in lots
    of some MB and only its digests go on from lot to lot; `ids` needs the whole list of a text at once.  Of pairs of
    equal rank the leftmost is contracted first.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(path or default_path(), pattern or default_pattern()) as own:
            yield from coded(own, batches)

    def coded(own: Codec, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(1), LOT):
                n = b - a
                number, lists = np.zeros(n, np.int64), [[] for _ in range(n)]
                digest, back = [hashlib.sha256() for _ in range(n)], [hashlib.sha256() for _ in range(n)]
                for tokens, total in lots(own, raw, offsets):
                    for i, (names, text) in enumerate(zip(own.names(tokens, total), own.decode(tokens, total))):
                        digest[i].update((("," if number[i] and names else "") + names).encode())
                        back[i].update(text)
                    number += np.diff(total)
                    if ids:
                        for i in range(n):
                            lists[i].append(tokens[total[i] : total[i + 1]])
                columns = [batch.column(0).slice(a, n), pa.array(number), pa.array([x.hexdigest() for x in digest]), pa.array([x.hexdigest() for x in back])]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    columns.append(pa.array([np.concatenate(x) for x in lists], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return small_batches(docs).select(id_col, text_col).mapInArrow(work, schema)


def decoded(rows: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, bytes) of each row's list of ids; a null list gives no bytes, an id that the vocabulary lacks none either.
    Repeated rows and null doc_ids stay as they are, further columns play no part."""
    kind = rows.schema[id_col].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with Codec(path or default_path(), default_pattern()) as own:
            for batch in batches:
                for a in range(0, batch.num_rows, 200):
                    part = batch.slice(a, 200)
                    lists = [np.array([x for x in some or [] if x is not None], np.int32) for some in part.column(1).to_pylist()]
                    text = own.decode(np.concatenate(lists), np.cumsum([0, *map(len, lists)]))
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(text, pa.binary())], names=["doc_id", "bytes"])

    return rows.select(id_col, ids_col).mapInArrow(work, f"doc_id {kind}, bytes binary")
