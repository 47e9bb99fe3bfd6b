"""Suffix-array dedup by a logarithmic family of indexes.

`IndexFamily.add` gives each new batch a suffix array (prefix doubling in numpy from ranks of short strings by a table,
compared up to `window` bytes), merge-scans it against the suffix arrays of the existing levels for matches of `window` bytes, and
stores it; two levels of like size merge into one of twice the size, so that b batches lie in log b levels.

Over a corpus the family works on runs of windows with equal anchors (see `anchors`): the first and the last run of
each content, wherever an anchor occurs twice.  A task takes whole anchors, in order; a batch holds many of them, and
a family ends with the last batch of its last anchor, for nothing that comes later can match it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.anchors import Bytes, asked, covered, repeats, with_spans
from plumbline.llm.common import slabs

#: Bytes of a window, of an anchor and of a batch; entries of a table that ranks strings without a sort.
WINDOW, GRAM, BATCH_BYTES, TABLE = 400, 32, 1 << 20, 1 << 22


def _dense(key: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of keys of so many bits, and the rank of each (equal keys share it)."""
    low = len(key).bit_length()
    if bits + low <= 64:  # key and place as one number: numbers sort several times as fast as an order of them
        key = np.sort((key << np.uint64(low)) | np.arange(len(key), dtype=np.uint64))
        order = (key & np.uint64((1 << low) - 1)).astype(np.int64)
        key >>= np.uint64(low)
    else:
        order = np.argsort(key)
        key = key[order]
    step = np.empty(len(key), np.uint32)
    if len(key):
        step[0] = 0
        step[1:] = key[1:] != key[:-1]
    rank = np.empty(len(key), np.uint32)
    rank[order] = np.cumsum(step, dtype=np.uint32)
    return order, rank


def _joined(rank: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, int]:
    """Keys that sort like pairs of ranks at two lists of places, and their bits."""
    bits = int(rank.max(initial=1)).bit_length()
    return (rank[first].astype(np.uint64) << np.uint64(bits)) | rank[second], 2 * bits


def _short(text: np.ndarray, most: int) -> tuple[np.ndarray, int]:
    """Ranks of the strings of some bytes, `most` or fewer, at each place, and how many bytes: as many as keep the table small."""
    held = np.zeros(256, np.uint32)
    held[text] = 1
    code = (np.cumsum(held, dtype=np.uint32) - 1)[text]
    rank, many, letters, known = code, int(held.sum()), int(held.sum()), 1
    while known < min(most, 8) and many * letters <= TABLE:
        key = rank[:-1] * np.uint32(letters) + code[known:]
        held = np.zeros(many * letters, np.uint32)
        held[key] = 1
        held = np.cumsum(held, dtype=np.uint32)
        rank, many, known = held[key] - 1, int(held[-1]), known + 1
    return rank, known


def _eight(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on as a number that sorts like them; zeros follow the end."""
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = np.zeros(len(text), np.uint64)
    for j in range(8):
        out |= wide[j : j + len(text)] << np.uint64(56 - 8 * j)
    return out


class Level:
    """Suffix array, up to `window` bytes, of those positions of a text that have so many bytes of their own part."""

    def __init__(self, parts: list[bytes], owners: list[int], window: int, hit: list[np.ndarray] | None = None) -> None:
        self.parts, self.owners, self.window = parts, owners, window
        text = np.frombuffer(b"".join(parts), np.uint8)
        length = np.fromiter(map(len, parts), np.int64, len(parts))
        n = np.maximum(length - window + 1, 0)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.part = np.repeat(np.arange(len(parts)), n)
        self.at = np.repeat(np.cumsum(length) - length, n) + inner
        self.text = text
        if not len(self.at):
            self.order, self.rank = np.zeros(0, np.int64), np.zeros(0, np.uint32)
        else:
            rank, known = _short(text, window)
            while known * 2 < window:
                more = min(known, (window + 1) // 2 - known)
                every = np.arange(len(text) - known - more + 1)
                if (known + more) * 2 >= window:  # the last ranks that are asked for
                    last = np.zeros(len(every), bool)
                    last[self.at] = last[self.at + window - known - more] = True
                    every = np.flatnonzero(last)
                _, found = _dense(*_joined(rank, every, every + more))
                rank = np.zeros(len(text) - known - more + 1, np.uint32)
                rank[every], known = found, known + more
            self.order, self.rank = _dense(*_joined(rank, self.at, self.at + window - known))
        self.sorted_at = self.at[self.order]
        size = np.bincount(self.rank) if len(self.rank) else np.zeros(0, np.int64)
        self.hit = size[self.rank] > 1
        if hit:
            self.hit |= np.concatenate(hit)

    @cached_property
    def words(self) -> np.ndarray:
        return _eight(np.concatenate([self.text, np.zeros(self.window + 8, np.uint8)]))

    def scan(self, other: Level) -> None:
        """Marks, on both sides, the suffixes whose first `window` bytes the other level holds as well."""
        if not len(self.at) or not len(other.at):
            return
        lo, hi = np.zeros(len(self.at), np.int64), np.full(len(self.at), len(other.at), np.int64)
        while (live := np.flatnonzero(lo < hi)).size:
            mid = (lo[live] + hi[live]) >> 1
            less = self._compare(live, other, mid) > 0
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
        inside = np.flatnonzero(lo < len(other.at))
        same = inside[self._compare(inside, other, lo[inside]) == 0]
        self.hit[same] = True
        mark = np.zeros(int(other.rank.max()) + 1, bool)
        mark[other.rank[other.order[lo[same]]]] = True
        other.hit |= mark[other.rank]

    def _compare(self, mine: np.ndarray, other: Level, theirs: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 for each pair of suffixes, by 8 bytes at a time while they are equal."""
        out = np.zeros(len(mine), np.int8)
        live, a, b = np.arange(len(mine)), self.at[mine], other.sorted_at[theirs]
        for k in range(0, self.window, 8):
            x, y = self.words[a[live] + k], other.words[b[live] + k]
            if self.window - k < 8:
                drop = np.uint64(8 * (8 - self.window + k))
                x, y = x >> drop, y >> drop
            differ = x != y
            out[live[differ]] = np.where(x[differ] > y[differ], 1, -1)
            live = live[~differ]
            if not live.size:
                break
        return out


class IndexFamily:
    def __init__(self, window: int = WINDOW) -> None:
        self.window, self.levels = window, []

    def add(self, parts: list[bytes], owners: list[int]) -> None:
        new = Level(parts, owners, self.window)
        for level in self.levels:
            new.scan(level)
        while self.levels and len(self.levels[-1].text) < 2 * len(new.text):
            old = self.levels.pop()
            new = Level(old.parts + new.parts, old.owners + new.owners, self.window, [old.hit, new.hit])
        self.levels.append(new)

    def matches(self) -> Iterator[tuple[int, np.ndarray]]:
        """(owner, offsets of the windows that occur elsewhere)."""
        for level in self.levels:
            where = np.flatnonzero(level.hit)
            part = level.part[where]
            starts = np.cumsum([0, *map(len, level.parts)])
            cuts = np.flatnonzero(np.diff(part, prepend=-1))
            for p, at in zip(part[cuts].tolist(), np.split(level.at[where], cuts[1:])):
                yield level.owners[p], at - starts[p]


def _search(window: int, batch_bytes: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int, int]] = []
        parts: list[bytes] = []
        family, held, of, size, done, last = IndexFamily(window), 0, None, 0, 0, None

        def spans() -> pa.RecordBatch:
            out: tuple[list, ...] = ([], [], [], [])
            for owner, at in family.matches():
                i, th, start = keys[owner]
                cut = np.flatnonzero(np.diff(at) != 1)
                for x, y in zip(at[np.append(0, cut + 1)].tolist(), at[np.append(cut, len(at) - 1)].tolist()):
                    for k, v in zip(out, (i, th, start + x, start + y + window)):
                        k.append(v)
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "th", "start", "stop"])

        for batch in batches:
            for h, i, th, start, content in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (h, i, th, start) == last:  # a repeated row is one document
                    continue
                last = (h, i, th, start)
                if h != of and held + size >= batch_bytes:  # no earlier run can match what comes now
                    family.add(parts[done:], list(range(done, len(keys))))
                    yield spans()
                    family, keys, parts, held, size, done = IndexFamily(window), [], [], 0, 0, 0
                elif size >= batch_bytes:
                    family.add(parts[done:], list(range(done, len(keys))))
                    held, size, done = held + size, 0, len(keys)
                of = h
                keys.append((i, th, start))
                parts.append(content)
                size += len(content)
        if done < len(keys):
            family.add(parts[done:], list(range(done, len(keys))))
        yield spans()

    return work


def duplicate_spans(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(id, th, start, stop), in bytes, of strings of `window` bytes that also start anywhere else."""
    kind = Bytes(window, min(GRAM, window))
    hits = repeats(docs, kind, first_stays=False)
    copies = hits.where("not ask").select("id", "th", "start", (F.col("start") + F.col("r") - 1 + window).alias("stop"))
    runs = asked(docs, hits, kind)
    found = runs.repartition("h").sortWithinPartitions("h", "id", "th", "start").mapInArrow(_search(window, batch_bytes), "id long, th long, start long, stop long")
    return copies.unionByName(found)


def dedup(docs: DataFrame, window: int = WINDOW, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): bytes of a repeated string go, the first occurrence included.

    Null and empty texts have no bytes.  Rows alike in doc_id and text count as one document and get equal
    results.  Copies of a text under other ids are all removed; a very long text is one row of one task.  Further columns
    of docs play no part, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(1)):
                total, removed, count, kept = [], [], [], []
                for i in range(a, b):
                    text = raw[offsets[i - a] : offsets[i - a + 1]]
                    gone, n = covered(len(text), spans[i])
                    total.append(len(text))
                    removed.append(int(gone.sum()))
                    count.append(n)
                    kept.append(text[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(x, pa.int64()) for x in (total, removed, count)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return with_spans(docs, duplicate_spans(docs, window, batch_bytes)).mapInArrow(work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return dedup(docs, window).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """The same by a dictionary of every string, for tests."""
    from collections import Counter

    texts = {i: (t or "").encode() for i, t in rows}
    n = Counter(t[k : k + window] for t in texts.values() for k in range(len(t) - window + 1))
    out = {}
    for i, t in texts.items():
        gone = bytearray(len(t))
        for k in range(len(t) - window + 1):
            if n[t[k : k + window]] > 1:
                gone[k : k + window] = b"\1" * window
        runs = sum(1 for k in range(len(t)) if gone[k] and not (k and gone[k - 1]))
        out[i] = (len(t), sum(gone), runs, hashlib.sha256(bytes(x for x, y in zip(t, gone) if not y)).hexdigest())
    return out
