"""Substring dedup by relative Lempel-Ziv parsing of word windows.

A reference block holds the earlier runs of windows that share an anchor (see `anchors`); a later run is
parsed against it greedily: a factor starts at the earliest place where the block holds the next window and goes on as
long as the block does; a window that the block does not hold is one literal word.  A factor thus covers whole
windows, so it is long enough to be a duplicate span; the parse then goes on at the first window that the factor did not
cover, so that matches across a factor's end are found as well.  Other places of the same window would give factors of
other lengths, but the same windows in all.
Only blocks that share an anchor with a document can hold a factor of `window` words of it, hence every
block that matters is visited and no other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.anchors import Words, asked, covered, repeats, with_spans
from plumbline.llm.common import slabs, words

WINDOW, GRAM = 20, 4


class ReferenceBlock:
    """Window hashes of earlier runs, in order, and the first place of each."""

    def __init__(self) -> None:
        self.text: list[int] = []
        self.first: dict[int, int] = {}

    def parse(self, run: list[int]) -> list[tuple[int, int]]:
        """(first window, number of windows) of each factor of the greedy parse."""
        out, i, n, text = [], 0, len(run), self.text
        while i < n:
            at = self.first.get(run[i])
            if at is None:
                i += 1
                continue
            j = 1
            while i + j < n and at + j < len(text) and text[at + j] == run[i + j]:
                j += 1
            out.append((i, j))
            i += j
        return out

    def add(self, run: list[int]) -> None:
        at = len(self.text)
        self.text += run
        for i, x in enumerate(run):
            self.first.setdefault(x, at + i)


def _factor(window: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, of, last = ReferenceBlock(), None, None
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [])
            for h, i, th, start, content in zip(*(batch.column(k).to_pylist() for k in range(5))):
                if (h, i, th, start) == last:  # a repeated row is one document
                    continue
                last = (h, i, th, start)
                if h != of:
                    block, of = ReferenceBlock(), h
                run = np.frombuffer(content, np.uint64).tolist()
                for a, n in block.parse(run):
                    for k, v in zip(out, (i, th, start + a, start + a + n - 1 + window)):
                        k.append(v)
                block.add(run)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["id", "th", "start", "stop"])

    return work


def duplicate_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(id, th, start, stop), in words, of windows whose words also start earlier (smaller id, or earlier in the text)."""
    kind = Words(window, min(GRAM, window))
    hits = repeats(docs, kind, first_stays=True)
    copies = hits.where("not ask").select("id", "th", "start", (F.col("start") + F.col("r") - 1 + window).alias("stop"))
    runs = asked(docs, hits, kind)
    parsed = runs.repartition("h").sortWithinPartitions("h", "id", "th", "start").mapInArrow(_factor(window), "id long, th long, start long, stop long")
    return copies.unionByName(parsed)


def dedup(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): every word of a duplicate span goes, the rest is joined by single spaces.

    Null and empty texts have no words.  Rows alike in doc_id and text count as one document and get equal
    results; a null doc_id is the smallest.  Of copies under several ids the one of least id stays; a very long text is one
    row of one task.  Further columns of docs play no part, whatever their names.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2).to_pylist()
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(1)):
                s, e, first = words(raw, offsets)
                data, total, removed, kept = raw.tobytes(), [], [], []
                for i in range(a, b):
                    x, y = int(first[i - a]), int(first[i - a + 1])
                    gone, _ = covered(y - x, spans[i])
                    stay = np.flatnonzero(~gone) + x
                    total.append(y - x)
                    removed.append(int(gone.sum()))
                    kept.append(b" ".join([data[p:q] for p, q in zip(s[stay].tolist(), e[stay].tolist())]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], names=["doc_id", "n_words", "n_removed", "kept"])

    return with_spans(docs, duplicate_spans(docs, window)).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept binary")


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    return dedup(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute(rows: list[tuple[int, str | None]], window: int = WINDOW) -> dict[int, tuple[int, int, str]]:
    """The same by a dictionary of every window, for tests."""
    import re

    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            if g in seen:
                gone[k : k + window] = [True] * window
            seen.add(g)
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, y in zip(w, gone) if not y).encode()).hexdigest())
    return out
