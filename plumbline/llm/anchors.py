"""Finding repeated windows of a fixed length, exactly and with little data moved.

Every window of W items has one anchor: the leftmost of its k-grams with the least hash.  Equal windows
have equal anchors at equal offsets, so it is enough to compare windows whose anchors have equal hashes.
Neighbouring windows mostly share their anchor; such a run travels as one row (anchor hash, content hash,
document, first window, number of windows).  Which windows repeat is then for the caller's index to find
(suffix arrays, factors against a reference); this module decides what the index has to see:

* an anchor hash that only one run has holds no repeat;
* of an anchor hash with several runs, the index sees the first and the last run of each content;
* all other runs of a content are copies of those two, and repeat as a whole.

Runs of equal content are collapsed inside each task before anything is shuffled (two rows a content and
task at most), so that a passage held by a third of all documents stays a few rows for each task.  An anchor
with very many contents (a common phrase) is dealt out by a second anchor, the least of the other k-grams in
another order, so that no task compares all of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm.common import POS_BITS, POS_MASK, byte_hashes, discard, grams, mix, pair, release, row_key, signed, slabs, sliding_min, word_hashes, words, written

RUNS = T.StructType(
    [
        T.StructField("h", T.LongType()),
        T.StructField("c", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("th", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("r", T.IntegerType()),
        T.StructField("known", T.BooleanType()),
    ]
)


#: Contents that a task remembers, and asked runs of one anchor hash beyond which a second anchor deals them out.
MEMO, HEAVY = 1 << 20, 4096
_SALT = np.uint64(0xA24BAED4963EE407)


class Bytes:
    """Items are bytes; a run's content is its bytes."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram = window, gram

    def items(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
        return byte_hashes(raw), offsets, lambda a, b: raw[a : b + self.window].tobytes()


class Words:
    """Items are words; a run's content is the hashes of its windows."""

    def __init__(self, window: int, gram: int) -> None:
        self.window, self.gram = window, gram

    def items(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[[int, int], bytes]]:
        s, e, first = words(raw, offsets)
        h = word_hashes(raw, s, e)
        whole = grams(h, self.window)
        return h, first, lambda a, b: whole[a : b + 1].tobytes()


def runs(kind: Bytes | Words, h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each run: document (index), first and last window (items), anchor hash."""
    none = np.zeros(0, np.int64)
    if len(h) < kind.window:
        return none, none, none, none
    g = grams(h, kind.gram)
    key = ((g >> POS_BITS) << POS_BITS) | np.arange(len(g), dtype=np.uint64)
    least = (sliding_min(key, kind.window - kind.gram + 1) & POS_MASK).astype(np.int64)
    length = np.diff(first)
    n = np.maximum(length - kind.window + 1, 0)
    if not n.sum():
        return none, none, none, none
    doc = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    anchor = least[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(at)) - 1
    return doc[begin], at[begin], at[end], signed(g[anchor[begin]])


def _emit(kind: Bytes | Words) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("h", pa.int64()), ("c", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("r", pa.int32()), ("known", pa.bool_())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, int] = {}
        last = None
        for batch in batches:
            ids, ths = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(2)):
                h, first, content = kind.items(raw, offsets)
                doc, s, e, anchor = runs(kind, h, first)
                skip = [False] * (b - a)
                for i in range(a, b):  # rows are sorted by key: repeated rows follow each other
                    skip[i - a] = (ids[i], ths[i]) == last
                    last = (ids[i], ths[i])
                out: tuple[list, ...] = ([], [], [], [], [], [], [])
                for d, x, y, z in zip(doc.tolist(), s.tolist(), e.tolist(), anchor.tolist()):
                    if skip[d]:
                        continue
                    c = xxhash.xxh3_64_intdigest(content(x, y)) - (1 << 63)
                    n = seen.get(z ^ c, 0)
                    if len(seen) >= MEMO:  # forgetting costs rows to shuffle, never a repeat
                        seen.clear()
                    seen[z ^ c] = n + 1
                    row = (z if n < 2 else ths[a + d], c, ids[a + d], ths[a + d], x - int(first[d]), y - x + 1, n >= 2)
                    for k, v in zip(out, row):
                        k.append(v)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return work


def repeats(docs: DataFrame, kind: Bytes | Words, first_stays: bool) -> DataFrame:
    """(id, th, start, r, h, ask, heavy) of the runs that an index has to see (ask), and of those that repeat as a whole.

    With `first_stays` the least (id, th, start) of equal contents is no repeat; else all are.  Runs are counted by
    anchor first, added up before the shuffle, and joined back, a join that Spark splits where an anchor is hot; windows
    are only over runs of one content, two for each task.  Local collapse relies on the order of keys inside a task,
    hence the narrow sort before it.
    """
    spark = docs.sparkSession
    rows = written(row_key(docs).where("text is not null").sortWithinPartitions("id", "th").mapInArrow(_emit(kind), RUNS))
    shared = written(rows.where("not known").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"))
    some = rows.where("not known").join(shared.hint("merge"), "h")
    me = F.struct("id", "th", "start")
    same = Window.partitionBy("h", "c")
    some = some.withColumn("least", F.min(me).over(same)).withColumn("most", F.max(me).over(same))
    some = some.withColumn("ends", (me == F.col("least")) | (me == F.col("most")))
    some = written(some.select("id", "th", "start", "r", "h", "ends", (F.col("least") != F.col("most")).alias("twice")))
    known = rows.where("known").select("id", "th", "start", "r", "h", F.lit(False).alias("ask"), F.lit(False).alias("heavy"))
    several = written(some.where("ends").groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h", (F.col("n") > HEAVY).alias("heavy")))
    ends = some.where("ends").join(several.hint("merge"), "h").select("id", "th", "start", "r", "h", F.lit(True).alias("ask"), "heavy")
    copies = some.where("twice and not ends").select("id", "th", "start", "r", "h", F.lit(False).alias("ask"), F.lit(False).alias("heavy"))
    out = written(ends.unionByName(copies).unionByName(known))
    discard(rows, shared, some, several)
    release(spark)
    return out


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Each row of docs with the sorted list of its spans, null if there are none."""
    lists = spans.groupBy("id", "th").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    lists = lists.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "spans")
    keyed = row_key(docs)
    return keyed.join(lists, keyed.id.eqNullSafe(lists.sid) & (keyed.th == lists.sth), "left").select("id", "text", "spans")


def covered(length: int, spans: list[dict] | None) -> tuple[np.ndarray, int]:
    """Flags of covered items, and the number of maximal covered runs."""
    edge = np.zeros(length + 1, np.int64)
    if spans:
        a = np.fromiter((min(x["start"], length) for x in spans), np.int64, len(spans))
        b = np.fromiter((min(x["stop"], length) for x in spans), np.int64, len(spans))
        np.add.at(edge, a, 1)
        np.add.at(edge, b, -1)
    gone = np.cumsum(edge)[:length] > 0
    return gone, int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())


def _second(kind: Bytes | Words, g: np.ndarray, at: int, r: int, h: int) -> Iterator[tuple[int, int, int]]:
    """(hash of both anchors, first window, number of windows) of the parts of a run that share a second anchor: the least,
    in another order, of the window's k-grams that are not the first anchor."""
    mine = g[at : at + r + kind.window - kind.gram]
    key = ((mix(mine ^ _SALT) >> POS_BITS) << POS_BITS) | np.arange(len(mine), dtype=np.uint64)
    key[signed(mine) == h] |= np.uint64((1 << 64) - 1) << POS_BITS
    least = (sliding_min(key, kind.window - kind.gram + 1) & POS_MASK).astype(np.int64)
    begin = np.flatnonzero(np.diff(least, prepend=-1))
    both = signed(pair(np.full(len(begin), h, np.int64).view(np.uint64), mine[least[begin]]))
    yield from zip(both.tolist(), begin.tolist(), np.diff(np.append(begin, r)).tolist())


def asked(docs: DataFrame, hits: DataFrame, kind: Bytes | Words) -> DataFrame:
    """(h, id, th, start, content) of the runs that the index has to see; a run of a heavy anchor comes in parts.

    A row repeated in several partitions gives its runs once in each of them; whoever compares them sorts and skips."""
    wants = hits.where("ask").groupBy("id", "th").agg(F.collect_set(F.struct("start", "r", "h", "heavy")).alias("wants"))
    wants = wants.select(F.col("id").alias("sid"), F.col("th").alias("sth"), "wants")
    keyed = row_key(docs)
    both = keyed.join(wants.hint("merge"), keyed.id.eqNullSafe(wants.sid) & (keyed.th == wants.sth)).select("id", "th", "text", "wants")
    schema = pa.schema([("h", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("start", pa.int64()), ("content", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids, ths, wants = (batch.column(i).to_pylist() for i in (0, 1, 3))
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(2)):
                items, first, content = kind.items(raw, offsets)
                g = grams(items, kind.gram) if any(w["heavy"] for some in wants[a:b] for w in some) else None
                out: tuple[list, ...] = ([], [], [], [], [])
                for i in range(a, b):
                    if (ids[i], ths[i]) == last:
                        continue
                    last = (ids[i], ths[i])
                    base = int(first[i - a])
                    for w in wants[i]:
                        parts = _second(kind, g, base + w["start"], w["r"], w["h"]) if w["heavy"] else ((w["h"], 0, w["r"]),)
                        for h, x, r in parts:
                            at = w["start"] + x
                            for k, v in zip(out, (h, ids[i], ths[i], at, content(base + at, base + at + r - 1))):
                                k.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema)

    return both.mapInArrow(work, "h long, id long, th long, start long, content binary")
