"""N-gram Jaccard join by a token-group matrix.

A document is the set of its distinct word shingles (64-bit hashes).  Two documents link when
100 * |intersection| >= threshold * |union|, in whole numbers.  The join runs in three steps:

1. Which sets can have a partner at all.  Sizes fall into classes, wide enough that the sizes of linked sets are in
   one or in two neighbouring ones; a set takes part in its own class and, as the larger of a pair, in the one
   below.  In a class, linked sets differ in h tokens at most.  The range of hashes is cut into h + 1 + s parts, so
   s + 1 parts at least are alike in both.  A first pass counts parts by their hash alone, added up in each task
   before the shuffle; a second one emits (part, document) and keeps the parts found twice.  By one order of all
   parts, the more frequent first, each set then drops its first s: the last of the s + 1 common parts stays in
   both.  So phrases that many texts have in common make no candidates, and no pair has been made yet.
2. Sets of a class that still share a part hang together (stars around the least, then components).  No link
   leaves such a cluster.
3. Within a cluster, similar sets form groups; the token-group matrix has the groups that hold each token.
   For a query set it bounds the overlap with every group's union; only groups that reach the needed overlap
   are opened, and only members not yet in the query's component are compared.  Output is a spanning forest
   of links.  A cluster over `CAP` tokens is cut into blocks, and each pair of blocks is a task of its own.

Sets that are equal within a task are collapsed before step 1 (each keeps a link to the first).
Both passes read docs; like any recomputed frame it has to give the same partitions each time.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, grams, mix, pair, release, row_key, signed, slabs, word_hashes, words, written
from plumbline.llm.components import components

#: Tokens of a cluster that one task takes, sets of a group, sets that a task remembers, parts added up at once, and
#: bytes of text taken at once.
CAP, GROUP, MEMO, LOT, SLAB = 1 << 22, 32, 1 << 19, 1 << 19, 1 << 18


def need(n: int, threshold: int) -> int:
    """Least overlap of a set of n tokens with any set linked to it."""
    return -(-threshold * n // 100)


@lru_cache(maxsize=8)
def size_classes(threshold: int, most: int = 1 << 31) -> tuple[list[int], list[int]]:
    """The least size of each class, and the most tokens that a linked pair whose smaller set is of the class differs in."""
    least = [1]
    while least[-1] <= most:
        least.append(100 * least[-1] // threshold + 1)
    return least, [(top - 1) * (100 - threshold) // threshold for top in least[1:]]


def parts(t: np.ndarray, threshold: int) -> list[tuple[int, np.ndarray, int]]:
    """(class, hashes of its parts, how many of the most frequent it may drop) of a sorted set, for its own class and
    the one below.  Empty parts count as the most frequent, the last ones first, and are the first to be dropped."""
    least, differ = size_classes(threshold)
    own, out = bisect_right(least, len(t)) - 1, []
    for c in range(max(0, own - 1), own + 1):
        slack = differ[c] // 4 + 1 if differ[c] else 0
        m = differ[c] + 1 + slack
        of = (t >> np.uint64(32)) * np.uint64(m) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        j, value = of[first], np.add.reduceat(mix(t), first)
        drop = slack - (m - len(j))
        if drop < 0:
            empty = np.setdiff1d(np.arange(m, dtype=np.uint64), j)[:-slack or None]
            j, value = np.concatenate([j, empty]), np.concatenate([value, np.zeros(len(empty), np.uint64)])
        out.append((c, pair(mix(j + np.uint64((c + 1) << 32)), value), max(0, drop)))
    return out


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each document of a slab; fewer words than `size` are one shingle."""
    s, e, first = words(raw, offsets)
    h = word_hashes(raw, s, e, lower=True)
    g = grams(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(g[a : b - size + 1]))
        elif b > a:
            x = np.array([b - a], np.uint64)
            for w in h[a:b]:
                x = pair(x, w[None] if w.shape else np.array([w]))
            out.append(mix(x))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


class Firsts:
    """The first document of each set that a task remembers."""

    def __init__(self) -> None:
        self.seen: dict[int, tuple] = {}

    def of(self, t: np.ndarray, me: tuple) -> tuple:
        if not len(t):
            return me
        if len(self.seen) >= MEMO:
            self.seen.clear()
        return self.seen.setdefault(xxhash.xxh3_128_intdigest(t.tobytes()), me)


def _counts(size: int, threshold: int):
    """A row for each document, and (part, times) of the parts of first documents, added up."""
    schema = pa.schema([("part", pa.int64()), ("times", pa.int64()), ("id", pa.int64()), ("th", pa.int64()), ("n", pa.int64()), ("id0", pa.int64()), ("th0", pa.int64())])

    def added(lot: list[np.ndarray]) -> pa.RecordBatch:
        part, times = np.unique(np.concatenate(lot), return_counts=True)
        none = pa.nulls(len(part), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(signed(part)), pa.array(times.astype(np.int64)), none, none, none, none, none], schema=schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lot, held = Firsts(), [], 0
        for batch in batches:
            keys, ids, ths = (batch.column(k).to_pylist() for k in range(3))
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(3), SLAB):
                rows = []
                for i, t in zip(range(a, b), shingle_sets(raw, offsets, size)):
                    me = (ids[i], ths[i])
                    first = firsts.of(t, me)
                    if len(t) and first is me:
                        for _, p, _ in parts(t, threshold):
                            lot.append(p)
                            held += len(p)
                    rows.append((keys[i], 1, *me, len(t), *first))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                if held >= LOT:
                    yield added(lot)
                    lot, held = [], 0
        if lot:
            yield added(lot)

    return work


def _parts(size: int, threshold: int):
    """(part, key, drop) of first documents; drop is twice the number of parts it may drop, and 1 more in its own class."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = Firsts()
        for batch in batches:
            keys, ids, ths = (batch.column(k).to_pylist() for k in range(3))
            for a, b, raw, offsets in slabs(batch.column(0), batch.column(3), SLAB):
                found, owner, drops, many = [], [], [], []
                for i, t in zip(range(a, b), shingle_sets(raw, offsets, size)):
                    me = (ids[i], ths[i])
                    if len(t) and firsts.of(t, me) is me:
                        for k, (_, p, drop) in enumerate(reversed(parts(t, threshold))):
                            found.append(p)
                            owner.append(keys[i])
                            drops.append(2 * drop + 1 - k)
                            many.append(len(p))
                if found:
                    key, drop = np.repeat(np.array(owner, np.int64), many), np.repeat(np.array(drops, np.int32), many)
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(found))), pa.array(key), pa.array(drop)], names=["part", "key", "drop"])

    return work


def link_forest(sets: list[np.ndarray], threshold: int, group: int = GROUP) -> list[tuple[int, int]]:
    """Links (pairs of positions) that span every component of the sets, each sorted and distinct; empty ones have none."""
    order = sorted((i for i, t in enumerate(sets) if len(t)), key=lambda i: (tuple(sets[i][:4].tolist()), len(sets[i])))
    if len(order) < 2:
        return []
    links, kept, same = [], [], {}
    for i in order:
        j = same.setdefault(sets[i].tobytes(), i)
        if j != i:
            links.append((i, j))
        else:
            kept.append(i)
    order, k = kept, len(kept)
    size = np.fromiter((len(sets[i]) for i in order), np.int64, k)
    begin = np.cumsum(size) - size
    _, token = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    of = np.repeat(np.arange(k), size) // group
    n_groups = (k - 1) // group + 1
    cells = np.unique(token.astype(np.int64) * n_groups + of)  # the token-group matrix, by token
    row = np.searchsorted(cells, np.arange(int(token.max()) + 2) * n_groups)
    column = cells % n_groups
    width = np.diff(row)
    flag = np.zeros(int(token.max()) + 1, bool)
    label, members = np.arange(k), {i: [i] for i in range(k)}
    for q in range(k):
        mine = token[begin[q] : begin[q] + size[q]]
        w = width[mine]
        at = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w) + np.repeat(row[mine], w)
        bound = np.bincount(column[at], minlength=n_groups)
        least = need(int(size[q]), threshold)
        opened = np.flatnonzero(bound[: q // group + 1] >= least)
        if not opened.size:
            continue
        flag[mine] = True
        for g in opened.tolist():
            x, y = g * group, min((g + 1) * group, q)
            if y <= x or (label[x:y] == label[q]).all():
                continue
            inter = np.add.reduceat(flag[token[begin[x] : begin[y - 1] + size[y - 1]]].astype(np.int64), begin[x:y] - begin[x])
            for m in (np.flatnonzero(100 * inter >= threshold * (size[x:y] + size[q] - inter)) + x).tolist():
                if label[m] != label[q]:
                    links.append((order[q], order[m]))
                    big, small = sorted((int(label[m]), int(label[q])), key=lambda z: -len(members[z]))
                    label[members[small]] = big
                    members[big] += members.pop(small)
        flag[mine] = False
    return links


def _links(size: int, threshold: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        sets: list[np.ndarray] = []
        of: tuple | None = None

        def found() -> pa.RecordBatch:
            pairs = [(*keys[i], *keys[j]) for i, j in link_forest(sets, threshold)]
            return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in range(4)], names=["id", "th", "id0", "th0"])

        for batch in batches:
            tasks, ids, ths = (batch.column(k).to_pylist() for k in range(3))
            for a, b, raw, offsets in slabs(batch.column(1), batch.column(3), SLAB):
                for i, tokens in zip(range(a, b), shingle_sets(raw, offsets, size)):
                    if tasks[i] != of:
                        if len(keys) > 1:
                            yield found()
                        keys, sets, of = [], [], tasks[i]
                    keys.append((ids[i], ths[i]))
                    sets.append(tokens)
        if len(keys) > 1:
            yield found()

    return work


def _candidates(keyed: DataFrame, size: int, threshold: int) -> tuple[DataFrame, DataFrame]:
    """(documents (key, id, th, n, id0, th0, rows), edges (a, b) between keys whose sets share a part that both keep); `rows`
    is how many rows alike in id and text a task held, so their sum does not depend on how rows are dealt."""
    spark = keyed.sparkSession
    alike = ["part", "id", "th", "n", "id0", "th0"]
    counted = keyed.mapInArrow(_counts(size, threshold), "part long, times long, id long, th long, n long, id0 long, th0 long").repartition("part")
    counted = written(counted.groupBy(*alike).agg(F.sum("times").alias("times")).where("n is not null or times > 1"))
    release(spark)
    documents = counted.where("n is not null").withColumnRenamed("part", "key").withColumnRenamed("times", "rows")
    twice = counted.where("n is null").select("part", "times")
    rows = written(keyed.mapInArrow(_parts(size, threshold), "part long, key long, drop int").join(twice, "part"))
    release(spark)
    order = Window.partitionBy("key", F.col("drop") % 2).orderBy(F.desc("times"), "part")
    kept = written(rows.withColumn("at", F.row_number().over(order)).where("at > drop div 2").select("part", "key"))
    discard(rows)
    least = written(kept.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least != most").select("part", "least"))
    return documents, kept.join(least, "part").where("key != least").select(F.col("key").alias("a"), F.col("least").alias("b"))


def linked(docs: DataFrame, size: int = 5, threshold: int = 80) -> tuple[DataFrame, DataFrame]:
    """(documents (id, th, n, rows), links (id, th, id0, th0)); the links span every component, and `rows` adds up to the rows
    alike in id and text.

    A key is a hash of id and text hash; documents whose keys are equal by chance are compared by their texts as well."""
    keyed = row_key(docs).select(F.xxhash64("id", "th").alias("key"), "id", "th", "text").sortWithinPartitions("id", "th")
    documents, edges = _candidates(keyed, size, threshold)
    copies = documents.where("not (id <=> id0 and th = th0)").select("id", "th", "id0", "th0")
    members = written(components(edges).select(F.col("v").alias("key"), "label").join(documents.groupBy("key").agg(F.max("n").alias("n")), "key"))
    blocks = members.groupBy("label").agg(F.sum("n").alias("total")).select("label", F.ceil(F.col("total") * 2 / CAP).cast("int").alias("blocks"))
    blocks = blocks.withColumn("blocks", F.when(F.col("blocks") <= 2, 1).otherwise(F.col("blocks")))
    dealt = members.join(written(blocks), "label").withColumn("mine", F.pmod(F.xxhash64("key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    task = F.struct("label", F.least("mine", F.col("other").cast("long")).alias("x"), F.greatest("mine", F.col("other").cast("long")).alias("y")).alias("task")
    held = keyed.join(dealt.select(task, "key").hint("merge"), "key").select("task", "id", "th", "text")  # texts take less room than their shingles
    found = held.repartition("task").sortWithinPartitions("task").mapInArrow(_links(size, threshold), "id long, th long, id0 long, th0 long")
    return documents.select("id", "th", "n", "rows"), copies.unionByName(found)


def classes(docs: DataFrame, size: int = 5, threshold: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, text_hash, is_first): component_id is the least doc_id reachable over links, itself
    included; is_first marks the one document of each component that is least by id (null before others) and text hash.

    Null, empty and blank texts have no shingles and link with nothing.  Rows alike in doc_id and text are one
    document (each gets a row).  A null doc_id takes part; it names a component only if all ids in it are null.  A very
    long text is a set of many shingles, in one task.  Further columns play no part, whatever their names.
    """
    documents, links = linked(docs, size, threshold)
    parts = components(links.select(F.struct("id", "th").alias("a"), F.struct(F.col("id0").alias("id"), F.col("th0").alias("th")).alias("b")))
    least = written(parts.groupBy("label").agg(F.min("v.id").alias("component"), F.min("v").alias("head")))
    head = F.col("v.id").eqNullSafe(F.col("head.id")) & (F.col("v.th") == F.col("head.th"))
    parts = parts.join(least, "label").select(F.col("v.id").alias("cid"), F.col("v.th").alias("cth"), "component", head.alias("first"))
    joined = documents.join(parts, documents.id.eqNullSafe(parts.cid) & (documents.th == parts.cth), "left")
    joined = joined.withColumn("_k", F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))))
    return joined.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id"), F.col("th").alias("text_hash"), F.coalesce("first", F.lit(True)).alias("is_first"))


def brute(rows: list[tuple[int, str | None]], size: int = 4, threshold: int = 85) -> dict[int, tuple[int, int]]:
    """The same by all pairs, for tests."""
    import re

    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    root = {i: i for i in sets}
    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= threshold * len(sets[x] | sets[y]) and root[x] != root[y]:
                a, b = sorted((root[x], root[y]))
                root = {k: a if v == b else v for k, v in root.items()}
    return {i: (len(sets[i]), root[i]) for i in ids}
