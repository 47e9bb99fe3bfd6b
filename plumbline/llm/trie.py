"""Prefix trie of conversations, rolled up by pointer jumping.

A node is a distinct sequence of the first d turns; its key is a 128-bit digest, the exclusive or over its turns of a
hash of their place and content, so that a running window gives the keys of all prefixes of a conversation and the
key of the parent is the key without the last turn.  The rows of prefixes are reduced to nodes before any join.

Leaves and savings of subtrees: every node but the root has a pointer, to its parent at first.  In round k the nodes
of depth 2 ** k or more send what they have gathered to the node 2 ** k above them, and nodes of twice that depth then
move their pointers to where that node points.  What is sent to a node in all rounds, and its own, is its subtree.
Rounds are the logarithm of the greatest depth; what a round reads and writes is the nodes of its depth only.

Sums are combined in each task before they are shuffled; the join that moves pointers is of written tables, both
shuffled for it, so that Spark can split the children of a hot node.  Children of the root are never joined to it.
The members that end in a node are dealt by ranges of (node, member), so that those of a hot node are put in order in
many tasks; each makes text blocks, and one task digests the blocks of a node one after the other, as SHA-256 demands.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import discard, written

#: Conversations in a family, numbers of turns that a member may take from its first one, and ids of a block.
FAMILY, TURNS, BLOCK = 5, 9, 1 << 14


def _zero() -> F.Column:
    """Either half of the key of the root."""
    return F.lit(0).cast("long")


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, i, digest, bytes): turns with their place, from 1, in their conversation; by turn, null first, then digest."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")
    return rows.select("conv_id", F.row_number().over(order).alias("i"), "digest", "bytes")


def rebuilt(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations (conv_id), turns (conv_id, part, i, digest, bytes)): each conversation begins with the first h turns of
    the first of its family and goes on with its own after its first h; h is a checksum of its id."""
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS
    ids = rows.where("i = 1").select("conv_id")  # every conversation has a first turn
    own = rows.where(F.col("i") > h).select("conv_id", F.lit(1).alias("part"), "i", "digest", "bytes")
    heads = rows.where(F.col("i") < TURNS).select(F.col("conv_id").alias("first"), "i", "digest", "bytes")
    want = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"), h.alias("h"))
    taken = want.join(heads, "first").where("i <= h").select("conv_id", F.lit(0).alias("part"), "i", "digest", "bytes")
    return ids, taken.unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, pa, pb, bytes, ends): a row for each prefix of each conversation, with its key and that of its
    parent; `ends` marks the whole conversation."""
    order = Window.partitionBy("conv_id").orderBy("part", "i")
    rows = turns.withColumn("depth", F.row_number().over(order)).withColumn("ends", F.lead("i").over(order).isNull())
    rows = rows.withColumn("x", F.xxhash64("depth", "digest")).withColumn("y", F.xxhash64("digest", "depth"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("a", F.bit_xor("x").over(upto)).withColumn("b", F.bit_xor("y").over(upto))
    return rows.select("conv_id", "depth", "a", "b", F.when(F.col("depth") > 1, F.col("a").bitwiseXOR(F.col("x"))).otherwise(_zero()).alias("pa"), F.when(F.col("depth") > 1, F.col("b").bitwiseXOR(F.col("y"))).otherwise(_zero()).alias("pb"), "bytes", "ends")


def jumped(nodes: DataFrame, sums: list[str]) -> DataFrame:
    """(a, b, *sums) to be added up by key: of every node its own values and what its subtree sends to it.

    nodes has a, b, depth, pa, pb and the values; a node of depth 0 has no parent."""
    out = nodes.select("a", "b", *sums)
    active = written(nodes.where("depth > 0").select("a", "b", "depth", *sums, F.col("pa").alias("qa"), F.col("pb").alias("qb")))
    deepest, step = active.agg(F.max("depth")).first()[0] or 0, 1
    while step <= deepest:
        sent = written(active.groupBy("qa", "qb").agg(*[F.sum(s).alias(s) for s in sums]).select(F.col("qa").alias("a"), F.col("qb").alias("b"), *sums))
        out = out.unionByName(sent)
        if 2 * step > deepest:
            discard(active)
            break
        on = active.where(F.col("depth") >= 2 * step)
        got = sent.select("a", "b", *[F.col(s).alias(f"_{s}") for s in sums])
        on = on.join(got, ["a", "b"], "left").select("a", "b", "depth", *[(F.col(s) + F.coalesce(f"_{s}", F.lit(0))).alias(s) for s in sums], "qa", "qb")
        above = active.select(F.col("a").alias("qa"), F.col("b").alias("qb"), F.col("qa").alias("na"), F.col("qb").alias("nb"))
        moved = written(on.join(above.hint("merge"), ["qa", "qb"]).select("a", "b", "depth", *sums, F.col("na").alias("qa"), F.col("nb").alias("qb")))
        discard(active)
        active, step = moved, 2 * step
    return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of ids of one node, in order, as comma-joined texts."""
    of, ids, out = None, [], []

    def done() -> None:
        if ids:
            out.append((*of, ids[0], ",".join(map(str, ids))))

    for batch in batches:
        for a, b, c in zip(*(batch.column(k).to_pylist() for k in range(3))):
            if (a, b) != of or len(ids) >= BLOCK:
                done()
                of, ids = (a, b), []
            ids.append(c)
        if out:
            yield _batch(out, ("a", "b", "first", "block"))
            out = []
    done()
    if out:
        yield _batch(out, ("a", "b", "first", "block"))


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of the blocks of each node, in order."""
    of, sha, out = None, None, []
    for batch in batches:
        for a, b, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist()):
            if (a, b) == of:
                sha.update(b"," + text.encode())
                continue
            if of:
                out.append((*of, sha.hexdigest()))
            of, sha = (a, b), hashlib.sha256(text.encode())
        if out:
            yield _batch(out, ("a", "b", "ends_sha256"))
            out = []
    if of:
        yield _batch([(*of, sha.hexdigest())], ("a", "b", "ends_sha256"))


def _batch(rows: list[tuple], names: tuple[str, ...]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=list(names))


def ends_digests(ends: DataFrame) -> DataFrame:
    """(a, b, ends_sha256) from (a, b, conv_id): the digest of the ids of each key, ascending and comma-joined."""
    dealt = ends.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")
    blocks = dealt.mapInArrow(_blocks, "a long, b long, first long, block string")
    return blocks.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(_digests, "a long, b long, ends_sha256 string")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id) and their turns (conv_id, part, i, digest, bytes); columns as in `rollup`."""
    rows = written(prefixes(turns))
    ids = written(ids)
    nodes = rows.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.max("depth").cast("long").alias("depth"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    top = written(ids.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0"))  # one row
    none = F.lit(None).cast("long")
    root = top.select(_zero().alias("a"), _zero().alias("b"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", _zero().alias("bytes"), none.alias("pa"), none.alias("pb"))
    nodes = nodes.unionByName(root)
    # children are counted by the same shuffle that puts them beside their parents
    born = nodes.select("*", _zero().alias("n_children")).unionByName(nodes.where("depth > 0").groupBy("pa", "pb").agg(F.count("*").alias("n_children")).select(F.col("pa").alias("a"), F.col("pb").alias("b"), "n_children"), allowMissingColumns=True)
    carried = ["conv_id", "depth", "n_convs", "bytes", "pa", "pb"]
    nodes = written(born.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in carried], F.sum("n_children").alias("n_children")))
    values = nodes.withColumn("n_leaves", (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("bytes"))
    sums = jumped(values.select("a", "b", "depth", "pa", "pb", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    bare = ids.join(rows.where("depth = 1").select("conv_id"), "conv_id", "left_anti").select(_zero().alias("a"), _zero().alias("b"), "conv_id")
    ends = ends_digests(written(rows.where("ends").select("a", "b", "conv_id").unionByName(bare)))
    above = nodes.select(F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    parents = nodes.where("depth > 1").select("a", "b", "pa", "pb").join(above.hint("merge"), ["pa", "pb"]).select("a", "b", "parent_conv_id")
    first = nodes.where("depth = 1").select("a", "b").crossJoin(F.broadcast(top.select(F.col("conv_id").alias("parent_conv_id"))))  # one row
    own = nodes.select("a", "b", "conv_id", "depth", "n_convs", "n_children")
    every = own
    for part in (sums, ends, parents, first):
        every = every.unionByName(part, allowMissingColumns=True)
    keep = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children"]
    out = every.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in keep], F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.max("ends_sha256").alias("ends_sha256"))
    return out.select(*keep, "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def rollup(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie
    of the rebuilt conversations, from (conv_id, turn, role, text).

    A null role or text counts as an empty one, turns without a number come first, those that share one go by the md5 of
    length of role, role and text.  Rows without a conv_id take no part.  Repeated rows are turns of their own.
    Very long texts count by their digest and length; further columns play no part, whatever their names.  An empty
    table has no node, not even a root.  The turns of one conversation are numbered as a stream in one task.
    """
    ids, turns = rebuilt(written(numbered(conversations)))
    return trie(ids, turns)


ORACLE = """
WITH numbered AS (SELECT conv_id, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, strlen(coalesce(text, ''))::BIGINT AS bytes,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, ''))) AS i FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id FROM numbered),
crc AS (SELECT conv_id, conv_id - conv_id % 5 AS first, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT),
  lambda c, x: list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295::BIGINT) % 9 AS h FROM ids),
turns AS (SELECT c.conv_id, 0 AS part, n.i, n.digest, n.bytes FROM crc c JOIN numbered n ON n.conv_id = c.first AND n.i <= c.h
  UNION ALL SELECT c.conv_id, 1, n.i, n.digest, n.bytes FROM crc c JOIN numbered n ON n.conv_id = c.conv_id AND n.i > c.h),
placed AS (SELECT conv_id, digest, bytes, row_number() OVER w AS depth, lead(i) OVER w IS NULL AS ends FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY part, i)),
whole AS (SELECT conv_id, list(digest ORDER BY depth) AS digests FROM placed GROUP BY conv_id),
rows AS (SELECT p.conv_id, p.depth, p.bytes, p.ends, array_to_string(w.digests[1:p.depth], '') AS node, array_to_string(w.digests[1:p.depth - 1], '') AS parent FROM placed p JOIN whole w USING (conv_id)
  UNION ALL SELECT i.conv_id, 0, 0, w.conv_id IS NULL, '', NULL FROM ids i LEFT JOIN whole w USING (conv_id)),
nodes AS (SELECT node, min(parent) AS parent, min(conv_id) AS conv_id, max(depth)::BIGINT AS depth, count(*)::BIGINT AS n_convs, (count(*) - 1) * max(bytes) AS saved,
  sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM rows GROUP BY node),
family AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.parent = n.node) AS n_children FROM nodes n LEFT JOIN nodes p ON n.parent = p.node),
lines AS (SELECT f.n_children, f.saved, left(f.node, 32 * k) AS above FROM family f, LATERAL (SELECT unnest(range(0, f.depth + 1)) AS k)),
sums AS (SELECT above, count(*) FILTER (n_children = 0)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM lines GROUP BY above)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, s.n_leaves, s.saved_tokens, f.ends_sha256 FROM family f JOIN sums s ON s.above = f.node
"""


def brute(rows: list[tuple]) -> set[tuple]:
    """The same nodes from a list of (conv_id, turn, role, text), for tests."""
    import zlib

    own: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()
            own.setdefault(c, []).append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(ts)] for c, ts in own.items()}
    members: dict[tuple, list[int]] = {}
    ends: dict[tuple, list[int]] = {}
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % TURNS
        seq = tuple(own.get(c - c % FAMILY if c >= 0 else c + -c % FAMILY, [])[:h] + own[c][h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = set()
    for node, who in members.items():
        below = [m for m in members if m[: len(node)] == node]
        childless = [m for m in below if not any(x[:-1] == m for x in members if x)]
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        sha = hashlib.sha256(",".join(map(str, ends.get(node, []))).encode()).hexdigest()
        children = sum(1 for x in members if x and x[:-1] == node)
        out.add((who[0], len(node), members[node[:-1]][0] if node else None, len(who), children, len(childless), saved, sha))
    return out
