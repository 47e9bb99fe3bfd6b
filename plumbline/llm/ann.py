"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Inner products become distances by one more dimension (the root of the largest squared norm less one's own);
vectors are then rotated at random, so that a part of the dimensions estimates the whole distance.  Lists come
from k-means on a bounded sample, and so does the number of lists to probe: the least that holds the wanted part
of the nearest neighbours within the sample (those of all rows lie nearer, hence rather in fewer lists).  Every vector is put into its list, every query is sent to the lists nearest
to it.  In a list, candidates are scanned in blocks of columns: once the partial distance, scaled up, is so far
above the worst distance that still counts that a hypothesis test rejects the candidate, it is abandoned.  The
worst distance falls from one lot of candidates to the next, as nearer ones are found.

Equal vectors are one candidate (with its least ids), equal queries one query, and the candidates and the queries
of a long list are both cut into blocks, so that a task never has more than a block of each, and a vector that a
third of the rows share costs no more than another.  Equality of vectors is that of a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import written

#: Rows that k-means is fitted on at most; rows and queries of a block of a list; rows and queries scanned at once;
#: columns of a step; strictness of the test.
SAMPLE, BLOCK, ASKS, LOT, STEP, EPSILON = 20_000, 8192, 2048, 512, 16, 2.1
#: Part of the nearest within the sample that the probed lists must hold; queries of the sample that this is measured on.
COVER, TRIALS = 0.96, 200


def rotation(d: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c


def lift(x: np.ndarray, top: float) -> np.ndarray:
    """Candidates with the further dimension."""
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], axis=1)


def probes_needed(x: np.ndarray, centres: np.ndarray, turn: np.ndarray, top: float, k: int, cover: float = COVER, trials: int = TRIALS) -> int:
    """Lists to probe so that, over queries from a sample x, they hold the part `cover` of the k nearest within it."""
    c2 = (centres * centres).sum(1)
    near = np.argmin(c2 - 2 * (lift(x, top) @ turn) @ centres.T, axis=1)
    at = np.linspace(0, len(x) - 1, min(trials, len(x))).astype(int)
    q = np.concatenate([x[at], np.zeros((len(at), 1))], axis=1) @ turn
    place = np.argsort(np.argsort(c2 - 2 * q @ centres.T, axis=1), axis=1)
    score = x[at] @ x.T
    score[np.arange(len(at)), at] = -np.inf
    best = np.argsort(-score, axis=1)[:, : max(1, min(k, len(x) - 1))]
    ranks = np.take_along_axis(place, near[best], axis=1).ravel()
    return int(np.quantile(ranks, cover, method="higher")) + 1


def scan(queries: np.ndarray, block: np.ndarray, k: int, step: int = STEP, epsilon: float = EPSILON, lot: int = LOT) -> list[np.ndarray]:
    """For each rotated query, positions in the block of its k nearest (and of those as near as the last) that were not
    abandoned.  While a query has no k distances yet there is nothing to test against, and a lot is one matrix product;
    later the first columns of all its pairs are, and the others are looked at for the pairs that are left."""
    n, d = block.shape
    out: list[np.ndarray] = []
    for a in range(0, len(queries), lot):
        q = queries[a : a + lot]
        m = len(q)
        best = np.full((m, k), np.inf)
        rows, places, dists = [], [], []
        head = min(step, d)
        q2 = (q[:, :head] ** 2).sum(1)[:, None]
        for b in range(0, n, lot):
            x = block[b : b + lot]
            worst = best[:, -1]
            if not np.isfinite(worst).all():
                full = np.maximum((q**2).sum(1)[:, None] + (x**2).sum(1) - 2 * q @ x.T, 0)
                both = np.concatenate([best, full], axis=1)
                best = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
                i, j = np.nonzero(full <= best[:, -1:] * (1 + 1e-9) + 1e-12)
                rows.append(i)
                places.append(j + b)
                dists.append(full[i, j])
                continue
            part = np.maximum(q2 + (x[:, :head] ** 2).sum(1) - 2 * q[:, :head] @ x[:, :head].T, 0)
            bound = lambda seen: worst * (1 + epsilon / np.sqrt(seen)) ** 2
            i, j = np.nonzero(part * (d / head) <= bound(head)[:, None]) if head < d else np.nonzero(part <= np.inf)
            part = part[i, j]
            for c in range(head, d, step):
                e = min(c + step, d)
                diff = x[j, c:e] - q[i, c:e]
                part = part + np.einsum("ij,ij->i", diff, diff)
                ok = part * (d / e) <= bound(e)[i] if e < d else part <= worst[i] * (1 + 1e-9) + 1e-12
                i, j, part = i[ok], j[ok], part[ok]
            rows.append(i)
            places.append(j + b)
            dists.append(part)
            full = np.full((m, len(x)), np.inf)
            full[i, j] = part
            best = np.sort(np.partition(np.concatenate([best, full], axis=1), k - 1, axis=1)[:, :k], axis=1)
        i, j, dist = np.concatenate(rows), np.concatenate(places), np.concatenate(dists)
        good = dist <= best[i, -1] * (1 + 1e-9) + 1e-12
        i, j = i[good], j[good]
        order = np.argsort(i, kind="stable")
        out += np.split(j[order], np.searchsorted(i[order], np.arange(1, m)))
    return out


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col("v")
    rows = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v")).where("i is not null and v is not null")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return rows.where(fine)


def search(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", cover: float = COVER) -> DataFrame:
    """(query_id, rank, vec_id, score): of each row with an id divisible by `every`, the k nearest other rows found.

    Null ids and vectors that are null, zero or hold null or non-finite components take no part, nor do those
    of another length than the most frequent one.  Rows alike in id and vector count once; two vectors of one id are
    two candidates; of equal scores the smaller vec_id comes first.  Further columns play no part.
    """
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    sizes = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return spark.createDataFrame([], schema)
    d = sizes[0].d
    rows = rows.where(F.size("v") == d).dropDuplicates(["i", "v"])
    by_id = Window.partitionBy("v").orderBy("i")
    own = rows.withColumn("at", F.row_number().over(by_id)).where(F.col("at") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list("i")).alias("ids"))
    own = written(own.select(F.xxhash64("v").alias("key"), "v", "ids"))
    asks = rows.where(F.pmod("i", F.lit(every)) == 0).select(F.col("i").alias("query_id"), F.xxhash64("v").alias("key"), "v")
    n, top = own.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    least = F.xxhash64("key")
    bound = -(1 << 63) + min((1 << 64) - 1, (1 << 64) * 5 * (SAMPLE + 100) // (4 * n))  # what tasks send does not grow with their number
    sample = np.array([r.v for r in own.where(least <= bound).orderBy(least).select("v").limit(SAMPLE).collect()])
    turn = rotation(d + 1)
    lists = int(min(max(1, round(n**0.5)), max(1, len(sample) // 20), 4096))
    centres = kmeans(lift(sample, top) @ turn, lists)
    probes = probes_needed(sample, centres, turn, top, k, cover)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c2 = (centres * centres).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            near = np.argmin(c2 - 2 * (lift(x, top) @ turn) @ centres.T, axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], names=["key", "v", "ids", "list"])

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c2 = (centres * centres).sum(1)
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            x = np.concatenate([x, np.zeros((len(x), 1))], axis=1) @ turn
            near = np.argpartition(c2 - 2 * x @ centres.T, probes - 1, axis=1)[:, :probes]
            at = pa.array(np.repeat(np.arange(len(x)), probes))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(1).take(at), pa.array(near.ravel().astype(np.int32))], names=["key", "v", "list"])

    placed = written(own.mapInArrow(place, "key long, v array<double>, ids array<long>, list int"))
    sent = written(own.join(asks.select("key").distinct(), "key", "left_semi").select("key", "v").mapInArrow(send, "key long, v array<double>, list int"))

    def dealt(rows: DataFrame, others: DataFrame, mine: tuple[str, int], theirs: tuple[str, int]) -> DataFrame:
        """Each row in one block of its own kind, and in all blocks of the other kind, of its list."""
        for df, (name, size) in ((rows, mine), (others, theirs)):
            count = df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(f"{name}s"))
            rows = rows.join(F.broadcast(count), "list")  # a row for each of at most 4096 lists
        rows = rows.withColumn(mine[0], F.pmod(F.xxhash64("key"), F.col(f"{mine[0]}s")).cast("int"))
        return rows.withColumn(theirs[0], F.explode(F.sequence(F.lit(0), F.col(f"{theirs[0]}s") - 1)))

    row_blocks, ask_blocks = ("block", BLOCK), ("asked", ASKS)
    left = dealt(sent, placed, ask_blocks, row_blocks)
    right = dealt(placed, sent, row_blocks, ask_blocks)

    def near(queries: pd.DataFrame, block: pd.DataFrame) -> pd.DataFrame:
        found: dict[str, list] = {"key": [], "ids": [], "score": []}
        if len(queries) and len(block):
            q, x = np.stack(queries.v.to_numpy()), np.stack(block.v.to_numpy())
            r = np.concatenate([q, np.zeros((len(q), 1))], axis=1) @ turn
            ids = block.ids.to_numpy()
            for i, at in enumerate(scan(r, lift(x, top) @ turn, k + 1)):
                score = (x[at] * q[i]).sum(1)
                for s, p in sorted(zip(score.tolist(), at.tolist()), key=lambda z: (-z[0], ids[z[1]][0]))[: k + 1]:
                    found["key"].append(queries.key.iloc[i])
                    found["ids"].append(ids[p])
                    found["score"].append(s)
        return pd.DataFrame({k: pd.Series(v, dtype="object" if k == "ids" else "float64" if k == "score" else "int64") for k, v in found.items()})

    task = ["list", "block", "asked"]
    pairs = left.select(*task, "key", "v").groupBy(*task).cogroup(right.select(*task, "v", "ids").groupBy(*task)).applyInPandas(near, "key long, ids array<long>, score double")
    best = Window.partitionBy("key").orderBy(F.desc("score"), F.col("ids")[0])
    pairs = pairs.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    last = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    pairs = pairs.select("key", F.explode("ids").alias("vec_id"), "score").withColumn("at", F.row_number().over(last)).where(F.col("at") <= k + 1).select("key", "vec_id", "score")
    out = asks.select("query_id", "key").distinct().join(pairs, "key").where("query_id != vec_id")
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", F.col("rank").cast("int"), F.col("vec_id").cast("long"), "score")


def brute(rows: list[tuple], k: int = 20, every: int = 20) -> dict[int, list[tuple[int, float]]]:
    """The exact answer, for tests."""
    good = [(i, np.array(v, float)) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    x = np.stack([v for _, v in good])
    out = {}
    for i, v in good:
        if i % every == 0:
            s = (x * v).sum(1).tolist()
            out[i] = sorted(((j, t) for (j, _), t in zip(good, s) if j != i), key=lambda z: (-z[1], z[0]))[:k]
    return out
