"""What the operators of this subpackage share: reading, written intermediates, vectorised words and grams.

Texts are handled as UTF-8 bytes in numpy, many documents at a time ("slabs"), so that short
documents do not cost a Python call each.  A word is a run of bytes other than 0x20 and 0x09-0x0D.
"""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLAB_BYTES, ROWS = 1 << 20, 1000
POS_BITS = np.uint64(30)
POS_MASK = np.uint64((1 << 30) - 1)
WORD = r"[^\x20\x09-\x0D]+"

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = _rng.integers(1, 1 << 63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_HIGH_SEED = np.uint64(0x9E3779B97F4A7C15)
_K1, _K2, _K3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93))


def shared_folder(spark: SparkSession) -> str:
    """A new folder that the driver and every executor see: under spark.checkpoint.dir, or, where that is unset
    and the master is local (as in tests), under the temporary folder; on a cluster it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and every executor see")
        root = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """df written as Parquet to the shared folder and read back: cuts lineage, survives a lost executor."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.written_to = path
    return back


def discard(*frames: DataFrame) -> None:
    """Removes what `written` wrote for frames that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Lets go of the shuffle files of frames that nothing refers to any more: Spark removes them when its driver collects garbage."""
    gc.collect()
    time.sleep(1.5)  # the thread that passes on what Python has dropped looks once a second
    for _ in range(2):  # what the first run finds may hold more
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def small_batches(df: DataFrame) -> DataFrame:
    """df, with Python workers of its session getting at most `ROWS` rows at once: rows here are whole texts, and Spark's
    10,000 of them are tens of MB, held by the JVM and the worker alike."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name, "10000")) <= ROWS:
        conf.set(name, str(ROWS))
    return df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def slabs(ids: pa.Array, texts: pa.Array, limit: int = SLAB_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows; a null text is empty. A row over `limit` is a slab alone."""
    if len(texts) == 0:
        return
    big = pc.fill_null(texts.cast(pa.large_string()), "")
    _, off_buf, data = big.buffers()
    offsets = np.frombuffer(off_buf, np.int64)[big.offset : big.offset + len(big) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a, n = 0, len(big)
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x *= _K1
    x ^= x >> np.uint64(27)
    x *= _K2
    x ^= x >> np.uint64(31)
    return x


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of two neighbouring hashes, not symmetric."""
    x = a * _K1 + ((b << np.uint64(23)) | (b >> np.uint64(41))) * _K3
    x ^= x >> np.uint64(29)
    x *= _K2
    x ^= x >> np.uint64(32)
    return x


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n items from each position on; shorter than h by n - 1."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out, have, step, size = None, 0, h, 1
    while True:
        if n & size:
            if out is None:
                out, have = step, size
            else:
                m = len(h) - have - size + 1
                out, have = pair(out[:m], step[have : have + m]), have + size
        size *= 2
        if size > n:
            return out
        step = pair(step[: len(step) - size // 2], step[size // 2 :])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of the w items from each position on."""
    if len(x) < w:
        return x[:0]
    size = 1
    while size * 2 <= w:
        x = np.minimum(x[: len(x) - size], x[size:])
        size *= 2
    rest = w - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def byte_hashes(raw: np.ndarray) -> np.ndarray:
    return _BYTE[raw]


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end (in bytes) of each word of a slab, and the first word of each document (with the end)."""
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    ink = ~_SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    starts = ink.copy()
    starts[1:] &= ~ink[:-1] | edge[1:-1]
    ends = ink
    ends = ends.copy()
    ends[:-1] &= ~ink[1:] | edge[1:-1]
    s = np.flatnonzero(starts)
    e = np.flatnonzero(ends) + 1
    return s, e, np.searchsorted(s, offsets)


def word_hashes(raw: np.ndarray, s: np.ndarray, e: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hash of each word's bytes; with `lower`, of the word with A-Z lower-cased."""
    if not len(s):
        return np.zeros(0, np.uint64)
    if lower:
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
    length = e - s
    total = np.cumsum(length)
    out, a = np.empty(len(s), np.uint64), 0
    while a < len(s):  # about a slab's bytes at a time, whatever the length of the text
        b = max(a + 1, int(np.searchsorted(total, total[a] - length[a] + SLAB_BYTES, "right")))
        n = length[a:b]
        begin = np.cumsum(n) - n
        inner = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(begin, n)
        value = _BYTE[raw[inner + np.repeat(s[a:b], n)]] * _LOW[inner & 1023]
        if int(n.max()) > 1024:
            high = np.cumprod(np.full((int(n.max()) >> 10) + 1, _HIGH_SEED))
            value *= high[inner >> 10]
        out[a:b] = np.add.reduceat(value, begin)
        a = b
    return mix(out ^ (length.astype(np.uint64) << np.uint64(40)))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def row_key(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, text): rows alike in id and text share a key and count as one document."""
    return small_batches(df).select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
