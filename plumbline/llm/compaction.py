"""Sharding by size-tiered compaction.

A store is a folder with immutable Parquet shards and numbered manifests.  `append` writes arrivals as small
shards; `compact` merges every run of shards of one size tier into files of the target size; both end by
committing the next manifest: a JSON file is written whole under another name and then given its number by an
operation that fails if that number exists (a hard link on a local disk, a rename without overwriting or an exclusive
creation elsewhere), so a version has one writer, and readers see old or new, never a mix.  A writer that comes second
commits again on top of what the first has committed: arrivals always can, a merge can while all shards that it has read are
still named.  Shards that a version names stay until
`vacuum` removes the version, so readers of recent versions go on; shards that no manifest names (a job that died)
go then as well, once they are older than a day.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_folder

TARGET_BYTES, FANOUT = 128 << 20, 4
#: Times that a writer commits again after others were first.
TRIES = 50
#: How a manifest gets its number, by the scheme of the store.
PUBLISHING = {"file": "link", "hdfs": "rename", "viewfs": "rename", "webhdfs": "rename", "gs": "create"}


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


class Store:
    """`publishing` says how a manifest gets its number: link, rename (where that does not overwrite) or create (where a
    file appears whole when it is closed, and creating one that exists fails, as on object stores with conditional writes);
    by default what PUBLISHING has for the store."""

    def __init__(self, spark: SparkSession, root: str, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, publishing: str | None = None) -> None:
        self.spark, self.root, self.target, self.fanout = spark, root.rstrip("/"), target_bytes, fanout
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        scheme = self._fs.getUri().getScheme()
        self._publishing = publishing or PUBLISHING.get(scheme)
        if self._publishing not in ("link", "rename", "create"):
            raise ValueError(f"name the way in which {scheme} gives a file its name once: link, rename or create")

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))

    def versions(self) -> list[int]:
        if not self._fs.exists(self._path("manifests")):
            return []
        return sorted(int(n[1:-5]) for f in self._fs.listStatus(self._path("manifests")) if (n := f.getPath().getName()).startswith("v"))

    def manifest(self, version: int | None = None) -> dict:
        """The shards (name, bytes) of a version, the newest by default; version 0 is empty."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return {"version": 0, "shards": []}
        stream = self._fs.open(self._path(f"manifests/v{version}.json"))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, base: int, shards: list[dict]) -> dict:
        manifest = {"version": base + 1, "shards": sorted(shards, key=lambda s: s["name"])}
        final = self._path(f"manifests/v{base + 1}.json")
        self._fs.mkdirs(self._path("manifests"))
        try:
            self._publish(json.dumps(manifest).encode(), final)
        except Exception as e:
            if self._fs.exists(final):
                raise CommitConflict(f"version {base + 1} exists") from e
            raise
        return manifest

    def _put(self, content: bytes, path) -> None:
        out = self._fs.create(path, False)
        out.write(bytearray(content))
        out.close()

    def _publish(self, content: bytes, final) -> None:
        """Writes a file under its final name, whole and only if that name is free."""
        if self._publishing == "create":
            return self._put(content, final)
        temporary = self._path(f"manifests/.{uuid.uuid4().hex}")
        self._put(content, temporary)
        try:
            if self._publishing == "link":
                local = [self._jvm.java.io.File(p.toUri().getPath()).toPath() for p in (final, temporary)]
                self._jvm.java.nio.file.Files.createLink(*local)
            elif not self._fs.rename(temporary, final):
                raise FileExistsError(str(final))
        finally:
            self._fs.delete(temporary, False)

    def _change(self, change: Callable[[list[dict]], list[dict]]) -> dict:
        """Commits what `change` makes of the newest version's shards, again on top of those of others who were first."""
        for k in range(TRIES):
            base = self.manifest()
            shards = change(base["shards"])
            try:
                return self._commit(base["version"], shards)
            except CommitConflict:
                if k == TRIES - 1:
                    raise
                time.sleep(random.uniform(0, 0.05 * min(k + 1, 10)))

    def _write(self, df: DataFrame) -> list[dict]:
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{folder}")
        files = self._fs.listStatus(self._path(folder))
        return [{"name": f"{folder}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().startswith("part-")]

    def append(self, df: DataFrame) -> dict:
        """One small shard for each task of df."""
        new = self._write(df)
        return self._change(lambda shards: shards + new)

    def append_arrivals(self, df: DataFrame, arrival: str) -> dict:
        """The rows of each value of a column as an arrival of its own, in order; all are written in one pass."""
        folder = f"shards/{uuid.uuid4().hex}"
        df.write.partitionBy(arrival).parquet(f"{self.root}/{folder}")
        parts = sorted(f.getPath().getName() for f in self._fs.listStatus(self._path(folder)) if f.isDirectory())
        for part in parts:
            files = self._fs.listStatus(self._path(f"{folder}/{part}"))
            new = [{"name": f"{folder}/{part}/{f.getPath().getName()}", "bytes": f.getLen()} for f in files if f.getPath().getName().startswith("part-")]
            self._change(lambda shards, new=new: shards + new)
        return self.manifest() if parts else self.append(df.drop(arrival))

    def tier(self, size: int) -> int:
        """0 for shards of about the target size, 1 for a fanout-th of it, and so on down."""
        return max(0, math.ceil(math.log(self.target / max(size, 1), self.fanout) - 0.5))

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Shards to merge: of each tier below the target, those that hold `fanout` or more together."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [run for t, run in sorted(tiers.items()) if t > 0 and len(run) >= self.fanout]

    def compact(self) -> dict:
        """Merges until no tier has a run; a merge reads each of its shards once and shuffles nothing.  Arrivals that are
        committed meanwhile stay; where another has merged the same shards, this one's work is dropped with a CommitConflict."""
        base = self.manifest()
        shards = base["shards"]
        moved = True
        while moved:
            moved = False
            for run in self.runs(shards):
                n = max(1, round(sum(s["bytes"] for s in run) / self.target))
                if n >= len(run):
                    continue
                merged = self._write(self.read(run).coalesce(n))
                names = {s["name"] for s in run}
                shards = [s for s in shards if s["name"] not in names] + merged
                moved = True
        was, stay = {s["name"] for s in base["shards"]}, {s["name"] for s in shards}
        gone, new = was - stay, [s for s in shards if s["name"] not in was]
        if not gone:
            return base

        def merged(now: list[dict]) -> list[dict]:
            if gone - {s["name"] for s in now}:
                raise CommitConflict("another writer has merged the same shards")
            return [s for s in now if s["name"] not in gone] + new

        return self._change(merged)

    def vacuum(self, keep: int = 2, older_than: float = 86_400.0) -> list[str]:
        """Removes all but the last `keep` versions, and shards that none of those names and that are older than so many
        seconds (a writer may not have committed younger ones yet); the names of the shards that went."""
        versions = self.versions()
        named = {s["name"] for v in versions[-keep:] for s in self.manifest(v)["shards"]}
        before, gone = {s["name"] for v in versions[:-keep] for s in self.manifest(v)["shards"]}, []
        files, now = self._fs.listFiles(self._path("shards"), True), time.time()
        while files.hasNext():
            f = files.next()
            name = f.getPath().toString().split("/shards/", 1)[1]
            name = f"shards/{name}"
            if name not in named and (name in before or now - f.getModificationTime() / 1000 > older_than):
                self._fs.delete(f.getPath(), False)
                gone.append(name)
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"manifests/v{v}.json"), False)
        return gone

    def read(self, shards: list[dict] | None = None) -> DataFrame:
        shards = self.manifest()["shards"] if shards is None else shards
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.root}/{s['name']}" for s in shards])


def sharded(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES, fanout: int = FANOUT, root: str | None = None) -> tuple[Store, DataFrame]:
    """docs put into a new store in so many arrivals (by a hash of the whole row), then compacted; the store and its rows.

    All columns and rows stay as they are, whatever their names, nulls or repeats; an empty table gives a store
    with one empty shard.  A very long text is a row like any other; rows alike in all columns arrive together.
    """
    spark = docs.sparkSession
    store = Store(spark, root or shared_folder(spark), target_bytes, fanout)
    name = "arrival"
    while name in docs.columns:
        name += "_"
    store.append_arrivals(docs.withColumn(name, F.pmod(F.xxhash64(*docs.columns), F.lit(arrivals))), name)
    store.compact()
    return store, store.read()


def report(docs: DataFrame, arrivals: int = 4, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, n_bytes, text_sha256) of every row, read back from the shards of the committed manifest; a null text has no
    bytes and the digest of an empty one, repeated rows stay, further columns play no part."""
    _, rows = sharded(docs, arrivals, target_bytes)
    return rows.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE = "SELECT doc_id, coalesce(strlen(text), 0)::BIGINT AS n_bytes, sha256(coalesce(text, '')) AS text_sha256 FROM documents"
