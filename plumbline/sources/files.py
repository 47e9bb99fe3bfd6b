"""Tables from and to files: delimited text, Parquet, JSON configuration, run-keyed stores, manifests."""

from __future__ import annotations

import csv
import hashlib
import json
import posixpath
import re
from pathlib import Path

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.clean import MISSING, pooled, subset
from plumbline.operators.metrics import all_metrics
from plumbline.sources import sheets

#: Folds up to which their list is broadcast.
FEW = 4096

def confined(root: str, name: str) -> str:
    """root/name, normalised; a name that leads outside the root is an error.  Of a root on another store, such as
    s3a://bucket/folder, the scheme and the store's name stay as they are."""
    store, top = re.match(r"([A-Za-z][A-Za-z0-9+.-]*://[^/]*)?(.*)", root, re.S).groups()
    top = posixpath.normpath(top or ("/" if store else "."))
    if "://" in name:
        raise ValueError(f"{name!r} leads outside {root!r}")
    path = posixpath.normpath(posixpath.join(top, name))
    inside = path == top or path.startswith(top.rstrip("/") + "/") or (top == "." and not path.startswith(("/", "..")))
    if not inside:
        raise ValueError(f"{name!r} leads outside {root!r}")
    return (store or "") + path


def there(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any store that Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _typed(df: DataFrame) -> DataFrame:
    """Columns of text to long or double where every value that is not missing has that type; one pass over the data."""
    clean = df.select(*[F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")).alias(c) for c in df.columns])
    if not clean.columns:
        return clean
    bad = clean.agg(*[F.struct(F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS BIGINT)").isNull()).alias("l"), F.count_if(F.col(f"`{c}`").isNotNull() & F.expr(f"try_cast(`{c}` AS DOUBLE)").isNull()).alias("d")).alias(f"c{k}") for k, c in enumerate(clean.columns)]).first()
    kinds = ["bigint" if not bad[k].l else "double" if not bad[k].d else "string" for k in range(len(clean.columns))]
    return clean.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in zip(clean.columns, kinds)])


def sniff(spark: SparkSession, path: str) -> str:
    """The delimiter, of comma, tab and semicolon, from the first five lines; tab if none fits."""
    lines = [r.value for r in spark.read.text(path).limit(5).collect()]
    if not any(lines):
        raise ValueError(f"{path} is empty")
    try:
        return csv.Sniffer().sniff("\n".join(lines), delimiters=",\t;").delimiter
    except csv.Error:
        return "\t"


def read(spark: SparkSession, root: str, name: str, columns: list[str] | None = None, id_column: str | None = None, distinct: bool = False, multiline: bool = False) -> DataFrame:
    """The table of a .csv, .tsv, .txt, .xlsx (first sheet), .parquet or .json file, or of a folder of such files with that
    ending; `id_column` must exist and does not count for `distinct`.  Quotes inside a quoted value are doubled.  Values that
    run over line ends need `multiline`; a file is then one task, without it files are split."""
    path, kind = confined(root, name), posixpath.splitext(name)[1].lower()
    if kind == ".xls":
        raise NotImplementedError("the old binary spreadsheets cannot be read; save them as .xlsx or .csv")
    if kind not in (".csv", ".tsv", ".txt", ".xlsx", ".parquet", ".json"):
        raise ValueError(f"unsupported file type {kind!r}")
    if not there(spark, path):
        raise FileNotFoundError(path)
    if kind == ".parquet":
        df = spark.read.parquet(path)
    elif kind == ".json":
        df = spark.read.json(path)
    elif kind == ".xlsx":
        df = _typed(sheets.read(spark, path))
    else:
        sep = {".csv": ",", ".tsv": "\t"}.get(kind) or sniff(spark, path)
        df = _typed(spark.read.csv(path, header=True, sep=sep, escape='"', multiLine=multiline))
    if id_column and id_column not in df.columns:
        raise ValueError(f"no column {id_column!r}")
    if distinct:
        df = df.dropDuplicates([c for c in df.columns if c != id_column])
    return subset(df, columns) if columns else df


def read_mixed(spark: SparkSession, path: str, pattern: str = "[,\t]") -> DataFrame:
    """A text table whose lines may use either of several delimiters."""
    lines = spark.read.text(path)
    head = lines.first().value
    names = re.split(pattern, head)
    parts = F.split("value", pattern)
    return _typed(lines.where(F.col("value") != head).select(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)]))


def read_many(spark: SparkSession, root: str, configs: list[dict]) -> DataFrame:
    return pooled([(read(spark, root, c["filename"], c.get("subset_cols"), c.get("id_column"), c.get("drop_duplicates", True)), c["name"]) for c in configs])


def listed(value: str) -> list[str]:
    """Names from "a,b" or from a .txt file with names by line or comma."""
    text = Path(value).read_text() if value.endswith(".txt") else value
    return [x.strip() for x in re.split(r"[,\n]", text) if x.strip()]


def groups(path: str) -> dict[str, list[str]]:
    """Feature groups from JSON, or YAML where a reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text)
    return json.loads(text)


def run_key(settings: dict, df: DataFrame) -> str:
    """12 hex digits of the settings and of the rows, whatever their order."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return hashlib.sha256(json.dumps([settings, r.n, r.x, str(r.s)], sort_keys=True, default=str).encode()).hexdigest()[:12]


class PredictionStore:
    """Out-of-fold predictions as Parquet by run, dataset, entity and fold, each fold with its record and, if it can be
    saved, its model.  A fold is there once its marker is, which is written last: what a run left behind before that is
    overwritten by the next."""

    KEYS = ("run_key", "dataset", "entity", "fold")

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def _at(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def _folder(self, kind: str, key: str, dataset: str, entity: str) -> str:
        # names that begin with an underscore are none of the table's
        return f"{self.root}/_{kind}/run_key={key}/dataset={dataset}/entity={entity}"

    def _listed(self, path: str) -> list[str]:
        fs, at = self._at(path)
        return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []

    def _write(self, pred: DataFrame, key: str) -> None:
        pred.withColumn("run_key", F.lit(key)).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*self.KEYS).parquet(self.root)

    def put(self, pred: DataFrame, key: str) -> None:
        """Predictions of any number of datasets, entities and folds, committed by fold."""
        self._write(pred, key)
        for r in self.spark.read.parquet(self.root).where(F.col("run_key") == key).groupBy(*self.KEYS[1:]).agg(F.count("*").alias("n")).collect():
            if int(r.fold) not in self.have(key, r.dataset, r.entity):
                self.commit(key, r.dataset, r.entity, int(r.fold), {"n": r.n})

    def put_fold(self, pred: DataFrame, key: str, dataset: str, entity: str, fold: int, model=None, **record) -> None:
        """One fold: predictions, then its model, then its metrics and marker."""
        self._write(pred.withColumn("dataset", F.lit(dataset)), key)
        if model is not None:
            model.write().overwrite().save(f"{self._folder('models', key, dataset, entity)}/fold={fold}")
        one = self.spark.read.parquet(f"{self.root}/run_key={key}/dataset={dataset}/entity={entity}/fold={fold}")
        found = all_metrics(one.withColumn("entity", F.lit(entity)), ["entity"]).first()
        self.commit(key, dataset, entity, fold, record | {"n": one.count(), "model": model is not None, "metrics": found.asDict() if found else {}})

    def commit(self, key: str, dataset: str, entity: str, fold: int, record: dict) -> None:
        """Writes the marker of a fold; from then on it is there."""
        path = f"{self._folder('folds', key, dataset, entity)}/fold={fold}.json"
        fs, at = self._at(f"{path}.part")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(record, sort_keys=True, default=str).encode()))
        out.close()
        fs.delete(self._at(path)[1], False)
        fs.rename(at, self._at(path)[1])

    def record(self, key: str, dataset: str, entity: str, fold: int) -> dict:
        """What was recorded with a fold: number of rows, metrics, whether its model is kept, and what the run added."""
        fs, at = self._at(f"{self._folder('folds', key, dataset, entity)}/fold={fold}.json")
        stream = fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def model(self, key: str, dataset: str, entity: str, fold: int) -> PipelineModel | None:
        """The model of a fold, or None if it could not be saved."""
        if not self.record(key, dataset, entity, fold).get("model"):
            return None
        return PipelineModel.load(f"{self._folder('models', key, dataset, entity)}/fold={fold}")

    def get(self, key: str) -> DataFrame:
        """All predictions of a run whose folds are committed."""
        return self._rows(key)

    def _rows(self, *keys: str) -> DataFrame:
        """The predictions whose folds are committed, of the runs named or of all."""
        name = lambda d: d.split("=", 1)[1]
        done = []
        for k in keys or tuple(name(n) for n in self._listed(f"{self.root}/_folds")):
            at = f"{self.root}/_folds/run_key={k}"
            done += [(k, name(d), name(e), n) for d in self._listed(at) for e in self._listed(f"{at}/{d}") for n in self.have(k, name(d), name(e))]
        folds = self.spark.createDataFrame(done, "run_key string, dataset string, entity string, fold int")
        rows = self.spark.read.parquet(self.root)
        return (rows.where(F.col("run_key").isin(*keys)) if keys else rows).join(F.broadcast(folds) if len(done) <= FEW else folds, list(self.KEYS), "left_semi")

    def have(self, key: str, dataset: str, entity: str) -> set[int]:
        """The folds that are there; none if nothing has been stored yet."""
        marked = {int(n[5:-5]) for n in self._listed(self._folder("folds", key, dataset, entity)) if n.startswith("fold=") and n.endswith(".json")}
        return {int(n.removeprefix("fold=")) for n in self._listed(f"{self.root}/run_key={key}/dataset={dataset}/entity={entity}") if n.startswith("fold=")} & marked

    def summary(self) -> DataFrame:
        """run_key, dataset, entity, folds (numbers of those committed, in order), n."""
        return self.folds().groupBy("run_key", "dataset", "entity").agg(F.array_sort(F.collect_list("fold")).alias("folds"), F.sum("n").alias("n"))

    def cleanup(self, keep: tuple[str, ...] = (), dry_run: bool = False) -> list[str]:
        """Removes the runs whose keys are not kept, and names them; a dry run only names them."""
        found = sorted(n.removeprefix("run_key=") for n in self._listed(self.root) if n.startswith("run_key="))
        gone = [k for k in found if k not in keep]
        for k in () if dry_run else gone:
            for part in ("_folds/", "_models/", ""):
                fs, at = self._at(f"{self.root}/{part}run_key={k}")
                fs.delete(at, True)
        return gone

    def folds(self) -> DataFrame:
        return self._rows().groupBy(*self.KEYS).agg(F.count("*").alias("n"))


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """A folder of files that `read` reads, each with a header; blanks around a value stay, quotes inside one are doubled."""
    df.write.mode("overwrite").csv(path, header=True, sep=sep, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    """path, bytes, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")
