"""Frames written to the folder that the driver and all executors share, to cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset it is set to the temporary folder of a local master,
    and on a cluster it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and every executor see")
        root = "file://" + os.path.join(tempfile.gettempdir(), "plumbline-checkpoints")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def kept(df: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """df written as Parquet and read back: nothing above it is computed again, whatever executors are lost.  Columns `by`, which
    have few values, become folders, so that filters on them read no other rows."""
    path = shared_folder(df.sparkSession)
    df.write.partitionBy(*by).parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.kept_at = path
    return back


def let_go(*frames: DataFrame) -> None:
    """Removes what `kept` wrote for frames that nothing will read again."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
