"""Fitted pipelines with a sidecar of features, threshold and versions, in any store that Spark writes."""

from __future__ import annotations

import json
import os
import platform
import warnings

import pyspark
from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession


def versions() -> dict[str, str]:
    import numpy

    return {"spark": pyspark.__version__, "python": platform.python_version(), "numpy": numpy.__version__}


def environment(spark: SparkSession, seeds: list[int] | None = None) -> dict:
    """What a run ran on and with: versions, machine, cluster, seeds of the folds."""
    context = spark.sparkContext
    named = ("spark.executor.memory", "spark.executor.cores", "spark.executor.instances", "spark.driver.memory", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")
    return {
        "versions": versions(), "platform": platform.platform(), "machine": platform.machine(), "cpus": os.cpu_count(),
        "master": context.master, "parallelism": context.defaultParallelism, "settings": {k: spark.conf.get(k) for k in named if spark.conf.get(k, None)}, "seeds": seeds or [],
    }


def put_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def get_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first().value)


def save_model(spark: SparkSession, model: PipelineModel, path: str, **meta) -> None:
    model.write().overwrite().save(f"{path}/model")
    put_json(spark, meta | {"versions": versions()}, f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, dict]:
    """The pipeline and its sidecar; other versions than those it was fitted with are warned of."""
    meta = get_json(spark, f"{path}/meta")
    for name, was in meta.get("versions", {}).items():
        if versions().get(name) != was:
            warnings.warn(f"fitted with {name} {was}, loaded with {versions().get(name)}", stacklevel=2)
    return PipelineModel.load(f"{path}/model"), meta
