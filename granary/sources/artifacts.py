"""Versioned model artifacts with a checked metadata record."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

REQUIRED_KEYS = ("version", "features", "target", "metrics")


def save_model(model: PipelineModel, root: str, version: str, meta: dict) -> str:
    """Write one version next to the older ones, then publish it as current.

    Older versions stay in place as backups.
    """
    spark = SparkSession.active()
    record = {**meta, "version": version}
    missing = [k for k in REQUIRED_KEYS if k not in record]
    if missing:
        raise ValueError(f"artifact record lacks {missing}")
    path = f"{root}/versions/{version}"
    model.write().save(path)
    row = spark.createDataFrame([(version, path, json.dumps(record))], "version string, path string, record string")
    row.coalesce(1).write.mode("append").json(f"{root}/registry")
    return path


def list_versions(spark: SparkSession, root: str):
    return spark.read.schema("version string, path string, record string").json(f"{root}/registry")


def load_model(spark: SparkSession, root: str, version: str | None = None) -> tuple[PipelineModel, dict]:
    """Load the newest (or a named) version after verifying its record."""
    rows = list_versions(spark, root)
    rows = rows.where(F.col("version") == version) if version else rows
    last = rows.orderBy(F.desc("version")).first()
    if last is None:
        raise FileNotFoundError(f"no model version under {root}")
    record = json.loads(last.record)
    missing = [k for k in REQUIRED_KEYS if k not in record]
    if missing:
        raise ValueError(f"artifact record lacks {missing}")
    return PipelineModel.load(last.path), record
