"""Parquet table access (A5) with column pruning left to Catalyst."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one parquet table; projections and filters applied later reach the scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def table_or_empty(spark: SparkSession, path: str, schema) -> DataFrame:
    """A5: graceful empty result when a conformed table is absent."""
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as exc:  # noqa: BLE001 - Spark raises AnalysisException subclasses
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return spark.createDataFrame([], schema)
        raise
