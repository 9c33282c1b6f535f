"""Parquet tables of a folder: ``<dir>/<name>.parquet``, a file or a folder of part files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table; timestamps without zone are kept as they are."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
