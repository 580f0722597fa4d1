"""Readers of the Parquet tables of one data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` under ``directory``; only the columns used later are read from the files."""
    return spark.read.parquet(f"{directory}/{name}.parquet")
