"""Loading the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablewright.session import configure


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet")
