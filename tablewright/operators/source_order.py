"""Source order as a hidden column: file, place in the file, and number of the input.

Readers add it on request; select, filter, derive, sort, distinct and union carry it; a join or an aggregate ends it.
Sorting breaks ties by it, so that rows alike in all sort keys keep the order in which the source holds them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SOURCE = "__source"


def source_place(file: Column, block: Column, row: Column) -> Column:
    return F.struct(F.lit("").alias("inputs"), file.alias("file"), block.cast("long").alias("block"), row.cast("long").alias("row")).alias(SOURCE)


def with_source_order(scan: DataFrame) -> DataFrame:
    """The rows of a Parquet scan with their places, by file path and row number; costs no shuffle and no job."""
    return scan.select("*", source_place(F.col("_metadata.file_path"), F.lit(0), F.col("_metadata.row_index")))


def has_source_order(df: DataFrame) -> bool:
    return SOURCE in df.columns


def without_source_order(df: DataFrame) -> DataFrame:
    return df.drop(SOURCE)


def numbered_input(df: DataFrame, number: int) -> DataFrame:
    """As the ``number``-th of several inputs: all of its rows come after those of earlier ones."""
    place = F.col(SOURCE)
    return df.withColumn(SOURCE, place.withField("inputs", F.concat(F.lit(f"{number:02d}"), place["inputs"])))
