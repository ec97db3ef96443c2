"""Running a stream over the data that is there, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.session import scratch_path


def read_stream(
    spark: SparkSession, folder: str, schema: T.StructType, files: str = "*.parquet", files_per_trigger: int = 64
) -> DataFrame:
    """A parquet folder as a stream, a bounded number of files per micro-batch."""
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", files)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(folder)
    )


def run_available(stream: DataFrame, label: str, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Process everything available, then return what was written (exactly once)."""
    spark = stream.sparkSession
    output = output or scratch_path(spark, f"{label}-out")
    query = (
        stream.writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-log"))
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(output)
