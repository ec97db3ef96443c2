"""Alert matching over a stream of finished runs."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.oplog.alerts import TRIGGERS, delivery_key, rule_triggers
from tablewright.session import scratch_path


def match_rules_stream(runs: DataFrame, rules: DataFrame) -> DataFrame:
    """A candidate delivery per rule, run and terminal event, as runs arrive, copies included.

    Whether a delivery was made before is for ``deliver_available`` to say; no watermark drops late runs.
    """
    timed = runs.where(F.col("status").isin(*TRIGGERS)).withColumn("completed_at", F.col("completed_at").cast("timestamp"))
    triggers = rule_triggers(rules)
    hit = (timed["workflow_id"] == triggers["rule_workflow_id"]) & (timed["status"] == triggers["rule_status"])
    return timed.join(triggers, hit, "inner").select(
        "rule_id", "run_id", "workflow_id", "status", "completed_at",
        delivery_key(F.col("rule_id"), F.col("run_id"), F.col("status")).alias("delivery_key"),
    )


def deliver_available(matched: DataFrame, label: str, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Make each delivery of a stream once, whatever order and however late its runs arrive.

    A micro-batch drops the keys that other batches delivered and writes the rest into a folder of its own, named
    after the checkpoint and its number, so a batch that is run again replaces what it wrote and nothing else. A later
    run into the same ``output``, with this checkpoint or another, adds to what was delivered. Of copies in one batch
    the earliest stays.
    """
    spark = matched.sparkSession
    output = output or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-log")
    log = hashlib.md5(checkpoint.rstrip("/").encode()).hexdigest()

    def deliver(batch: DataFrame, number: int) -> None:
        first = F.min(F.struct("completed_at", *[c for c in batch.columns if c not in ("completed_at", "delivery_key")])).alias("first")
        rows = batch.groupBy("delivery_key").agg(first).select(*[F.col("delivery_key") if c == "delivery_key" else F.col(f"first.{c}") for c in batch.columns])
        own = f"{log}-{number}"
        made = _delivered(batch.sparkSession, output, matched).where(F.col("batch") != own).select("delivery_key")
        rows.join(made, "delivery_key", "left_anti").select(*batch.columns).write.mode("overwrite").parquet(f"{output}/batch={own}")

    query = (
        matched.writeStream.foreachBatch(deliver)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return _delivered(spark, output, matched).drop("batch")


def _delivered(spark: SparkSession, output: str, matched: DataFrame) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(output)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return spark.read.schema(T.StructType([*matched.schema.fields, T.StructField("batch", T.StringType())])).parquet(output)
