"""Event folding as a stateful stream.

State per (run, node) is one small row, kept in the state store. A micro-batch is bounded
by the source's admission settings (``maxFilesPerTrigger`` or ``maxBytesPerTrigger``), and
with it the events of one key a task can see at once.

``fold_available`` folds each micro-batch by the batch operators instead, so that a hot key is spread
over tasks: state is a log of small rows, one per touched key and micro-batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tablewright.oplog.steps import (
    ABANDONED_ERROR,
    CANCELLED,
    ENDINGS,
    FAILED,
    PROGRESSED,
    RETRY_SCHEDULED,
    SKIPPED,
    STARTED,
    SUCCEEDED,
    TOTALS,
    UNNAMED_ERROR,
    fold_events,
    with_defaults,
)
from tablewright.session import dropped, scratch_path

STEP_SCHEMA = (
    "run_id string, node_id string, attempt bigint, status string, started_at timestamp, completed_at timestamp, "
    + ", ".join(f"{t} bigint" for t in TOTALS)
    + ", error_code string, version bigint"
)
# Attempts and events so far, and the running attempt (0 when none is running).
STATE_SCHEMA = "attempts bigint, events bigint, running bigint, started_at timestamp, " + ", ".join(
    f"{t} bigint" for t in TOTALS
)
# Of a key after a micro-batch: attempts so far, the running one (0 when none is) and what it has reported.
KEYS = ("run_id", "node_id")
OPEN_SCHEMA = "run_id string, node_id string, attempts bigint, running bigint, started_at timestamp, " + ", ".join(
    f"{t} bigint" for t in TOTALS
) + ", version bigint"
# Every so many micro-batches the states of all keys are written, not only of the touched ones.
SNAPSHOT = 32
KINDS = (STARTED, PROGRESSED, SUCCEEDED, FAILED, RETRY_SCHEDULED, CANCELLED, SKIPPED)
STATUS = ("Running", "Running", "Succeeded", "Failed", "Failed", "Cancelled", "Skipped")
START, SKIP, CANCEL = KINDS.index(STARTED), KINDS.index(SKIPPED), KINDS.index(CANCELLED)
FAILURES = (KINDS.index(FAILED), KINDS.index(RETRY_SCHEDULED))
NO_TIME = np.datetime64("NaT", "ns")


def fold_stream(events: DataFrame) -> DataFrame:
    """Every attempt a micro-batch touches, as it stands after it; the highest ``version`` wins.

    Events count in arrival order between micro-batches and by ``seq`` within one.
    """
    code = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")) - 1
    events = with_defaults(events).select(
        F.col("run_id").cast("string").alias("run_id"), F.col("node_id").cast("string").alias("node_id"),
        "seq", code.cast("int").alias("code"), F.col("at").cast("timestamp").alias("at"),
        *[F.coalesce(t, F.lit(0)).alias(t) for t in TOTALS], "error_code",
    )
    return events.groupBy("run_id", "node_id").applyInPandasWithState(
        fold_group, STEP_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout
    )


def latest_steps(log: DataFrame) -> DataFrame:
    """The current attempts from the log a ``fold_stream`` query wrote."""
    columns = [c for c in log.columns if c not in ("run_id", "node_id", "attempt", "version")]
    newest = log.groupBy("run_id", "node_id", "attempt").agg(
        F.max_by(F.struct(*columns), "version").alias("__step")
    )
    return newest.select("run_id", "node_id", "attempt", "__step.*")


def fold_available(events: DataFrame, label: str, output: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """The current attempts of all events that have arrived, folded micro-batch by micro-batch without Python.

    Events count in arrival order between micro-batches and by ``seq`` within one; those without a run or node id
    are left out. An attempt that ran on from an earlier micro-batch enters the next one as a start and a report
    before its first event, so the fold of a micro-batch is ``fold_events``, whose windows hold no more than a block of
    a key. A micro-batch writes the attempts and the keys it touched into folders of its own, so one that is run again
    replaces what it wrote. They lie below ``output``, apart by checkpoint; a later call with both goes on.
    """
    spark = events.sparkSession
    output = output or scratch_path(spark, f"{label}-out")
    checkpoint = checkpoint or scratch_path(spark, f"{label}-log")
    base = f"{output}/{hashlib.md5(checkpoint.rstrip('/').encode()).hexdigest()}"

    def fold(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        snapshot = max(0, number - 1) // SNAPSHOT * SNAPSHOT
        before = _open_steps(session, base, range(snapshot, number))
        low = batch.agg(F.min("seq")).first()[0] or 0
        touched = before.join(batch.select(*KEYS).distinct(), list(KEYS), "left_semi")
        ran_on = touched.where("running > 0")
        no_error = F.lit(None).cast("string").alias("error_code")
        start = ran_on.select(*KEYS, F.lit(low - 2).alias("seq"), F.lit(STARTED).alias("kind"), F.col("started_at").alias("at"), *TOTALS, no_error)
        report = ran_on.select(*KEYS, F.lit(low - 1).alias("seq"), F.lit(PROGRESSED).alias("kind"), F.col("started_at").alias("at"), *TOTALS, no_error)
        folded = fold_events(batch.unionByName(start).unionByName(report))
        # The attempt that ran on is the fold's first; skips may have come after it.
        known = touched.select(*KEYS, F.col("attempts").alias("__attempts"), F.col("running").alias("__running"))
        number_of = (
            F.when(F.col("__attempts").isNull(), F.col("attempt"))
            .when(F.col("__running") == 0, F.col("__attempts") + F.col("attempt"))
            .when(F.col("attempt") == 1, F.col("__running"))
            .otherwise(F.col("__attempts") + F.col("attempt") - 1)
        )
        steps = folded.join(known, list(KEYS), "left").withColumn("attempt", number_of)
        steps = steps.drop("__attempts", "__running").withColumn("version", F.lit(number).cast("bigint"))
        steps.write.mode("overwrite").parquet(f"{base}/steps/batch={number}")
        dropped(folded)
        steps = session.read.schema(STEP_SCHEMA).parquet(f"{base}/steps/batch={number}")
        runs_on = F.when(F.col("status") == "Running", F.struct("attempt", "started_at", *TOTALS))
        last = steps.groupBy(*KEYS).agg(F.max("attempt").alias("attempt"), F.max(runs_on).alias("open"))
        after = last.join(known, list(KEYS), "left").select(
            *KEYS, F.greatest("attempt", "__attempts").alias("attempts"), F.coalesce("open.attempt", F.lit(0)).alias("running"),
            "open.started_at", *[f"open.{t}" for t in TOTALS], F.lit(number).cast("bigint").alias("version"),
        )
        if number % SNAPSHOT == 0:
            after = after.unionByName(before.join(after.select(*KEYS), list(KEYS), "left_anti"))
        after.write.mode("overwrite").parquet(f"{base}/open/batch={number}")
        # The micro-batch before this one is committed: nothing reads what lies before its snapshot.
        for old in range(max(0, snapshot - SNAPSHOT), snapshot):
            path = session._jvm.org.apache.hadoop.fs.Path(f"{base}/open/batch={old}")
            path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)

    typed = with_defaults(events).select(
        *[F.col(k).cast("string").alias(k) for k in KEYS], F.col("seq").cast("bigint").alias("seq"), "kind",
        F.col("at").cast("timestamp").alias("at"), *[F.col(t).cast("bigint").alias(t) for t in TOTALS], "error_code",
    ).where("run_id is not null and node_id is not null")
    query = typed.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/steps")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return latest_steps(spark.read.schema(STEP_SCHEMA + ", batch int").parquet(f"{base}/steps").drop("batch"))


def _open_steps(spark: SparkSession, base: str, numbers: range) -> DataFrame:
    """The newest state of every key in these micro-batches' folders."""
    if not numbers:
        return spark.createDataFrame([], OPEN_SCHEMA)
    log = spark.read.schema(OPEN_SCHEMA).parquet(*[f"{base}/open/batch={n}" for n in numbers])
    values = [c for c in log.columns if c not in KEYS]
    return log.groupBy(*KEYS).agg(F.max_by(F.struct(*values), "version").alias("s")).select(*KEYS, "s.*")


def _before(flags: np.ndarray, initial: int) -> np.ndarray:
    """Position of the last flagged event before each event, or ``initial``."""
    last = np.maximum.accumulate(np.where(flags, np.arange(len(flags)), initial))
    return np.concatenate([[initial], last[:-1]])


def fold_group(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold one key's events of one micro-batch with array operations.

    Slot 0 is the attempt already running when the batch came; slot i the i-th one it opens.
    """
    attempts, seen, running, started, totals = 0, 0, 0, None, [0] * len(TOTALS)
    if state.exists:
        attempts, seen, running, started, *totals = state.get
    parts = [
        (b["seq"].to_numpy(), b["code"].to_numpy(), b["at"].to_numpy().astype("datetime64[ns]"),
         b[list(TOTALS)].to_numpy(), b["error_code"].to_numpy(dtype=object))
        for b in batches
    ]
    seq, code, at, reported, errors = (np.concatenate(column) for column in zip(*parts))
    order = np.argsort(seq, kind="stable")
    code, at, reported, errors = code[order], at[order], reported[order], errors[order]

    starts, skips = code == START, code == SKIP
    ends = (code > KINDS.index(PROGRESSED)) & ~skips
    # Position -1 stands for the carried attempt, -2 for none.
    last_start, last_end = _before(starts, -1 if running else -2), _before(ends, -2)
    is_running = (last_start >= -1) & (last_start > last_end)
    opens = starts | skips | ((code == CANCEL) & ~is_running)
    slot_at = np.concatenate([np.cumsum(opens), [0]])  # the last entry answers position -1
    belongs = opens | is_running
    slot = np.where(opens, slot_at[:-1], slot_at[np.maximum(last_start, -1)])
    count = int(opens.sum()) + 1

    final = np.zeros(count, dtype=int)
    started_at, completed_at = np.full(count, NO_TIME), np.full(count, NO_TIME)
    error_code = np.full(count, None, dtype=object)
    top = np.zeros((count, len(TOTALS)), dtype="int64")
    if running:
        started_at[0], top[0] = np.datetime64(pd.Timestamp(started)), totals
    born = opens & ~skips
    started_at[slot[born]] = at[born]
    closes = belongs & (ends | skips)
    final[slot[closes]], completed_at[slot[closes]] = code[closes], at[closes]
    failed = belongs & np.isin(code, FAILURES)
    error_code[slot[failed]] = [UNNAMED_ERROR if pd.isna(e) else e for e in errors[failed]]
    reports = belongs & ~starts & ~skips
    np.maximum.at(top, slot[reports], reported[reports])
    replaces = starts & is_running
    left = slot_at[np.maximum(last_start[replaces], -1)]
    final[left], completed_at[left], error_code[left] = FAILURES[0], at[replaces], ABANDONED_ERROR

    first = 0 if running else 1
    number = np.concatenate([[running], attempts + np.arange(1, count)])
    still = [i for i in range(first, count) if final[i] == START]
    attempts, seen = attempts + count - 1, seen + len(code)
    if still:
        open_slot = still[-1]
        state.update(
            (attempts, seen, int(number[open_slot]), pd.Timestamp(started_at[open_slot]).to_pydatetime(),
             *[int(v) for v in top[open_slot]])
        )
    else:
        state.update((attempts, seen, 0, None, *[0] * len(TOTALS)))
    if first < count:
        yield pd.DataFrame(
            {
                "run_id": key[0], "node_id": key[1], "attempt": number[first:],
                "status": [STATUS[c] for c in final[first:]], "started_at": started_at[first:],
                "completed_at": completed_at[first:], **{t: top[first:, i] for i, t in enumerate(TOTALS)},
                "error_code": error_code[first:], "version": seen,
            }
        )
