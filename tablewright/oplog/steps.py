"""Folding node events into step attempts, and run status from steps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.session import written

# Event kinds, step states and the error codes of unexplained endings.
STARTED, PROGRESSED, SKIPPED = "started", "progressed", "skipped"
SUCCEEDED, FAILED, RETRY_SCHEDULED, CANCELLED = "succeeded", "failed", "retry_scheduled", "cancelled"
ENDINGS = (SUCCEEDED, FAILED, RETRY_SCHEDULED, CANCELLED)
TOTALS = ("rows_read", "rows_written", "batches", "bytes_read", "bytes_written")
ABANDONED_ERROR = "execution.lease-recovered"
UNNAMED_ERROR = "execution.node.failed"

# How a step ended, as a number so that partial aggregation stays hash-based.
OPEN, DONE, BROKEN, STOPPED, PASSED, ABANDONED = range(6)

MIN_BLOCK = 1 << 16
MAX_BLOCKS = 1 << 16


def block_width(df: DataFrame, order: str) -> int:
    """A block size that gives at most 65,536 blocks and at least 65,536 ids per block."""
    low, high = df.agg(F.min(order), F.max(order)).first()
    return MIN_BLOCK if low is None else max(MIN_BLOCK, -(-(high - low + 1) // MAX_BLOCKS))


def carried(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    width: int,
    maxes: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Running values per key without putting a whole key into one task.

    ``order`` is a unique bigint and keys are not null. For each row, ``maxes`` are taken over earlier rows of the
    key and ``sums`` over earlier rows and the row itself. Rows are windowed within blocks of
    ``width`` ids, which bounds a window to ``width`` rows however hot its key is; what
    earlier blocks contribute comes from one summary row per key and block.
    """
    maxes, sums = maxes or {}, sums or {}
    blocked = df.withColumn("__block", F.expr(f"{order} div {width}L"))
    for name, value in {**maxes, **sums}.items():
        blocked = blocked.withColumn(f"__in_{name}", value)
    summary = blocked.groupBy(*keys, "__block").agg(
        *[F.max(f"__in_{n}").alias(f"__m_{n}") for n in maxes], *[F.sum(f"__in_{n}").alias(f"__s_{n}") for n in sums]
    )
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(
        *[F.col(k).alias(f"__c_{k}") for k in keys],
        F.col("__block").alias("__c_block"),
        *[F.max(f"__m_{n}").over(earlier).alias(f"__m_{n}") for n in maxes],
        *[F.sum(f"__s_{n}").over(earlier).alias(f"__s_{n}") for n in sums],
    )
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__c_{k}") for k in keys])
    joined = blocked.join(carry, same & (F.col("__block") == F.col("__c_block")), "inner")
    local = Window.partitionBy(*keys, "__block").orderBy(order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.select(
        *df.columns,
        *[F.greatest(F.col(f"__m_{n}"), F.max(f"__in_{n}").over(before)).alias(n) for n in maxes],
        *[(F.coalesce(F.col(f"__s_{n}"), F.lit(0)) + F.sum(f"__in_{n}").over(upto)).alias(n) for n in sums],
    )


def with_defaults(events: DataFrame) -> DataFrame:
    """Node events with all total columns and ``error_code``; missing ones are null."""
    present = {c.lower() for c in events.columns}
    for name in TOTALS:
        if name not in present:
            events = events.withColumn(name, F.lit(None).cast("bigint"))
    return events if "error_code" in present else events.withColumn("error_code", F.lit(None).cast("string"))


def locate(events: DataFrame, width: int | None = None) -> DataFrame:
    """Each event with ``step_seq``: the opening event of the attempt it belongs to.

    A start opens an attempt, as does a skip and a cancel with nothing running. Other events
    belong to the running attempt; ``step_seq`` is null where none is running.
    ``abandons`` is the running attempt a start replaces.
    """
    events = with_defaults(events)
    width = width or block_width(events, "seq")
    kind = F.col("kind")
    marked = carried(
        events,
        ["run_id", "node_id"],
        "seq",
        width,
        maxes={"__start": F.when(kind == STARTED, F.col("seq")), "__end": F.when(kind.isin(*ENDINGS), F.col("seq"))},
    )
    running = F.col("__start").isNotNull() & (F.col("__end").isNull() | (F.col("__start") > F.col("__end")))
    opens = kind.isin(STARTED, SKIPPED) | ((kind == CANCELLED) & ~running)
    return marked.select(
        *events.columns,
        F.when(opens, F.col("seq")).when(running, F.col("__start")).alias("step_seq"),
        F.when((kind == STARTED) & running, F.col("__start")).alias("abandons"),
    )


def fold_events(events: DataFrame, width: int | None = None) -> DataFrame:
    """One row per (run, node, attempt).

    Input: ``run_id``, ``node_id``, unique ``seq``, ``kind``, ``at``, and optionally cumulative
    totals and ``error_code``. Events that belong to no attempt are left out; see
    ``event_problems``. Runs a job: the attempts are written before they are numbered.
    """
    width = width or block_width(events, "seq")
    located = locate(events, width)
    kind, opener = F.col("kind"), F.col("step_seq") == F.col("seq")
    ending = (
        F.when(kind == SUCCEEDED, DONE)
        .when(kind.isin(FAILED, RETRY_SCHEDULED), BROKEN)
        .when(kind == CANCELLED, STOPPED)
        .when(kind == SKIPPED, PASSED)
        .otherwise(OPEN)
    )
    named_errors = "error_code" in {c.lower() for c in events.columns}
    own = {
        "step_seq": F.col("step_seq"),
        "ending": ending,
        "started_at": F.when(opener & (kind != SKIPPED), F.col("at")),
        "completed_at": F.when(ending != OPEN, F.col("at")),
        **{t: F.when(~kind.isin(STARTED, SKIPPED), F.col(t)) for t in TOTALS},
        "error_code": F.when(ending == BROKEN, F.coalesce("error_code", F.lit(UNNAMED_ERROR))),
    }
    replaced = {
        "step_seq": F.col("abandons"),
        "ending": F.lit(ABANDONED),
        "started_at": F.lit(None).cast(located.schema["at"].dataType),
        "completed_at": F.col("at"),
        **{t: F.lit(None).cast("bigint") for t in TOTALS},
        "error_code": F.lit(None).cast("string"),
    }
    if not named_errors:
        # Without named errors the aggregation below has only fixed-width values and stays hash-based.
        own.pop("error_code"), replaced.pop("error_code")
    both = F.array(*[F.struct(*[v.alias(n) for n, v in side.items()]) for side in (own, replaced)])
    parts = located.select("run_id", "node_id", F.explode(both).alias("p")).where("p.step_seq is not null")
    steps = parts.groupBy("run_id", "node_id", F.col("p.step_seq").alias("step_seq")).agg(
        F.max("p.ending").alias("ending"),
        F.max("p.started_at").alias("started_at"),
        F.max("p.completed_at").alias("completed_at"),
        *[F.coalesce(F.max(f"p.{t}"), F.lit(0)).cast("bigint").alias(t) for t in TOTALS],
        *([F.max("p.error_code").alias("error_code")] if named_errors else []),
    )
    # Numbering reads the attempts twice; written once, the event log is not folded twice.
    steps = written(steps, "steps")
    numbered = carried(steps, ["run_id", "node_id"], "step_seq", width, sums={"attempt": F.lit(1)})
    status = (
        F.when(F.col("ending") == DONE, "Succeeded")
        .when(F.col("ending").isin(BROKEN, ABANDONED), "Failed")
        .when(F.col("ending") == STOPPED, "Cancelled")
        .when(F.col("ending") == PASSED, "Skipped")
        .otherwise("Running")
    )
    error = F.when(F.col("ending") == ABANDONED, ABANDONED_ERROR).when(
        F.col("ending") == BROKEN, F.col("error_code") if named_errors else F.lit(UNNAMED_ERROR)
    )
    return numbered.select(
        "run_id", "node_id", F.col("attempt").cast("bigint").alias("attempt"), status.alias("status"),
        "started_at", "completed_at", *TOTALS, error.alias("error_code"),
    )


def event_problems(events: DataFrame, width: int | None = None) -> DataFrame:
    """Events that break the protocol: no running attempt, or a total moving backwards."""
    width = width or block_width(events, "seq")
    located = locate(events, width)
    # Starts and skips carry no totals; a null total leaves the running value alone.
    reports = ~F.col("kind").isin(STARTED, SKIPPED)
    columns = ["run_id", "node_id", "seq", "kind"]
    homeless = located.where(F.col("step_seq").isNull()).select(*columns, F.lit("no_running_attempt").alias("problem"))
    judged = carried(
        located.where(F.col("step_seq").isNotNull()),
        ["run_id", "node_id", "step_seq"],
        "seq",
        width,
        maxes={f"__top_{t}": F.when(reports, F.col(t)) for t in TOTALS},
    )
    backwards = reduce(
        Column.__or__,
        [F.coalesce(F.col(t) < F.coalesce(F.col(f"__top_{t}"), F.lit(0)), F.lit(False)) for t in TOTALS],
    )
    return homeless.union(judged.where(reports & backwards).select(*columns, F.lit("total_moved_backwards").alias("problem")))


def status_rollup(steps: DataFrame, run: str = "run_id", status: str = "status") -> DataFrame:
    """Run status: cancelled beats failed beats succeeded; skipped steps are neutral."""
    return (
        steps.groupBy(run)
        .agg(F.bool_or(F.col(status) == "Cancelled").alias("__c"), F.bool_or(F.col(status) == "Failed").alias("__f"))
        .select(run, F.when(F.col("__c"), "Cancelled").when(F.col("__f"), "Failed").otherwise("Succeeded").alias("run_status"))
    )
