"""Several changes to one key, composed into one change before the table is joined.

Composition is associative: a change says what it asks of the row it meets (there or not, and which values)
and what it leaves, so two changes that follow each other are again such a change. Changes of a key are
composed within blocks of ordinals, then blocks of blocks, so that no task gathers all changes of a hot key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.functions.values import fail
from tablewright.governed.contract import TableContract

# Changes of one key that are composed at a time: 2 to this power.
BLOCK_BITS = 10
# What a change asks of the row before it, and what it leaves.
PARTS = ["starts", "ends", "made", "before", "before_names", "after", "changed", "problem"]


def as_parts(changes: DataFrame) -> DataFrame:
    """Single changes as the parts that compose: an insert makes a row, an update keeps one, a delete ends one."""
    insert, delete = F.col("op") == "insert", F.col("op") == "delete"
    nothing = F.array().cast("array<string>")
    kept = [c for c in changes.columns if c not in ("op", "before", "before_names", "after", "changed")]
    return changes.select(
        *kept,
        (~insert).alias("starts"),
        (~delete).alias("ends"),
        insert.alias("made"),
        "before",
        F.when(insert, nothing).otherwise(F.coalesce("before_names", nothing)).alias("before_names"),
        "after",
        F.when(delete, nothing).otherwise(F.coalesce("changed", nothing)).alias("changed"),
        F.lit(None).cast("string").alias("problem"),
    )


def follow(a: Column, b: Column, contract: TableContract) -> Column:
    """The change that ``a`` and then ``b`` are together."""
    readable, insertable = [c.alias for c in contract.readable], [c.alias for c in contract.insertable]
    nothing = F.array().cast("array<string>")

    def has(names: Column, alias: str) -> Column:
        return F.array_contains(names, alias)

    stale = F.lit(False)
    for c in contract.readable:
        found, wanted = b["before"][c.alias], has(b["before_names"], c.alias)
        if contract.concurrency == "row_version":
            # Every write gives the row a new version, which no staged change can know.
            differs = F.lit(c.token)
        else:
            left = F.when(a["made"], F.lit(None)).otherwise(a["before"][c.alias])
            known = a["made"] | has(a["before_names"], c.alias)
            if c.alias in insertable:
                left = F.when(has(a["changed"], c.alias), a["after"][c.alias]).otherwise(left)
                known = known | has(a["changed"], c.alias)
            differs = known & ~left.eqNullSafe(found)
        stale = stale | (wanted & differs)
    problem = F.coalesce(
        a["problem"],
        F.when(a["ends"] & ~b["starts"], "key_exists"),
        F.when(~a["ends"] & b["starts"], "row_missing"),
        F.when(b["starts"] & stale, "row_changed"),
        b["problem"],
    )
    # The first row is still seen through an update that keeps it.
    open_ = a["starts"] & a["ends"] & ~a["made"]

    def asked(alias: str) -> Column:
        later = open_ & ~has(a["changed"], alias) & has(b["before_names"], alias)
        return F.when(later & ~has(a["before_names"], alias), b["before"][alias]).otherwise(a["before"][alias])

    names = F.when(open_, F.array_union(a["before_names"], F.array_except(b["before_names"], a["changed"]))).otherwise(a["before_names"])
    # An update adds to what was set; anything else replaces it.
    adds = b["starts"] & b["ends"] & ~b["made"]
    after = F.struct(*[F.when(adds & ~has(b["changed"], alias), a["after"][alias]).otherwise(b["after"][alias]).alias(alias) for alias in insertable])
    return F.struct(
        a["starts"].alias("starts"),
        b["ends"].alias("ends"),
        (b["made"] | (adds & a["made"])).alias("made"),
        F.struct(*[asked(alias).alias(alias) for alias in readable]).alias("before"),
        names.alias("before_names"),
        after.alias("after"),
        F.when(adds, F.array_union(a["changed"], b["changed"])).when(b["ends"], b["changed"]).otherwise(nothing).alias("changed"),
        problem.alias("problem"),
    )


def compose(changes: DataFrame, keys: Sequence[str], contract: TableContract) -> DataFrame:
    """One row of parts per key, its changes run in the order of the column ``ordinal``.

    A null ordinal fails the job; one that a key has twice is a problem of the key. Runs a job that finds the
    span of the ordinals, which sets the number of steps: one for each 2^BLOCK_BITS-fold of it.
    """
    order = F.when(F.col("ordinal").isNull(), fail("changes.order", "a change has no ordinal").cast("bigint")).otherwise(F.col("ordinal").cast("bigint"))
    rows = as_parts(changes).withColumn("ordinal", order)
    span = rows.agg(F.min("ordinal").alias("low"), F.max("ordinal").alias("high")).first()
    low, left = span["low"] or 0, (span["high"] or 0) - (span["low"] or 0)
    rows = rows.withColumn("ordinal", F.col("ordinal") - F.lit(low))
    first = True
    while first or left > 0:
        gathered = rows.groupBy(*keys, F.shiftright("ordinal", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("ordinal", F.struct(*PARTS).alias("part")))).alias("all"))
        folded = F.aggregate(F.slice("all", 2, 1 << BLOCK_BITS), F.get("all", 0)["part"], lambda a, x: follow(a, x["part"], contract))
        # Problems of order show in the first step, where a key's equal ordinals share a block.
        twice = F.size(F.array_distinct(F.col("all.ordinal"))) < F.size("all") if first else F.lit(False)
        rows = gathered.select(*keys, F.col("block").alias("ordinal"), folded.alias("part"), twice.alias("twice"))
        problem = F.when(F.col("twice"), "order_repeated").otherwise(F.col("part.problem"))
        rows = rows.select(*keys, "ordinal", *[f"part.{p}" for p in PARTS if p != "problem"], problem.alias("problem"))
        first, left = False, left >> BLOCK_BITS
    return rows.drop("ordinal")
