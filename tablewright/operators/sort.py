"""Sorting, top rows and global row numbers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.limits import require_at_most
from tablewright.operators.ranks import Term, slice_rows
from tablewright.operators.source_order import SOURCE, has_source_order
from tablewright.schema import check_names, column, is_floating, row_hash
from tablewright.session import shared_folder


@dataclass(frozen=True)
class SortKey:
    """One sort key; null placement does not depend on the direction."""

    column: str
    descending: bool = False
    nulls_first: bool = True


def sort_keys(keys: Sequence[SortKey | Mapping | str]) -> list[SortKey]:
    result = []
    for key in keys:
        if isinstance(key, str):
            key = SortKey(key)
        elif isinstance(key, Mapping):
            direction, nulls = key.get("direction", "ascending"), key.get("nulls", "first")
            if direction not in ("ascending", "descending") or nulls not in ("first", "last"):
                raise TabularError("sort.key", f"invalid sort key {dict(key)}")
            key = SortKey(key["column"], direction == "descending", nulls == "first")
        result.append(key)
    return result


def order_terms(df: DataFrame, keys: Sequence[SortKey]) -> list[Term]:
    terms = []
    for key in keys:
        cell = column(df, key.column)
        if is_floating(df, key.column):
            # NaN sorts below every number: order on "is a number" first.
            terms.append(Term(F.when(cell.isNotNull(), ~F.isnan(cell)), key.descending, key.nulls_first))
        terms.append(Term(cell, key.descending, key.nulls_first))
    return terms


def order_columns(df: DataFrame, keys: Sequence[SortKey]) -> list[Column]:
    return [t.order for t in order_terms(df, keys)]


def sort_order(df: DataFrame, keys, tie_breaker: Sequence[str] | None = None) -> list[Term]:
    """Requested keys, then the tie breaker; without one, the source order if the rows carry it, else a content hash.

    Each makes the order repeatable and lets range partitioning cut through a hot key; the
    hash has eight bytes, which keeps the sampled range bounds small.
    """
    ranking = sort_keys(keys)
    if not 1 <= len(ranking) <= 16:
        raise TabularError("sort.keys", "expected 1 to 16 sort keys")
    check_names([k.column for k in ranking])
    terms = order_terms(df, ranking + [SortKey(c) for c in tie_breaker or ()])
    if tie_breaker:
        return terms
    if has_source_order(df):
        return terms + [Term(F.col(SOURCE)[part]) for part in ("inputs", "file", "block", "row")]
    return [*terms, Term(row_hash(column(df, c) for c in df.columns))]


def sort_rows(
    df: DataFrame, keys, tie_breaker: Sequence[str] | None = None, max_rows: int | None = None
) -> DataFrame:
    """Globally sorted rows (range-partitioned, spilling)."""
    order = [t.order for t in sort_order(df, keys, tie_breaker)]
    if max_rows is not None:
        require_at_most(df, max_rows, "sort.rows", "rows")
    return df.orderBy(*order)


def top_rows(df: DataFrame, keys, count: int, tie_breaker: Sequence[str] | None = None) -> DataFrame:
    """The first ``count`` rows in sort order."""
    return slice_rows(df, sort_order(df, keys, tie_breaker), 0, count)


def number_rows(ordered: DataFrame, name: str = "row_number") -> DataFrame:
    """1-based positions of an ordered DataFrame, without a single-task window.

    Runs a job: the ordered rows are checkpointed, so their partitions are fixed. One count
    per partition then goes through a window and comes back as a broadcast of that size.
    """
    shared_folder(ordered.sparkSession)
    placed = ordered.withColumn("__at", F.monotonically_increasing_id()).checkpoint()
    partition, offset = F.shiftright("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = placed.groupBy(partition.alias("__part")).agg(F.count(F.lit(1)).alias("__size"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"))
    # Bounded: one row per partition of the sort.
    numbered = placed.withColumn("__part", partition).join(F.broadcast(starts), "__part")
    return numbered.select(
        *[column(numbered, c) for c in ordered.columns], (F.col("__start") + offset + 1).cast("bigint").alias(name)
    )
