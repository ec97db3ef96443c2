"""Paging, searching and labelling operational records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import literal
from tablewright.operators.ranks import Term, slice_rows
from tablewright.schema import column, field


def matching(
    df: DataFrame,
    equals: Mapping[str, object] | None = None,
    time_column: str | None = None,
    from_time=None,
    to_time=None,
    search: str | None = None,
    search_columns: Sequence[str] = (),
) -> DataFrame:
    """Records with these values, in this closed time range, holding the text in any search column."""
    tests = [column(df, c) == literal(v, field(df, c).dataType, c) for c, v in (equals or {}).items()]
    if from_time is not None:
        tests.append(column(df, time_column) >= literal(from_time, field(df, time_column).dataType))
    if to_time is not None:
        tests.append(column(df, time_column) <= literal(to_time, field(df, time_column).dataType))
    if search is not None:
        found = [F.coalesce(column(df, c).contains(search), F.lit(False)) for c in search_columns]
        tests.append(reduce(Column.__or__, found, F.lit(False)))
    return df.where(reduce(Column.__and__, tests)) if tests else df


def page(df: DataFrame, time_column: str, id_column: str, offset: int = 0, limit: int = 50) -> DataFrame:
    """Newest records first, ties by id descending, after skipping ``offset``.

    Pages after the first cost passes that count rows, instead of a sort of what is skipped; see ``slice_rows``.
    """
    if offset < 0 or limit < 1:
        raise TabularError("page.range", "the offset is at least 0 and the limit at least 1")
    return slice_rows(df, [Term(column(df, c), descending=True, nulls_first=False) for c in (time_column, id_column)], offset, limit)


def total(df: DataFrame) -> DataFrame:
    """One row with the number of matching records."""
    return df.agg(F.count(F.lit(1)).alias("total_count"))


def with_label(
    df: DataFrame, key: str, labels: DataFrame, label_key: str, label: str, default: str, name: str = "label"
) -> DataFrame:
    """Add the label of the referenced record, or the default when it no longer exists.

    Labels are unique per key. The records are the preserved side, whose hot keys split.
    """
    named = labels.select(column(labels, label_key).alias("__label_key"), column(labels, label).alias("__label"))
    joined = df.join(named, column(df, key) == F.col("__label_key"), "left")
    return joined.select(*[column(df, c) for c in df.columns], F.coalesce("__label", F.lit(default)).alias(name))
