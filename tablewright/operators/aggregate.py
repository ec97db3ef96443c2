"""Grouped and global aggregates with strict numeric rules."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import fail
from tablewright.limits import require_at_most
from tablewright.schema import check_names, column, field, logical_type

NUMERIC = ("int64", "decimal", "double")


def aggregate_rows(
    df: DataFrame, group_by: Sequence[str], aggregates: Sequence[Mapping], max_groups: int | None = None
) -> DataFrame:
    """``group_by`` columns, then one column per ``{"name", "operation", "column"}``.

    Operations: count, countNonNull, sum, average, minimum, maximum. Without keys the
    result is one row even for empty input. Null is a group value.
    """
    if len(group_by) > 16 or not 1 <= len(aggregates) <= 64:
        raise TabularError("aggregate.count", "expected at most 16 keys and 1 to 64 aggregates")
    keys = [column(df, k) for k in group_by]
    check_names([*group_by, *[a["name"] for a in aggregates]])
    measures = [_measure(df, a).alias(a["name"]) for a in aggregates]
    result = df.groupBy(*keys).agg(*measures) if keys else df.agg(*measures)
    if max_groups is not None:
        require_at_most(result, max_groups, "aggregate.groups", "groups")
    return result


def _measure(df: DataFrame, aggregate: Mapping) -> Column:
    operation, name = aggregate["operation"], aggregate.get("column")
    if operation == "count":
        if name is not None:
            raise TabularError("aggregate.column", "'count' takes no column")
        return F.count(F.lit(1))
    if name is None:
        raise TabularError("aggregate.column", f"'{operation}' needs a column")
    value, data_type = column(df, name), field(df, name).dataType
    kind = logical_type(data_type)
    if operation == "countNonNull":
        return F.count(value)
    if operation in ("sum", "average"):
        if kind not in NUMERIC:
            raise TabularError("aggregate.type", f"'{operation}' needs a numeric column, '{name}' is {kind}")
        return _sum(value, kind, name) if operation == "sum" else _average(value, kind, data_type, name)
    if operation == "minimum":
        return _minimum(value, kind)
    if operation == "maximum":
        return _maximum(value, kind)
    raise TabularError("aggregate.operation", f"unknown operation '{operation}'")


def _finite(result: Column, name: str) -> Column:
    bad = F.isnan(result) | (F.abs(result) == float("inf"))
    return F.when(bad, fail("aggregate.overflow", f"column '{name}' has no finite result")).otherwise(result)


def _sum(value: Column, kind: str, name: str) -> Column:
    if kind == "double":
        return _finite(F.sum(value.cast("double")), name)
    # Overflow of a bigint or decimal sum raises in ANSI mode.
    return F.sum(value)


def _average(value: Column, kind: str, data_type: T.DataType, name: str) -> Column:
    if kind == "double":
        return _finite(F.avg(value.cast("double")), name)
    if kind == "int64":
        # The mean of integers is a decimal with 13 decimal places.
        return F.avg(value.cast(T.DecimalType(28, 9)))
    # At least 9 decimal places in the running sum where 28 digits leave room for them.
    scale = max(data_type.scale, min(9, 28 - (data_type.precision - data_type.scale)))
    wider = T.DecimalType(max(data_type.precision, data_type.precision - data_type.scale + scale), scale)
    return F.avg(value.cast(wider))


def _minimum(value: Column, kind: str) -> Column:
    """NaN is the smallest double."""
    if kind != "double":
        return F.min(value)
    return F.when(F.bool_or(F.isnan(value)), F.lit(float("nan"))).otherwise(F.min(value))


def _maximum(value: Column, kind: str) -> Column:
    """NaN only wins when there is nothing else."""
    if kind != "double":
        return F.max(value)
    return F.coalesce(F.max(F.when(~F.isnan(value), value)), F.max(value))
