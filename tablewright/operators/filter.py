"""Row filter: a conjunction of typed conditions with null-safe equality."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import literal
from tablewright.schema import column, field, logical_type

UNARY = {"isNull", "isNotNull"}
TEXT = {"contains": Column.contains, "startsWith": Column.startswith, "endsWith": Column.endswith}
ORDER = {
    "greaterThan": Column.__gt__,
    "greaterThanOrEqual": Column.__ge__,
    "lessThan": Column.__lt__,
    "lessThanOrEqual": Column.__le__,
}


def filter_rows(df: DataFrame, conditions: Sequence[Mapping]) -> DataFrame:
    """Rows for which all conditions hold.

    A condition has ``column``, ``operator`` and, unless it tests for null, ``value``.
    """
    if not 1 <= len(conditions) <= 32:
        raise TabularError("filter.count", "expected 1 to 32 conditions")
    return df.where(reduce(Column.__and__, [_condition(df, c) for c in conditions]))


def _condition(df: DataFrame, condition: Mapping) -> Column:
    name, operator = condition["column"], condition["operator"]
    cell, kind = column(df, name), logical_type(field(df, name).dataType)
    if operator in UNARY:
        return cell.isNull() if operator == "isNull" else cell.isNotNull()
    value = condition.get("value")
    constant = literal(value, field(df, name).dataType, name)
    if operator == "equals":
        return cell.eqNullSafe(constant)
    if operator == "notEquals":
        return ~cell.eqNullSafe(constant)
    if operator in TEXT:
        if kind != "string":
            raise TabularError("filter.type", f"'{operator}' needs a text column")
        return F.lit(False) if value is None else TEXT[operator](cell, value)
    if operator not in ORDER:
        raise TabularError("filter.operator", f"unknown operator '{operator}'")
    if value is None:
        return F.lit(False)
    if kind == "double":
        return _double_order(cell, operator, float(value), constant)
    return ORDER[operator](cell, constant)


def _double_order(cell: Column, operator: str, value: float, constant: Column) -> Column:
    """NaN sorts below every number here, while Spark sorts it above."""
    nan = F.isnan(cell)
    if math.isnan(value):
        return {
            "greaterThan": cell.isNotNull() & ~nan,
            "greaterThanOrEqual": cell.isNotNull(),
            "lessThan": F.lit(False),
            "lessThanOrEqual": nan,
        }[operator]
    plain = ORDER[operator](cell, constant)
    return nan | plain if operator.startswith("less") else ~nan & plain
