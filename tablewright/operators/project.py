"""Projection and derived columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import TypedColumn, fail, to_text, try_parse, typed_columns
from tablewright.functions.variables import vars_struct
from tablewright.operators.source_order import SOURCE, has_source_order
from tablewright.schema import check_names, column, logical_type, quoted


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The named columns in the given order, spelled as in the input; no rename, no cast. Source order goes along."""
    check_names(list(columns))
    hidden = [SOURCE] if has_source_order(df) else []
    return df.select(*[column(df, name) for name in columns], *hidden)


def coerce(value: Column, source: T.DataType, target: TypedColumn) -> Column:
    """An expression result to its declared type; text results are parsed strictly."""
    if isinstance(source, T.NullType):
        return value.cast(target.spark_type)
    kind = logical_type(source)
    if target.type in ("guid", "binary", "timestamp", "decimal") and kind == "string":
        parsed = try_parse(value, target.type, target.scale)
        if target.type == "decimal":
            # Derived decimals also take exponent text.
            parsed = F.coalesce(parsed, F.trim(value).try_cast(target.spark_type))
        bad = fail("value.format", f"column '{target.name}' is not a valid {target.type}")
        return F.when(value.isNotNull(), F.coalesce(parsed, bad))
    allowed = {
        "boolean": {"boolean"},
        "int64": {"int64", "decimal", "double"},
        "decimal": {"int64", "decimal", "double"},
        "double": {"int64", "decimal", "double"},
        "string": {"boolean", "int64", "decimal", "double", "string", "timestamp"},
        "timestamp": {"timestamp"},
        "guid": set(),
        "binary": {"binary"},
    }[target.type]
    if kind not in allowed:
        raise TabularError("derive.type", f"column '{target.name}': {kind} cannot become {target.type}")
    if target.type == "string" and kind in ("double", "timestamp"):
        return F.when(value.isNotNull(), to_text(value, source))
    return value.cast(target.spark_type)


def derive_columns(
    df: DataFrame, columns: Sequence[Mapping], variables: Mapping[str, Column] | None = None
) -> DataFrame:
    """Append typed columns computed from the input row.

    Each item has ``name``, ``expression`` and optionally ``type``, ``nullable``, ``scale``.
    Expressions are Spark SQL over the input columns (plainly or as ``row.<column>``),
    run variables (``vars.<name>``) and registered functions. Siblings are not visible.
    """
    if not 1 <= len(columns) <= 64:
        raise TabularError("derive.count", "expected 1 to 64 derived columns")
    declared = typed_columns([{k: v for k, v in c.items() if k != "expression"} for c in columns])
    taken = {c.lower() for c in df.columns}
    for target in declared:
        if target.name.lower() in taken:
            raise TabularError("derive.collision", f"column '{target.name}' already exists")
    scope = with_variables(df, variables)
    # One analysis pass gives every expression its type, without running a job.
    raw = [F.expr(c["expression"]) for c in columns]
    types = [f.dataType for f in scope.select(*[e.alias(f"_{i}") for i, e in enumerate(raw)]).schema.fields]
    added = []
    for target, value, source in zip(declared, raw, types):
        typed = coerce(value, source, target)
        if not target.nullable:
            typed = require_value(typed, target.name)
        added.append(typed.alias(target.name))
    return scope.select(*[F.col(f"row.{quoted(c)}") for c in df.columns], *added)


def with_variables(df: DataFrame, variables: Mapping[str, Column] | None) -> DataFrame:
    """The input aliased ``row`` with a constant struct ``vars`` next to it."""
    if not variables:
        return df.alias("row")
    if any(c.lower() == "vars" for c in df.columns):
        raise TabularError("derive.reserved", "an input column is named 'vars'")
    return df.select("*", vars_struct(variables)).alias("row")


def require_value(value: Column, name: str) -> Column:
    """Null fails the job."""
    return F.coalesce(value, fail("value.null", f"column '{name}' must not be null"))
