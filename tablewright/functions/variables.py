"""Run variables and reusable expression functions."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import LOGICAL_TYPES, literal, normalise_guid_text

# Names an expression function may not take, and its bounds.
RESERVED_NAMES = ("row", "vars", "run", "time")
MAX_FUNCTIONS = 32
MAX_PARAMETERS = 8
MAX_VARIABLES = 64
NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def run_variables(
    run_id: str, started_at: datetime, literals: Mapping[str, tuple[str, object]] | None = None
) -> dict[str, object]:
    """Values frozen at run start: built-ins plus typed literals ``name -> (type, value)``.

    A looked-up value (see ``lookup_value``) is passed as a literal of its type.
    """
    start = started_at.astimezone(timezone.utc) if started_at.tzinfo else started_at.replace(tzinfo=timezone.utc)
    values: dict[str, object] = {
        "runId": normalise_guid_text(run_id),
        "runStartedAtUtc": start,
        "utcToday": start.replace(hour=0, minute=0, second=0, microsecond=0),
    }
    if literals and len(literals) > MAX_VARIABLES:
        raise TabularError("variable.count", f"at most {MAX_VARIABLES} variables")
    taken = {n.lower() for n in values}
    for name, (kind, value) in (literals or {}).items():
        if not NAME.match(name) or name.lower() in taken:
            raise TabularError("variable.name", f"invalid or repeated variable '{name}'")
        taken.add(name.lower())
        values[name] = typed_value(kind, value, name)
    return values


def typed_value(kind: str, value, name: str):
    """A variable's Python value, checked against its declared type."""
    if value is None:
        return None
    text = str(value).strip()
    try:
        if kind == "boolean":
            if text.lower() not in ("true", "false"):
                raise ValueError("not a boolean")
            return text.lower() == "true"
        if kind == "int64":
            number = int(text)
            if not -(2**63) <= number < 2**63:
                raise ValueError("outside the 64-bit range")
            return number
        if kind == "decimal":
            return Decimal(text.replace(",", ""))
        if kind == "double":
            return float(text.replace(",", ""))
        if kind == "string":
            return str(value)
        if kind == "timestamp":
            moment = value if isinstance(value, datetime) else datetime.fromisoformat(text)
            return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)
        if kind == "guid":
            return normalise_guid_text(text)
    except (ValueError, ArithmeticError) as error:
        raise TabularError("variable.value", f"variable '{name}' is not a valid {kind}") from error
    raise TabularError("variable.type", f"variable '{name}' has unsupported type '{kind}'")


def as_column(value) -> Column:
    """A frozen constant; never evaluated again per row."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return literal(value, T.TimestampType())
    if isinstance(value, Decimal):
        return F.lit(value).cast(LOGICAL_TYPES["decimal"])
    if isinstance(value, int) and not isinstance(value, bool):
        return F.lit(value).cast("bigint")
    return F.lit(value)


def vars_struct(variables: Mapping[str, object]) -> Column:
    return F.struct(*[as_column(v).alias(n) for n, v in variables.items()]).alias("vars")


def register_functions(
    spark: SparkSession, functions: Mapping[str, tuple[Mapping[str, str], str, str]]
) -> list[str]:
    """Single-expression functions ``name -> ({parameter: type}, return type, expression)``.

    They become temporary SQL functions, which Catalyst inlines into the plan.
    """
    if len(functions) > MAX_FUNCTIONS:
        raise TabularError("function.count", f"at most {MAX_FUNCTIONS} functions")
    for name, (parameters, returns, expression) in functions.items():
        if not NAME.match(name) or name.lower() in RESERVED_NAMES:
            raise TabularError("function.name", f"invalid or reserved function name '{name}'")
        if len(parameters) > MAX_PARAMETERS or any(not NAME.match(p) for p in parameters):
            raise TabularError("function.parameters", f"function '{name}' takes at most {MAX_PARAMETERS} named parameters")
        signature = ", ".join(f"{p} {t}" for p, t in parameters.items())
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({signature}) RETURNS {returns} RETURN {expression}")
    return list(functions)


def lookup_value(df: DataFrame, value_column: str, filter_column: str, filter_value, kind: str | None = None):
    """The one value of ``value_column`` where ``filter_column`` equals the constant.

    At most two rows reach the driver; none and several are distinct errors.
    """
    from tablewright.schema import column, field

    constant = literal(filter_value, field(df, filter_column).dataType, filter_column)
    rows = df.where(column(df, filter_column) == constant).select(column(df, value_column)).limit(2).collect()
    if not rows:
        raise TabularError("lookup.none", "the lookup matched no row")
    if len(rows) > 1:
        raise TabularError("lookup.many", "the lookup matched more than one row")
    return rows[0][0] if kind is None else typed_value(kind, rows[0][0], value_column)
