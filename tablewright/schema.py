"""Column lookup, logical types and schema checks. Nothing here runs a job."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError

MAX_NAME = 128
MAX_COLUMNS = 512


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    """The column of ``df`` with this name, ignoring case, keeping its own spelling."""
    return df[quoted(actual_name(df, name))]


def actual_name(df: DataFrame, name: str) -> str:
    for candidate in df.columns:
        if candidate.lower() == name.lower():
            return candidate
    raise TabularError("column.not_found", f"column '{name}' does not exist in the input")


def field(df: DataFrame, name: str) -> T.StructField:
    wanted = actual_name(df, name)
    return next(f for f in df.schema.fields if f.name == wanted)


def check_names(names: Sequence[str], what: str = "column") -> None:
    """1 to 512 names, trimmed, at most 128 characters, unique ignoring case."""
    if not 1 <= len(names) <= MAX_COLUMNS:
        raise TabularError("schema.columns", f"expected 1 to {MAX_COLUMNS} {what} names")
    seen: set[str] = set()
    for name in names:
        if not name or name != name.strip() or len(name) > MAX_NAME or any(ord(c) < 32 or ord(c) == 127 for c in name):
            raise TabularError("schema.name", f"invalid {what} name {name!r}")
        if name.lower() in seen:
            raise TabularError("schema.duplicate", f"duplicate {what} name '{name}'")
        seen.add(name.lower())


def logical_type(data_type: T.DataType) -> str:
    """The type family two columns must share to be joined or stacked."""
    if isinstance(data_type, T.BooleanType):
        return "boolean"
    if isinstance(data_type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "int64"
    if isinstance(data_type, T.DecimalType):
        return "decimal"
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "timestamp"
    if isinstance(data_type, T.BinaryType):
        return "binary"
    raise TabularError("schema.type", f"type {data_type.simpleString()} is outside the tabular contract")


def is_floating(df: DataFrame, name: str) -> bool:
    return logical_type(field(df, name).dataType) == "double"


def row_hash(columns: Iterable[Column]) -> Column:
    """A content hash used only to break ties and spread rows; never as an identity."""
    return F.xxhash64(*columns)


def schema_lines(df: DataFrame, keys: Sequence[str] = (), references: Sequence[str] = ()) -> list[str]:
    order = {k.lower(): i for i, k in enumerate(keys)}
    lines = [
        f"{i}|{f.name}|{f.dataType.simpleString()}|{f.nullable}|{order.get(f.name.lower(), '')}"
        for i, f in enumerate(df.schema.fields)
    ]
    return lines + sorted(references, key=str.lower)


def schema_fingerprint(df: DataFrame, keys: Sequence[str] = (), references: Sequence[str] = ()) -> str:
    """SHA-256 over ordinal, name, type, nullability, key position and foreign-key lines."""
    return hashlib.sha256("\n".join(schema_lines(df, keys, references)).encode()).hexdigest().upper()


def schema_drift(before: DataFrame, after: DataFrame) -> list[str]:
    """Human-readable differences between two schemas; empty when they agree."""
    old = {f.name.lower(): (i, f) for i, f in enumerate(before.schema.fields)}
    new = {f.name.lower(): (i, f) for i, f in enumerate(after.schema.fields)}
    drift = [f"removed {old[n][1].name}" for n in old if n not in new]
    drift += [f"added {new[n][1].name}" for n in new if n not in old]
    for name in old:
        if name not in new:
            continue
        (i, a), (j, b) = old[name], new[name]
        if a.dataType != b.dataType:
            drift.append(f"type {a.name}: {a.dataType.simpleString()} -> {b.dataType.simpleString()}")
        if a.nullable != b.nullable:
            drift.append(f"nullable {a.name}: {a.nullable} -> {b.nullable}")
        if i != j:
            drift.append(f"moved {a.name}: {i} -> {j}")
    return drift
