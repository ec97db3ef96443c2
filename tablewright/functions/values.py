"""Typed values: strict text parsing, invariant text form, literals, size estimates.

Everything is a Column expression, so it stays inside code generation.
"""

from __future__ import annotations

import base64
import re
from dataclasses import dataclass
from datetime import date, datetime, timezone
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError, marked
from tablewright.schema import check_names, logical_type, quoted

# The logical column types and their Spark types.
LOGICAL_TYPES: dict[str, T.DataType] = {
    "boolean": T.BooleanType(),
    "int64": T.LongType(),
    "decimal": T.DecimalType(38, 10),
    "double": T.DoubleType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
    "guid": T.StringType(),
    "binary": T.BinaryType(),
}

# Accepted text formats (Java regular expressions).
DIGITS = r"(?:\d[\d,]*(?:\.\d*)?|\.\d+)"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
DECIMAL_TEXT = rf"^\s*(?:[+-]{DIGITS}|{DIGITS}\s*[+-]?)\s*$"
DOUBLE_TEXT = rf"(?i)^\s*(?:[+-]?{DIGITS}(?:e[+-]?\d+)?|[+-]?infinity|[+-]?nan)\s*$"
PLAIN_DOUBLE_TEXT = r"(?i)^\s*(?:[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:e[+-]?\d+)?)\s*$"
GUID_TEXT = (
    r"(?i)^\s*(?:[0-9a-f]{32}|[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}"
    r"|\{[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\}|\([0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\))\s*$"
)
BASE64_TEXT = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
ISO_DATE = r"\d{4}-\d{1,2}-\d{1,2}"
US_DATE = r"\d{1,2}/\d{1,2}/\d{4}"
CLOCK = r"\d{1,2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?"
FULL_CLOCK = r"\d{1,2}:\d{2}:\d{2}(?:\.\d{1,9})?"
WHITESPACE = " \t\n\x0b\x0c\r"
OFFSET = r"(?:Z|z|[+-]\d{1,2}:\d{2})"
DATE_TEXT = rf"^\s*(?:{ISO_DATE}|{US_DATE})\s*$"
TIMESTAMP_TEXT = rf"^\s*(?:{ISO_DATE}|{US_DATE})(?:[T ]\s*{CLOCK}\s*{OFFSET}?)?\s*$"
TIME_TEXT = r"^\s*(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d(?:\.\d{1,7})?)?\s*$"


@dataclass(frozen=True)
class TypedColumn:
    """A configured column of a delimited file, workbook or derived output."""

    name: str
    type: str = "string"
    nullable: bool = True
    scale: int = 10

    def __post_init__(self):
        if self.type not in LOGICAL_TYPES:
            raise TabularError("column.type", f"unknown type '{self.type}'")

    @property
    def spark_type(self) -> T.DataType:
        return T.DecimalType(38, self.scale) if self.type == "decimal" else LOGICAL_TYPES[self.type]


def typed_columns(columns) -> list[TypedColumn]:
    """Accept ``TypedColumn`` objects or plain dicts."""
    result = [c if isinstance(c, TypedColumn) else TypedColumn(**c) for c in columns]
    check_names([c.name for c in result])
    return result


def fail(code: str, message: str) -> Column:
    return F.raise_error(F.lit(marked(f"{code}: {message}")))


def try_timestamp(text: Column) -> Column:
    """UTC timestamp or null; text without an offset is read as UTC.

    The common ISO forms take one pattern and one cast; only the rest is rewritten first.
    """
    loose = F.regexp_replace(F.trim(text), r"^(\d{1,2})/(\d{1,2})/(\d{4})", "$3-$1-$2")
    # Seconds are optional in the text but not in the cast.
    timed = F.regexp_replace(loose, r"^(\S+[T ]\s*\d{1,2}:\d{2})(?![:\d])", "$1:00")
    rewritten = (
        F.when(timed.rlike(rf"^{ISO_DATE}$"), F.concat(timed, F.lit(" 00:00:00Z")))
        .when(timed.rlike(rf"{CLOCK}\s*{OFFSET}$"), timed)
        .otherwise(F.concat(timed, F.lit("Z")))
    )
    return (
        F.when(text.rlike(rf"^{ISO_DATE}[T ]{FULL_CLOCK}{OFFSET}$"), text.try_cast("timestamp"))
        .when(text.rlike(rf"^{ISO_DATE}$"), F.concat(text, F.lit(" 00:00:00Z")).try_cast("timestamp"))
        .when(text.rlike(rf"^{ISO_DATE}[T ]{FULL_CLOCK}$"), F.concat(text, F.lit("Z")).try_cast("timestamp"))
        .when(text.rlike(TIMESTAMP_TEXT), F.upper(rewritten).try_cast("timestamp"))
    )


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def try_parse(text: Column, kind: str, scale: int = 10) -> Column:
    """The typed value, or null when the text does not fit the type."""
    if kind == "string":
        return text
    if kind == "boolean":
        word = F.lower(F.trim(text))
        return F.when(word == "true", F.lit(True)).when(word == "false", F.lit(False))
    if kind == "int64":
        return F.when(text.rlike(INTEGER_TEXT), F.trim(text).try_cast("bigint"))
    if kind == "decimal":
        bare = _without(text, "," + WHITESPACE)
        # A trailing sign moves to the front.
        signed = F.when(bare.endswith("-"), F.concat(F.lit("-"), F.rtrim(bare, F.lit("-")))).otherwise(
            F.rtrim(bare, F.lit("+"))
        )
        return F.when(text.rlike(DECIMAL_TEXT), signed.try_cast(T.DecimalType(38, scale)))
    if kind == "double":
        bare = _without(text, "," + WHITESPACE)
        plain = F.when(F.lower(bare).contains("nan"), F.lit(float("nan"))).otherwise(bare.try_cast("double"))
        return F.when(text.rlike(DOUBLE_TEXT), plain)
    if kind == "timestamp":
        return try_timestamp(text)
    if kind == "guid":
        bare = F.lower(_without(text, "{}()-" + WHITESPACE))
        return F.when(
            text.rlike(GUID_TEXT),
            F.regexp_replace(bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
        )
    if kind == "binary":
        bare = _without(text, WHITESPACE)
        return F.when(bare.rlike(BASE64_TEXT), F.unbase64(bare))
    raise TabularError("column.type", f"unknown type '{kind}'")


def parse_text(
    text: Column, kind: str, nullable: bool = True, name: str = "value", max_chars: int | None = None, scale: int = 10
) -> Column:
    """Invariant text to a typed value; empty text is null except for strings, bad text fails the job."""
    empty = text.isNull() if kind == "string" else (text.isNull() | (text == ""))
    if_empty = (
        F.lit(None) if nullable else fail("value.null", f"column '{name}' does not allow an empty value")
    )
    if kind == "string":
        if max_chars is None:
            value = text
        else:
            value = F.when(F.char_length(text) <= max_chars, text).otherwise(
                fail("value.format", f"column '{name}' is longer than {max_chars} characters")
            )
    else:
        parsed = try_parse(text, kind, scale)
        # coalesce, not a null test: the parser runs once per value.
        value = F.coalesce(parsed, fail("value.format", f"a value in column '{name}' is not a valid {kind}"))
    target = T.DecimalType(38, scale) if kind == "decimal" else LOGICAL_TYPES[kind]
    return F.when(empty, if_empty).otherwise(value).cast(target)


def double_text(value: Column) -> Column:
    """Shortest round-trip text: plain from 1e-4 up to 1e15, else ``dE+XX``."""
    raw = value.cast("string")
    magnitude = F.abs(value)
    plain = F.regexp_replace(
        F.regexp_replace(raw.try_cast(T.DecimalType(38, 20)).cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""
    )
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    exponent = F.substring_index(raw, "E", -1).try_cast("int")
    scientific = F.concat(
        mantissa,
        F.when(exponent < 0, "E-").otherwise("E+"),
        F.when(F.abs(exponent) < 10, F.lpad(F.abs(exponent).cast("string"), 2, "0")).otherwise(
            F.abs(exponent).cast("string")
        ),
    )
    return (
        F.when(F.isnan(value) | (magnitude == float("inf")), raw)
        .when(value == 0.0, F.when(raw.startswith("-"), "-0").otherwise("0"))
        .when((magnitude >= 1e-4) & (magnitude < 1e15), plain)
        .otherwise(scientific)
    )


def to_text(value: Column, data_type: T.DataType) -> Column:
    """Invariant text form of a typed value; null becomes empty text."""
    kind = logical_type(data_type)
    if kind == "boolean":
        text = F.when(value, "True").otherwise("False")
    elif kind == "double":
        text = double_text(value.cast("double"))
    elif kind == "timestamp":
        text = F.date_format(value.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSSxxx")
    elif kind == "binary":
        text = F.regexp_replace(F.base64(value), r"[\r\n]", "")
    else:
        text = value.cast("string")
    return F.when(value.isNull(), "").otherwise(text)


def normalise_types(df: DataFrame) -> DataFrame:
    """Provider types to the logical types: wider integers and floats, UTC timestamps."""
    casts = []
    for f in df.schema.fields:
        kind = logical_type(f.dataType)
        target = f.dataType if kind == "decimal" else LOGICAL_TYPES[kind]
        source = df[quoted(f.name)]
        casts.append((source if f.dataType == target else source.cast(target)).alias(f.name))
    return df.select(*casts)


def _utc(value) -> datetime:
    if isinstance(value, datetime):
        moment = value
    elif isinstance(value, date):
        moment = datetime(value.year, value.month, value.day)
    else:
        moment = datetime.fromisoformat(str(value).strip())
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def literal(value, data_type: T.DataType, name: str = "value") -> Column:
    """A typed constant checked on the driver; Catalyst folds it, so filters still push down."""
    if value is None:
        return F.lit(None).cast(data_type)
    kind = logical_type(data_type)
    try:
        if kind == "boolean":
            if not isinstance(value, bool) and str(value).strip().lower() not in ("true", "false"):
                raise ValueError("not a boolean")
            return F.lit(value if isinstance(value, bool) else str(value).strip().lower() == "true")
        if kind == "string":
            if not isinstance(value, str):
                raise ValueError("not text")
            return F.lit(value)
        if isinstance(value, bool):
            raise ValueError("a boolean")
        if kind == "int64":
            number = value if isinstance(value, int) else int(str(value))
            return F.lit(number).cast("bigint")
        if kind == "decimal":
            return F.lit(Decimal(str(value).replace(",", ""))).cast(data_type)
        if kind == "double":
            return F.lit(float(str(value).replace(",", "")))
        if kind == "timestamp":
            moment = _utc(value)
            if isinstance(data_type, T.TimestampType):
                return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%fZ")).cast(data_type)
            return F.lit(moment.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp_ntz").cast(data_type)
        return F.lit(bytes(value) if isinstance(value, (bytes, bytearray)) else base64.b64decode(value, validate=True))
    except (ValueError, ArithmeticError) as error:
        raise TabularError("value.format", f"constant {value!r} does not fit column '{name}': {error}") from error


def normalise_guid_text(value: str) -> str:
    """Driver-side form of the GUID rule, for constants and run variables."""
    if not re.match(GUID_TEXT.removeprefix("(?i)"), value, re.IGNORECASE):
        raise TabularError("value.format", f"{value!r} is not a GUID")
    bare = re.sub(r"[\s{}()-]", "", value).lower()
    return f"{bare[:8]}-{bare[8:12]}-{bare[12:16]}-{bare[16:20]}-{bare[20:]}"
