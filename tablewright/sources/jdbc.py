"""Relational tables over JDBC: one table or view, no SQL text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import normalise_types
from tablewright.schema import column

# Identifier quotes per database kind.
IDENTIFIER_QUOTES = {
    "sqlserver": ("[", "]"),
    "mysql": ("`", "`"),
    "postgresql": ('"', '"'),
    "oracle": ('"', '"'),
    "derby": ('"', '"'),
}


def database_kind(url: str) -> str:
    parts = url.split(":")
    if len(parts) < 3 or parts[0] != "jdbc" or parts[1] not in IDENTIFIER_QUOTES:
        raise TabularError("jdbc.url", f"unsupported database url '{url}'")
    return parts[1]


def quote_identifier(kind: str, name: str) -> str:
    if not name.strip() or len(name) > 128 or any(ord(c) < 32 for c in name):
        raise TabularError("jdbc.identifier", f"invalid identifier {name!r}")
    opening, closing = IDENTIFIER_QUOTES[kind]
    return opening + name.replace(closing, closing * 2) + closing


def qualified_name(kind: str, table: str, schema: str | None) -> str:
    return ".".join(quote_identifier(kind, part) for part in (schema, table) if part)


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    schema: str | None = None,
    columns: Sequence[str] | None = None,
    partition: Mapping | None = None,
    fetch_size: int = 1000,
    properties: Mapping[str, str] | None = None,
) -> DataFrame:
    """A table or view with logical types; filters and projections push down to the database.

    ``partition`` is ``{"column", "count"}`` for parallel reads; the bounds come from
    ``{"lower", "upper"}`` or from one pushed-down min/max query.
    """
    if not 1 <= fetch_size <= 10_000:
        raise TabularError("jdbc.fetch_size", "the fetch size is 1 to 10,000 rows")
    kind = database_kind(url)
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", qualified_name(kind, table, schema))
        .option("fetchsize", fetch_size)
        .options(**(properties or {}))
    )
    whole = reader.load()
    if partition is not None:
        key = partition["column"]
        lower, upper = partition.get("lower"), partition.get("upper")
        if lower is None or upper is None:
            lower, upper = whole.agg(F.min(column(whole, key)), F.max(column(whole, key))).first()
        if lower is not None:
            whole = (
                reader.option("partitionColumn", quote_identifier(kind, column_name(whole, key)))
                .option("lowerBound", str(lower))
                .option("upperBound", str(upper))
                .option("numPartitions", partition["count"])
                .load()
            )
    if columns is not None:
        whole = whole.select(*[column(whole, c) for c in columns])
    return normalise_types(whole)


def column_name(df: DataFrame, name: str) -> str:
    from tablewright.schema import actual_name

    return actual_name(df, name)
