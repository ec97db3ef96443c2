"""Delimited text folders: strict header, strict typing, no value inference."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import TypedColumn, fail, parse_text, typed_columns
from tablewright.schema import check_names, quoted
from tablewright.sources.records import quoted_records


def _options(delimiter: str, embedded_newlines: bool) -> dict[str, str]:
    if len(delimiter) != 1:
        raise TabularError("file.delimiter", "the delimiter is one character")
    return {
        "sep": delimiter,
        "quote": '"',
        "escape": '"',
        "multiLine": str(embedded_newlines).lower(),
        "encoding": "UTF-8",
        # A ragged record fails even when the query needs only some of its columns.
        "columnPruning": "false",
    }


def committed(spark: SparkSession, path: str | Sequence[str]) -> str | list[str]:
    """The files that count, where a folder has commits."""
    from tablewright.targets.commits import latest

    if not isinstance(path, str):
        return list(path)
    state = latest(spark, path)
    return [f"{path.rstrip('/')}/{f}" for f in state.files] if state.files else path


def first_record(spark: SparkSession, path: str | Sequence[str], delimiter: str = ",", embedded_newlines: bool = True) -> list[str]:
    """The first record of the first file; one record reaches the driver."""
    path = committed(spark, path)
    head = spark.read.options(**_options(delimiter, embedded_newlines)).csv(path).limit(1).collect()
    if not head:
        raise TabularError("file.empty", "the delimited input is empty")
    return [value or "" for value in head[0]]


def delimited_schema(
    spark: SparkSession,
    path: str | Sequence[str],
    has_header: bool = True,
    delimiter: str = ",",
    columns: Sequence[TypedColumn | dict] | None = None,
    embedded_newlines: bool = True,
    max_columns: int = 1024,
) -> tuple[list[TypedColumn], list[str] | None]:
    """Typed columns, and the header as it stands in the file."""
    configured = typed_columns(columns) if columns is not None else None
    if not has_header and configured is None:
        raise TabularError("file.columns.required", "files without a header need explicit columns")
    header = first_record(spark, path, delimiter, embedded_newlines) if has_header else None
    if header is not None:
        header[0] = header[0].lstrip("﻿")
        trimmed = [name.strip() for name in header]
        if configured is None:
            check_names(trimmed)
            configured = [TypedColumn(name) for name in trimmed]
        elif [n.lower() for n in trimmed] != [c.name.lower() for c in configured]:
            raise TabularError("file.header.mismatch", "the header does not match the configured columns")
    if not 1 <= len(configured) <= max_columns:
        raise TabularError("file.columns", f"expected 1 to {max_columns} columns")
    return configured, header


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    has_header: bool = True,
    delimiter: str = ",",
    columns: Sequence[TypedColumn | dict] | None = None,
    embedded_newlines: bool = True,
    max_columns: int = 1024,
) -> DataFrame:
    """A file, a folder or several files of quoted text; every file must carry the same header.

    Of a folder that ``write_delimited`` made the files of its newest commit are read.

    Ragged rows, misplaced quotes and values that do not fit their type fail the job. Files of every size and with
    either line end are read in blocks (see ``records``), at the cost of one shuffle of the lines; line breaks inside
    quotes stay as they are, or fail the job with ``embedded_newlines=False``.
    """
    path = committed(spark, path)
    typed, _ = delimited_schema(spark, path, has_header, delimiter, columns, embedded_newlines, max_columns)
    schema = T.StructType([T.StructField(f"_{i}", T.StringType()) for i in range(len(typed))])
    options = {"sep": delimiter, "quote": '"', "escape": '"', "mode": "FAILFAST", "columnPruning": "false"}
    records = quoted_records(spark, path, delimiter, embedded_newlines)
    cells = records.select("head", F.from_csv("record", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), options).alias("cells"))
    if has_header:
        found = F.array(*[F.lower(F.trim(F.coalesce(f"cells._{i}", F.lit("")))) for i in range(len(typed))])
        wanted = F.array(*[F.lit(c.name.lower()) for c in typed])
        wrong = fail("file.header.mismatch", "a file's header does not match the columns").cast("boolean")
        # A header record is left out, or fails the job when it is not the expected one.
        cells = cells.where(F.when(~F.col("head"), True).when(found == wanted, False).otherwise(wrong))
    return cells.select(*[_cell(F.col(f"cells._{i}"), c).alias(c.name) for i, c in enumerate(typed)])


def _cell(text, column: TypedColumn):
    if column.type == "string":
        # The reader gives null for empty text; text columns keep it as "".
        return F.coalesce(text, F.lit(""))
    return parse_text(text, column.type, column.nullable, column.name, scale=column.scale)


def read_tab_delimited(spark: SparkSession, path: str | Sequence[str], **options) -> DataFrame:
    """``read_delimited`` with the tab format."""
    return read_delimited(spark, path, delimiter="\t", **options)
