"""Delimited text targets: create, append and replace."""

from __future__ import annotations

import re
from collections.abc import Mapping
from datetime import datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import TypedColumn, to_text
from tablewright.schema import quoted
from tablewright.sources.delimited import first_record, read_delimited
from tablewright.targets.commits import Commit, commit, file_names, hadoop_path, latest

# Characters no variable may put into a file name, and the length bounds.
UNSAFE = set('<>:"/\\|?*')
MAX_PATH = 1024
MAX_FORMAT = 64


def write_delimited(
    df: DataFrame,
    path: str,
    header: bool = True,
    delimiter: str = ",",
    mode: str = "createNew",
    compression: str | None = None,
) -> str:
    """Write a folder of part files in invariant text form.

    ``createNew`` fails when the target exists, ``append`` needs a matching header, and ``replace`` puts new content
    in place of the old. What counts as the target's content is what its newest commit lists (see ``commits``), which
    ``read_delimited`` follows: new files count once all of them are written, and replaced ones go after that.
    """
    spark = df.sparkSession
    if mode not in ("createNew", "append", "replace"):
        raise TabularError("file.mode", f"unknown mode '{mode}'")
    # A null-only row must not become a blank line, so one-column text is always quoted.
    writer = (
        df.select(*[to_text(df[quoted(f.name)], f.dataType).alias(f.name) for f in df.schema.fields])
        .write.option("header", str(header).lower())
        .option("sep", delimiter)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", '""' if len(df.columns) == 1 else "")
        .option("ignoreLeadingWhiteSpace", "false")
        .option("ignoreTrailingWhiteSpace", "false")
    )
    if compression:
        writer = writer.option("compression", compression)
    base, before = latest(spark, path), file_names(spark, path)
    notes = {"columns": len(df.columns), "header": [c.lower() for c in df.columns] if header else None, "delimiter": delimiter}
    if mode == "append" and _exists(spark, path):
        _check_appendable(df, path, header, delimiter, base, before)
        writer.mode("append").csv(path)
        # Files that nobody listed are part of the target once they are checked.
        kept = before
    elif mode == "replace" and _exists(spark, path):
        if not base.number:
            # A folder that was not written here: its files count until the new ones are there.
            base = commit(spark, path, base, before, {})
        writer.mode("append").csv(path)
        kept = []
    else:
        writer.mode("errorifexists").csv(path)
        base, kept = latest(spark, path), []
    files = [*kept, *[f for f in file_names(spark, path) if f not in set(before)]]
    commit(spark, path, base, files, notes)
    if mode == "replace":
        for name in set(before) - set(files):
            old, fs = hadoop_path(spark, f"{path.rstrip('/')}/{name}")
            fs.delete(old, False)
    return path


def _check_appendable(df: DataFrame, path: str, header: bool, delimiter: str, base: Commit, files: list[str]) -> None:
    """The listed files were checked when they were listed; only files that came otherwise are read."""
    spark = df.sparkSession
    if base.number and base.notes:
        if base.notes["delimiter"] != delimiter or (base.notes["header"] is None) == header or (header and base.notes["header"] != [c.lower() for c in df.columns]):
            raise TabularError("file.header.mismatch", "the existing header or delimiter does not match the input")
        if base.notes["columns"] != len(df.columns):
            raise TabularError("file.columns", f"the target has {base.notes['columns']} columns")
    new = [f"{path.rstrip('/')}/{f}" for f in files if f not in set(base.files if base.notes else ())]
    if not new:
        return
    if header:
        found = [n.strip().lower() for n in first_record(spark, new, delimiter)]
        if found != [c.lower() for c in df.columns]:
            raise TabularError("file.header.mismatch", "the existing header does not match the input")
    # Every existing record must have the same arity; FAILFAST stops at the first that has not.
    found = read_delimited(spark, new, header, delimiter, columns=None if header else [TypedColumn(c) for c in df.columns])
    # A count alone would not parse the records.
    found.agg(*[F.max(F.length(found[quoted(c)])) for c in found.columns]).collect()


def _exists(spark: SparkSession, path: str) -> bool:
    target, fs = hadoop_path(spark, path)
    return fs.exists(target)


def render_path(template: str, variables: Mapping[str, object]) -> str:
    """A target path from ``{name}`` and ``{name:format}`` placeholders over run variables."""
    if not template.strip() or len(template) > MAX_PATH or any(ord(c) < 32 for c in template):
        raise TabularError("path.template", "the template is empty, too long or holds control characters")
    pieces = re.split(r"(\{[^{}]*\})", template)
    lookup = {n.lower(): v for n, v in variables.items()}
    rendered = []
    for piece in pieces:
        if not (piece.startswith("{") and piece.endswith("}")):
            if "{" in piece or "}" in piece:
                raise TabularError("path.template", "unmatched brace in the path template")
            rendered.append(piece)
            continue
        name, colon, fmt = piece[1:-1].partition(":")
        if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name) or (colon and not 1 <= len(fmt) <= MAX_FORMAT):
            raise TabularError("path.placeholder", f"invalid placeholder {piece}")
        if name.lower() not in lookup:
            raise TabularError("path.variable", f"variable '{name}' is not available")
        text = _path_value(name, lookup[name.lower()], fmt or None)
        if not text.strip() or text in (".", "..") or any(c in UNSAFE or ord(c) < 32 for c in text):
            raise TabularError("path.unsafe", f"variable '{name}' gives unsafe characters")
        rendered.append(text)
    path = "".join(rendered)
    if len(path) > MAX_PATH:
        raise TabularError("path.length", f"the path is longer than {MAX_PATH} characters")
    return path


GUID = re.compile(r"[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")

# Date-format letters and their strftime counterparts, longest first.
DATE_FIELDS = (
    ("yyyy", "%Y"), ("yy", "%y"), ("MM", "%m"), ("dd", "%d"), ("HH", "%H"), ("mm", "%M"), ("ss", "%S"),
)


def _path_value(name: str, value, fmt: str | None) -> str:
    if value is None:
        raise TabularError("path.null", f"variable '{name}' is null")
    if isinstance(value, bool):
        if fmt:
            raise TabularError("path.format", f"variable '{name}' takes no format")
        return str(value)
    if isinstance(value, datetime):
        return _format_moment(value, fmt or "yyyyMMdd_HHmmss_fff")
    if isinstance(value, (int, float, Decimal)):
        return _format_number(name, value, fmt)
    if isinstance(value, str):
        if GUID.fullmatch(value) and (fmt or "N") in ("N", "D", "B", "P"):
            bare = value.replace("-", "")
            return {"N": bare, "D": value, "B": f"{{{value}}}", "P": f"({value})"}[fmt or "N"]
        if fmt is None:
            return value
    raise TabularError("path.format", f"variable '{name}' cannot be formatted with '{fmt}'")


def _format_moment(value: datetime, fmt: str) -> str:
    fields = dict(DATE_FIELDS)
    fraction = f"{value.microsecond:06d}0"

    def one(match: re.Match) -> str:
        token = match.group(0)
        return fraction[: len(token)] if token[0] == "f" else value.strftime(fields[token])

    return re.sub("|".join(f for f, _ in DATE_FIELDS) + r"|f{1,7}", one, fmt)


def _format_number(name: str, value, fmt: str | None) -> str:
    if fmt is None:
        return str(value)
    zeros = re.fullmatch(r"0+", fmt)
    if zeros and isinstance(value, int):
        return f"{'-' if value < 0 else ''}{abs(value):0{len(fmt)}d}"
    standard = re.fullmatch(r"([DdFfNn])(\d{0,2})", fmt)
    if standard:
        letter, digits = standard.group(1).upper(), standard.group(2)
        if letter == "D" and isinstance(value, int):
            return f"{'-' if value < 0 else ''}{abs(value):0{int(digits or 1)}d}"
        if letter == "F":
            return f"{value:.{int(digits or 2)}f}"
        if letter == "N":
            return f"{value:,.{int(digits or 2)}f}"
    raise TabularError("path.format", f"variable '{name}' uses an unsupported format '{fmt}'")
