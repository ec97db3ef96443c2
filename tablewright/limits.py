"""Opt-in budgets. They cost one counting pass and are off unless asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tablewright.errors import LimitExceeded


def require_at_most(df: DataFrame, maximum: int, code: str, what: str) -> DataFrame:
    """Fail when ``df`` has more than ``maximum`` rows; counts are combined map-side."""
    if df.count() > maximum:
        raise LimitExceeded(code, f"more than {maximum} {what}")
    return df


def within_limits(
    df: DataFrame, max_rows: int | None = None, max_columns: int | None = None, max_bytes: int | None = None
) -> DataFrame:
    """Source caps on columns (free), and on rows and estimated bytes (one pass each)."""
    if max_columns is not None and len(df.columns) > max_columns:
        raise LimitExceeded("source.columns", f"more than {max_columns} columns")
    if max_rows is not None:
        require_at_most(df, max_rows, "source.rows", "rows")
    if max_bytes is not None:
        from tablewright.oplog.metrics import estimate_bytes

        if (estimate_bytes(df).first()["estimated_bytes"] or 0) > max_bytes:
            raise LimitExceeded("source.bytes", f"more than {max_bytes} bytes")
    return df
