"""Progress and size figures."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tablewright.schema import logical_type, quoted

# Estimated bytes of a non-null value per logical type; a null counts 1.
VALUE_BYTES = {"boolean": 1, "int64": 8, "decimal": 16, "double": 8, "timestamp": 16}
GUID_BYTES = 16


def row_bytes(df: DataFrame, guid_columns: tuple[str, ...] = ()) -> Column:
    """Estimated bytes of one row."""
    guids = {g.lower() for g in guid_columns}
    cells = []
    for f in df.schema.fields:
        cell, kind = df[quoted(f.name)], logical_type(f.dataType)
        if f.name.lower() in guids:
            size = F.lit(GUID_BYTES)
        elif kind in ("string", "binary"):
            size = F.octet_length(cell)
        else:
            size = F.lit(VALUE_BYTES[kind])
        cells.append(F.when(cell.isNull(), F.lit(1)).otherwise(size).cast("bigint"))
    return reduce(Column.__add__, cells)


def estimate_bytes(df: DataFrame, guid_columns: tuple[str, ...] = ()) -> DataFrame:
    """One row with the estimated size of the whole input."""
    return df.agg(F.coalesce(F.sum(row_bytes(df, guid_columns)), F.lit(0)).alias("estimated_bytes"))


def with_progress(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """Count rows and estimated bytes while another action runs; costs no extra pass."""
    observation = Observation(name)
    watched = df.observe(
        observation, F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("bytes")
    )
    return watched, observation


def progress_of(observation: Observation, seconds: float = 0) -> dict[str, int] | None:
    """What an observation counted, or None while no job that reads it has ended.

    Spark reports a job's counts a moment after it has ended; ``seconds`` is how long to wait for that.
    """
    until = time.monotonic() + seconds
    while not observation._jo.future().isCompleted():
        if time.monotonic() >= until:
            return None
        time.sleep(0.02)
    return dict(observation.get)
