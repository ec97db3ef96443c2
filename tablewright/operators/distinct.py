"""Distinct rows, whole or by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.limits import require_at_most
from tablewright.operators.sort import SortKey, order_columns, sort_keys
from tablewright.operators.source_order import SOURCE, has_source_order
from tablewright.schema import check_names, column


def distinct_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_by: Sequence[SortKey | str] | None = None,
    max_keys: int | None = None,
) -> DataFrame:
    """One row per distinct row, or the whole first row per key in ``order_by`` order.

    Without ``order_by`` the source order decides, if the rows carry it, else the remaining columns, so the pick
    never depends on partitioning. The ``row_number = 1`` filter becomes a group limit that runs before the
    shuffle too: a hot key sends at most one row per map task.
    """
    if not columns:
        if has_source_order(df):
            # The first of equal rows keeps its place.
            kept = [c for c in df.columns if c != SOURCE]
            result = df.groupBy(*[column(df, c) for c in kept]).agg(F.min(SOURCE).alias(SOURCE))
        else:
            result = df.distinct()
    else:
        if len(columns) > 64:
            raise TabularError("distinct.keys", "expected at most 64 key columns")
        check_names(list(columns))
        keys = [column(df, c) for c in columns]
        chosen = {c.lower() for c in columns}
        if not order_by and has_source_order(df):
            order: list[Column] = [F.col(SOURCE)]
        else:
            ranking = sort_keys(order_by or [c for c in df.columns if c.lower() not in chosen])
            order = order_columns(df, ranking) or [keys[0].asc()]
        first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        result = df.withColumn("__rank", first).where(F.col("__rank") == 1).drop("__rank")
    if max_keys is not None:
        require_at_most(result, max_keys, "distinct.keys", "distinct keys")
    return result
