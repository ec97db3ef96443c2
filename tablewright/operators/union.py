"""Stacking inputs with strict schema checks."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame

from tablewright.errors import TabularError
from tablewright.operators.distinct import distinct_rows
from tablewright.operators.source_order import SOURCE, has_source_order, numbered_input, without_source_order
from tablewright.schema import column, logical_type, quoted


def union_rows(inputs: Sequence[DataFrame], match_by: str = "name", mode: str = "all") -> DataFrame:
    """2 to 16 inputs under the first one's names; types must agree exactly.

    ``match_by`` is ``name`` (ignoring case) or ``position``; ``mode`` is ``all`` or ``distinct``. Source order goes on
    where all inputs carry it, input by input.
    """
    if not 2 <= len(inputs) <= 16:
        raise TabularError("union.count", "expected 2 to 16 inputs")
    if match_by not in ("name", "position") or mode not in ("all", "distinct"):
        raise TabularError("union.settings", f"unknown match '{match_by}' or mode '{mode}'")
    if all(map(has_source_order, inputs)):
        inputs = [numbered_input(df, i) for i, df in enumerate(inputs)]
    else:
        inputs = [without_source_order(df) for df in inputs]
    first = inputs[0]
    aligned = [first] + [_align(first, other, match_by) for other in inputs[1:]]
    stacked = reduce(DataFrame.union, aligned)
    return distinct_rows(stacked) if mode == "distinct" else stacked


def _align(first: DataFrame, other: DataFrame, match_by: str) -> DataFrame:
    wanted = first.schema.fields
    if len(other.columns) != len(wanted):
        raise TabularError("union.incompatible", f"expected {len(wanted)} columns but found {len(other.columns)}")
    if match_by == "name":
        present = {c.lower() for c in other.columns}
        missing = [f.name for f in wanted if f.name.lower() not in present]
        if missing:
            raise TabularError("union.incompatible", f"column '{missing[0]}' is missing")
        other = other.select(*[column(other, f.name) for f in wanted])
    for target, found in zip(wanted, other.schema.fields):
        if target.name == SOURCE and found.name == SOURCE:
            continue
        if logical_type(target.dataType) != logical_type(found.dataType):
            raise TabularError(
                "union.incompatible",
                f"column '{target.name}' is {target.dataType.simpleString()} and {found.dataType.simpleString()}",
            )
    return other.select(*[other[quoted(c)].alias(f.name) for c, f in zip(other.columns, wanted)])
