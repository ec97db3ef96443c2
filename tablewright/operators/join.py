"""Equi-joins with typed keys and stable output names."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.operators.source_order import without_source_order
from tablewright.schema import MAX_NAME, actual_name, column, field, logical_type, quoted

KINDS = ("inner", "left", "right", "full")


def join_output_names(left: Sequence[str], right: Sequence[str]) -> list[str]:
    """Names of the right columns after the left ones: ``right.<name>`` on collision, then ``_2``, ``_3`` …"""
    taken = {n.lower() for n in left}
    result = []
    for name in right:
        candidate, number = name, 1
        while candidate.lower() in taken:
            tail = "" if number == 1 else f"_{number}"
            candidate = f"right.{name}"[: MAX_NAME - len(tail)] + tail
            number += 1
        taken.add(candidate.lower())
        result.append(candidate)
    return result


def join(
    left: DataFrame,
    right: DataFrame,
    left_keys: Sequence[str],
    right_keys: Sequence[str],
    how: str = "inner",
    unique: str | None = None,
) -> DataFrame:
    """Join on 1 to 16 key pairs of the same type; a null key never matches.

    Output: all left columns, then all right columns (see ``join_output_names``). Source order ends here.

    ``unique`` names the side (``"left"``, ``"right"`` or ``"both"``) known to hold each key
    at most once. Adaptive execution can split a hot key on either side of an inner join,
    but of an outer join only on the preserved side. So an outer join whose other side may
    hold a hot key is built as the inner join plus the unmatched rows, found against the
    distinct keys of that side (combined map-side); both parts then split on every side.
    """
    left, right = without_source_order(left), without_source_order(right)
    if how not in KINDS:
        raise TabularError("join.type", f"unknown join type '{how}'")
    if not 1 <= len(left_keys) == len(right_keys) <= 16:
        raise TabularError("join.keys", "expected 1 to 16 key pairs")
    for a, b in zip(left_keys, right_keys):
        if logical_type(field(left, a).dataType) != logical_type(field(right, b).dataType):
            raise TabularError("join.type_mismatch", f"keys '{a}' and '{b}' have different types")
    right_names = [actual_name(right, k) for k in right_keys]
    renamed = dict(zip(right.columns, join_output_names(left.columns, right.columns)))
    right = right.select(*[right[quoted(c)].alias(renamed[c]) for c in right.columns])
    right_keys = [renamed[n] for n in right_names]
    one_pass = {
        "inner": True,
        "left": unique in ("right", "both"),
        "right": unique in ("left", "both"),
        "full": unique == "both",
    }[how]
    if one_pass and how == "full":
        # A full join splits on neither side, so rows that cannot match stay out of its shuffle.
        with_key = [_has_key(left, left_keys), _has_key(right, right_keys)]
        keyed = [left.where(with_key[0]), right.where(with_key[1])]
        joined = keyed[0].join(keyed[1], _on(keyed[0], left_keys, keyed[1], right_keys), "full")
        keyless = [_padded(side.where(~test), left, right) for side, test in zip((left, right), with_key)]
        return reduce(DataFrame.union, [joined, *keyless])
    if one_pass:
        return left.join(right, _on(left, left_keys, right, right_keys), how)
    matched = left.join(right, _on(left, left_keys, right, right_keys), "inner")
    parts = [matched]
    if how in ("left", "full"):
        parts.append(_padded(_unmatched(left, left_keys, right, right_keys), left, right))
    if how in ("right", "full"):
        parts.append(_padded(_unmatched(right, right_keys, left, left_keys), left, right))
    return reduce(DataFrame.union, parts)


def _on(left: DataFrame, left_keys, right: DataFrame, right_keys) -> Column:
    pairs = [column(left, a) == column(right, b) for a, b in zip(left_keys, right_keys)]
    return reduce(Column.__and__, pairs)


def _has_key(rows: DataFrame, keys) -> Column:
    return reduce(Column.__and__, [column(rows, k).isNotNull() for k in keys])


def _unmatched(rows: DataFrame, keys, other: DataFrame, other_keys) -> DataFrame:
    names = [f"_key{i}" for i in range(len(keys))]
    present = other.select(*[column(other, k).alias(n) for k, n in zip(other_keys, names)]).distinct()
    return rows.join(present, _on(rows, keys, present, names), "left_anti")


def _padded(rows: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of one side as full output rows, null on the other side."""
    own = set(rows.columns)
    fields = left.schema.fields + right.schema.fields
    return rows.select(
        *[
            (F.col(quoted(f.name)) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in fields
        ]
    )
