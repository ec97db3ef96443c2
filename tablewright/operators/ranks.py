"""Rows by rank: the borders of a page are found by counting, and only the page is sorted.

Pivots drawn from the rows cut the order into ranges; one pass counts the rows of each. The range that holds a
border is cut again until the border's row is a pivot itself. Rows between two borders are then a filter.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.schema import row_hash

# Ranges per pass are about twice this number; borders this near the start of their range are read off a top list.
PIVOTS, NEAR = 63, 5_000


@dataclass(frozen=True)
class Term:
    """One value of a sort order; null placement does not depend on the direction."""

    cell: Column
    descending: bool = False
    nulls_first: bool = True

    @property
    def order(self) -> Column:
        if self.descending:
            return self.cell.desc_nulls_first() if self.nulls_first else self.cell.desc_nulls_last()
        return self.cell.asc_nulls_first() if self.nulls_first else self.cell.asc_nulls_last()

    def before(self, value) -> Column:
        """Whether a row's value sorts before this one."""
        if value is None:
            return F.lit(False) if self.nulls_first else self.cell.isNotNull()
        earlier = self.cell > F.lit(value) if self.descending else self.cell < F.lit(value)
        return F.coalesce(earlier, F.lit(self.nulls_first))


def _countable(df: DataFrame, terms: Sequence[Term]) -> list[Term]:
    """Times as microseconds, which pass through the driver without a time zone."""
    fields = df.select(*[t.cell.alias(f"_{i}") for i, t in enumerate(terms)]).schema.fields
    times = (T.DateType, T.TimestampType, T.TimestampNTZType)
    return [Term(F.unix_micros(t.cell.cast("timestamp")), t.descending, t.nulls_first) if isinstance(f.dataType, times) else t for t, f in zip(terms, fields)]


def _before(terms: Sequence[Term], values: Sequence) -> Column:
    tests, same = [], F.lit(True)
    for term, value in zip(terms, values):
        tests.append(same & term.before(value))
        same = same & term.cell.eqNullSafe(F.lit(value))
    return reduce(Column.__or__, tests)


def _same(terms: Sequence[Term], values: Sequence) -> Column:
    return reduce(Column.__and__, [t.cell.eqNullSafe(F.lit(v)) for t, v in zip(terms, values)])


def _counted(rows: DataFrame, terms: Sequence[Term]) -> list[tuple[tuple | None, int]]:
    """Ranges in order with their numbers of rows: a pivot's own rows under its values, those between pivots under None."""
    names = [f"_{i}" for i in range(len(terms))]
    drawn = rows.select(*[t.cell.alias(n) for t, n in zip(terms, names)]).orderBy(F.rand()).limit(PIVOTS).distinct()
    pivots = [tuple(r) for r in drawn.orderBy(*[Term(F.col(n), t.descending, t.nulls_first).order for t, n in zip(terms, names)]).collect()]

    def search(low: int, high: int) -> Column:
        if low == high:
            return F.lit(2 * low)
        middle = (low + high) // 2
        left = F.when(_before(terms, pivots[middle]), search(low, middle))
        return left.when(_same(terms, pivots[middle]), F.lit(2 * middle + 1)).otherwise(search(middle + 1, high))

    sizes = dict(map(tuple, rows.groupBy(search(0, len(pivots)).alias("range")).count().collect()))
    return [(pivots[i // 2] if i % 2 else None, sizes.get(i, 0)) for i in range(2 * len(pivots) + 1)]


def _border(rows: DataFrame, terms: Sequence[Term], rank: int) -> tuple[tuple, int] | None:
    """Order values of the row of this rank, and how many rows come before the first row with these values."""
    if rank <= NEAR:
        named = rows.select(*[t.cell.alias(f"_{i}") for i, t in enumerate(terms)])
        near = named.orderBy(*[Term(F.col(f"_{i}"), t.descending, t.nulls_first).order for i, t in enumerate(terms)]).limit(rank).collect()
        if len(near) < rank:
            return None
        last = repr(tuple(near[-1]))
        return tuple(near[-1]), sum(repr(tuple(r)) != last for r in near)
    passed, ranges = 0, _counted(rows, terms)
    for i, (values, size) in enumerate(ranges):
        if passed + size >= rank:
            break
        passed += size
    else:
        return None
    if values is not None:
        return values, passed
    if i:
        rows = rows.where(~_before(terms, ranges[i - 1][0]) & ~_same(terms, ranges[i - 1][0]))
    if i + 1 < len(ranges):
        rows = rows.where(_before(terms, ranges[i + 1][0]))
    found = _border(rows, terms, rank - passed)
    return found and (found[0], found[1] + passed)


def slice_rows(df: DataFrame, terms: Sequence[Term], offset: int, count: int) -> DataFrame:
    """Rows ``offset + 1`` to ``offset + count`` in order.

    From the start it is a plain top list. Otherwise jobs run that count rows per range, a few passes over the order's
    columns, and the result is a sorted filter: no task or driver holds what is skipped, or the whole page. Rows
    alike in all order values are told apart by a content hash, in one task; end the order with a key to avoid it.
    """
    order = [t.order for t in terms]
    if not offset:
        return df.orderBy(*order).limit(count)
    exact = _countable(df, terms)
    low = _border(df, exact, offset)
    if low is None:
        return df.limit(0)
    high = _border(df, exact, offset + count)
    ties = lambda values: df.where(_same(exact, values)).orderBy(row_hash(df[c] for c in df.columns))
    parts = []
    if high is None or high[0] != low[0]:
        inside = df.where(~_before(exact, low[0]) & ~_same(exact, low[0]))
        parts.append(inside if high is None else inside.where(_before(exact, high[0])))
        if high is not None:
            parts.append(ties(high[0]).limit(offset + count - high[1]))
        parts.append(ties(low[0]).offset(offset - low[1]))
    else:
        parts.append(ties(low[0]).offset(offset - low[1]).limit(count))
    return reduce(DataFrame.unionAll, parts).orderBy(*[t.order for t in terms])
