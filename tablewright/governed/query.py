"""Reading a governed table: typed filters, stable order, keyset pages, cursors, counts."""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.functions.values import literal, normalise_guid_text
from tablewright.governed.contract import ContractColumn, TableContract
from tablewright.schema import column

MAX_FILTERS = 16
MAX_SORTS = 8
MAX_PAGE = 2000
MAX_CURSOR = 8192
SEAL = 16

# Filter operator tokens.
COMPARISONS = {
    "eq": Column.__eq__,
    "ne": Column.__ne__,
    "gt": Column.__gt__,
    "ge": Column.__ge__,
    "lt": Column.__lt__,
    "le": Column.__le__,
}
TEXT_TESTS = {"startswith": Column.startswith, "contains": Column.contains}
NULL_TESTS = ("isnull", "isnotnull")

Filter = tuple[str, str, str | None]
Sort = tuple[str, bool]


def constant(value, c: ContractColumn) -> Column:
    if c.type == "guid" and value is not None:
        value = normalise_guid_text(str(value))
    return literal(value, c.spark_type, c.alias)


def where_contract(df: DataFrame, contract: TableContract, filters: Sequence[Filter]) -> DataFrame:
    """Rows passing every ``(alias, operator, value)`` under SQL three-valued logic.

    Unlike ``filter_rows``, ``ne`` drops nulls here.
    """
    if len(filters) > MAX_FILTERS:
        raise TabularError("query.filters", f"at most {MAX_FILTERS} filters")
    tests = [_test(df, contract, *f) for f in filters]
    return df.where(reduce(Column.__and__, tests)) if tests else df


def _test(df: DataFrame, contract: TableContract, alias: str, operator: str, value=None) -> Column:
    c = contract.find(alias)
    if not c.readable or not c.filterable:
        raise TabularError("query.filter", f"'{alias}' cannot be filtered")
    cell = column(df, c.alias)
    if operator in NULL_TESTS:
        if value is not None:
            raise TabularError("query.filter", f"'{operator}' takes no value")
        return cell.isNull() if operator == "isnull" else cell.isNotNull()
    if value is None or len(str(value)) > 4096:
        raise TabularError("query.filter", f"'{operator}' needs a value of at most 4,096 characters")
    if operator in TEXT_TESTS:
        if c.type != "string":
            raise TabularError("query.filter", f"'{operator}' needs a text column")
        return TEXT_TESTS[operator](cell, str(value))
    if operator not in COMPARISONS:
        raise TabularError("query.filter", f"unknown operator '{operator}'")
    return COMPARISONS[operator](cell, constant(value, c))


def count_rows(df: DataFrame, contract: TableContract, filters: Sequence[Filter] = ()) -> DataFrame:
    """One row with the number of rows passing the filters."""
    return where_contract(df, contract, filters).agg(F.count(F.lit(1)).alias("row_count"))


def stable_sorts(contract: TableContract, sorts: Sequence[Sort]) -> list[tuple[ContractColumn, bool]]:
    """The requested sorts, then every missing key column ascending."""
    if len(sorts) > MAX_SORTS:
        raise TabularError("query.sorts", f"at most {MAX_SORTS} sorts")
    result: list[tuple[ContractColumn, bool]] = []
    for alias, descending in sorts:
        c = contract.find(alias)
        if not c.readable or not c.sortable or any(c is s for s, _ in result):
            raise TabularError("query.sort", f"'{alias}' cannot be sorted on, or is repeated")
        result.append((c, descending))
    if not contract.keys:
        raise TabularError("query.sort", "paging needs a key")
    result += [(k, False) for k in contract.keys if not any(k is s for s, _ in result)]
    return result


def order_columns(df: DataFrame, terms: Sequence[tuple[ContractColumn, bool]]) -> list[Column]:
    """Nulls come first ascending and last descending."""
    return [
        column(df, c.alias).desc_nulls_last() if descending else column(df, c.alias).asc_nulls_first()
        for c, descending in terms
    ]


def after_predicate(df: DataFrame, terms: Sequence[tuple[ContractColumn, bool]], after: Sequence) -> Column:
    """Rows strictly after a sort tuple, folded from the last term: beyond this one, or equal and after the rest."""
    rest = F.lit(False)
    for (c, descending), value in reversed(list(zip(terms, after, strict=True))):
        cell = column(df, c.alias)
        if value is None:
            beyond, equal = F.lit(False) if descending else cell.isNotNull(), cell.isNull()
        else:
            mark = constant(value, c)
            beyond, equal = (cell < mark) | cell.isNull() if descending else cell > mark, cell == mark
        rest = beyond | (equal & rest)
    return rest


def keyset_page(
    df: DataFrame, contract: TableContract, sorts: Sequence[Sort] = (), after: Sequence | None = None, take: int = 100
) -> DataFrame:
    """The next ``take`` rows and one more, which tells whether another page follows."""
    if not 1 <= take <= MAX_PAGE:
        raise TabularError("query.take", f"a page holds 1 to {MAX_PAGE} rows")
    terms = stable_sorts(contract, sorts)
    rows = df if after is None else df.where(after_predicate(df, terms, after))
    return rows.orderBy(*order_columns(df, terms)).limit(take + 1)


@dataclass(frozen=True)
class Page:
    rows: list[Row]
    next_cursor: str | None


def read_page(
    df: DataFrame,
    contract: TableContract,
    fingerprint: str,
    filters: Sequence[Filter] = (),
    sorts: Sequence[Sort] = (),
    cursor: str | None = None,
    take: int = 100,
) -> Page:
    """One page on the driver (at most 2,000 rows) with the cursor of the next one."""
    terms = stable_sorts(contract, sorts)
    after = None if cursor is None else decode_cursor(cursor, fingerprint, filters, terms)
    rows = keyset_page(where_contract(df, contract, filters), contract, sorts, after, take).collect()
    more = len(rows) > take
    rows = rows[:take]
    return Page(rows, encode_cursor(fingerprint, filters, terms, rows[-1]) if more else None)


def _cursor_text(value) -> str | None:
    if value is None:
        return None
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat() if value.tzinfo else value.isoformat()
    if isinstance(value, date):
        return value.isoformat()
    if isinstance(value, (bytes, bytearray)):
        return base64.b64encode(value).decode()
    return repr(value) if isinstance(value, float) else str(value)


def _seal(body: bytes, fingerprint: str, filters: Sequence[Filter], terms) -> bytes:
    """A digest of the sort tuple and everything it is valid for; the order of the filters does not matter."""
    tests = sorted(repr((alias.casefold(), test, *value)) for alias, test, *value in filters)
    order = [(c.alias, c.type, bool(descending)) for c, descending in terms]
    return hashlib.sha256(repr((fingerprint, tests, order)).encode() + b"\n" + body).digest()[:SEAL]


def encode_cursor(fingerprint: str, filters: Sequence[Filter], terms, row: Row) -> str:
    """An opaque token: the row's sort tuple, sealed with the schema, the filters and the sort order."""
    body = json.dumps([_cursor_text(row[c.alias]) for c, _ in terms], ensure_ascii=False).encode()
    token = base64.urlsafe_b64encode(_seal(body, fingerprint, filters, terms) + body).decode()
    if len(token) > MAX_CURSOR:
        raise TabularError("query.cursor", "the cursor is too long")
    return token


def decode_cursor(token: str, fingerprint: str, filters: Sequence[Filter], terms) -> list:
    """The sort tuple of a token that was sealed for just this query; any other is rejected."""
    try:
        raw = base64.b64decode(token[: MAX_CURSOR + 1], altchars=b"-_", validate=True)
    except ValueError:
        raw = b""
    seal, body = raw[:SEAL], raw[SEAL:]
    if len(token) > MAX_CURSOR or not body or seal != _seal(body, fingerprint, filters, terms):
        raise TabularError("query.cursor", "the cursor does not belong to this query")
    values = json.loads(body)
    for value, (c, _) in zip(values, terms, strict=True):
        try:
            fits = c.nullable if value is None else constant(value, c) is not None
        except ValueError:
            fits = False
        if not fits:
            raise TabularError("query.cursor", f"the cursor holds no value of '{c.alias}'")
    return values
