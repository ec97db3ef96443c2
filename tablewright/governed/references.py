"""Foreign keys: search, labels, tuple extraction and existence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.governed.contract import ContractColumn, TableContract
from tablewright.governed.query import after_predicate, order_columns
from tablewright.schema import column, field, logical_type
from tablewright.session import written


def fk_lookup(
    referenced: DataFrame,
    keys: Sequence[ContractColumn],
    display: str,
    search_columns: Sequence[str],
    text: str | None = None,
    after: Sequence | None = None,
    take: int = 100,
) -> DataFrame:
    """Referenced rows whose search columns contain the text, by display text then key.

    Returns ``display`` and the keys under their local aliases, one row more than ``take``.
    """
    if not 1 <= take <= 100:
        raise TabularError("lookup.take", "a lookup returns 1 to 100 rows")
    rows = referenced
    if text is not None:
        rows = rows.where(
            reduce(Column.__or__, [column(rows, s).cast("string").contains(text) for s in search_columns])
        )
    label = ContractColumn(display, "display", "string")
    shown = rows.select(
        column(rows, display).cast("string").alias("display"),
        *[column(rows, k.foreign_key.referenced_column).alias(k.alias) for k in keys],
    )
    terms = [(label, False)] + [(k, False) for k in keys]
    if after is not None:
        shown = shown.where(after_predicate(shown, terms, after))
    return shown.orderBy(*order_columns(shown, terms)).limit(take + 1)


def resolve_labels(
    requests: DataFrame, request_keys: Sequence[str], referenced: DataFrame, referenced_keys: Sequence[str], display: str
) -> DataFrame:
    """Key tuples with the display text of the row they refer to; tuples without a row are left out.

    The referenced key is unique, so requests only ever gain a column. Spark broadcasts the
    referenced side when its size allows, and splits hot request keys when it does not.
    """
    labels = referenced.select(
        *[column(referenced, k).alias(f"__r{i}") for i, k in enumerate(referenced_keys)],
        column(referenced, display).cast("string").alias("label"),
    )
    on = reduce(Column.__and__, [column(requests, k) == F.col(f"__r{i}") for i, k in enumerate(request_keys)])
    return requests.join(labels, on, "inner").select(*[column(requests, c) for c in requests.columns], "label")


def fk_tuples(changes: DataFrame, contract: TableContract, foreign_key: str) -> DataFrame:
    """Complete, not-all-null reference tuples that inserts and updates supply."""
    parts = contract.foreign_keys()[foreign_key.lower()]
    return changes.where(_supplies(parts)).select(*[F.col(f"after.`{p.alias}`").alias(p.alias) for p in parts])


def _supplies(parts: Sequence[ContractColumn]) -> Column:
    """Whether a change sets the whole tuple, and not to nothing."""
    supplied = reduce(Column.__and__, [F.array_contains("changed", p.alias) for p in parts])
    any_value = reduce(Column.__or__, [F.col(f"after.`{p.alias}`").isNotNull() for p in parts])
    return F.col("op").isin("insert", "update") & supplied & any_value


def missing_fk(changes: DataFrame, contract: TableContract, foreign_key: str, referenced: DataFrame) -> DataFrame:
    """Distinct tuples that refer to no row; a non-empty result rejects the change set."""
    parts = contract.foreign_keys()[foreign_key.lower()]
    return _without_row(fk_tuples(changes, contract, foreign_key).distinct(), [p.alias for p in parts], parts, referenced)


def _without_row(tuples: DataFrame, names: Sequence[str], parts: Sequence[ContractColumn], referenced: DataFrame) -> DataFrame:
    """Tuples without a row; one with a null part refers to none and stays."""
    present = referenced.select(
        *[column(referenced, p.foreign_key.referenced_column).alias(f"__r{i}") for i, p in enumerate(parts)]
    )
    check_reference_types(tuples, names, parts, referenced)
    on = reduce(Column.__and__, [column(tuples, n) == F.col(f"__r{i}") for i, n in enumerate(names)])
    return tuples.join(present, on, "left_anti")


def missing_references(changes: DataFrame, contract: TableContract, references: Mapping[str, DataFrame]) -> DataFrame:
    """``foreign_key`` and ``tuple`` (values as text by alias) of all tuples in the set that refer to no row.

    One pass over the changes takes out the tuples of every reference, distinct and written once; each reference
    then has one anti join. ``references`` are the tables by the names the foreign keys use. A tuple that many
    changes share is joined once. The contract's whole references must be given.
    """
    groups = contract.foreign_keys()
    tables = {name.lower(): df for name, df in references.items()}
    lacking = {parts[0].foreign_key.referenced for parts in groups.values() if parts[0].foreign_key.referenced.lower() not in tables}
    if lacking:
        raise TabularError("changes.references", f"no table is given for {sorted(lacking)}")
    empty = "foreign_key string, tuple map<string,string>"
    if not groups:
        return changes.sparkSession.createDataFrame([], empty)
    # One struct per reference; those that a change does not set are null and fall away.
    tuples = [
        F.when(_supplies(parts), F.struct(F.lit(name).alias("foreign_key"), *[
            (F.col(f"after.`{p.alias}`") if name == own else F.lit(None).cast(p.spark_type)).alias(f"{own}.{p.alias}") for own, ps in groups.items() for p in ps
        ]))
        for name, parts in groups.items()
    ]
    taken = changes.select(F.explode(F.array(*tuples)).alias("t")).where("t IS NOT NULL").select("t.*").distinct()
    taken = written(taken, "tuples")
    found = []
    for name, parts in groups.items():
        names = [f"{name}.{p.alias}" for p in parts]
        left = _without_row(taken.where(F.col("foreign_key") == name), names, parts, tables[parts[0].foreign_key.referenced.lower()])
        texts = [cell for n, p in zip(names, parts) for cell in (F.lit(p.alias), column(taken, n).cast("string"))]
        found.append(left.select("foreign_key", F.create_map(*texts).alias("tuple")))
    return reduce(DataFrame.unionAll, found)


def check_reference_types(df: DataFrame, names: Sequence[str], parts: Sequence[ContractColumn], referenced: DataFrame) -> None:
    """Local and referenced key columns must be of one type family, so that no value is compared after a cast that changes it."""
    for name, p in zip(names, parts):
        local, other = field(df, name).dataType, field(referenced, p.foreign_key.referenced_column).dataType
        if logical_type(local) != logical_type(other):
            raise TabularError("lookup.type", f"'{p.alias}' is {local.simpleString()}, its reference {other.simpleString()}")
