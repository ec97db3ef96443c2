"""Insert, upsert and delete as new table states, plus bindings and publication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.variables import as_column
from tablewright.operators.project import with_variables
from tablewright.schema import actual_name, check_names, column, quoted
from tablewright.session import dropped, written


@dataclass(frozen=True)
class TargetColumn:
    """What a writer needs to know about one column of the target."""

    name: str
    type: T.DataType
    nullable: bool = True
    has_default: bool = False
    generated: bool = False
    key: bool = False


def target_columns(df: DataFrame, keys: Sequence[str] = (), generated: Sequence[str] = ()) -> list[TargetColumn]:
    lowered, made = {k.lower() for k in keys}, {g.lower() for g in generated}
    return [
        TargetColumn(
            f.name, f.dataType, f.nullable and f.name.lower() not in lowered, False,
            f.name.lower() in made, f.name.lower() in lowered,
        )
        for f in df.schema.fields
    ]


def bind_columns(
    source: DataFrame,
    target: Sequence[TargetColumn],
    bindings: Mapping[str, Mapping] | None = None,
    variables: Mapping[str, object] | None = None,
    mode: str = "insert",
    keys: Sequence[str] = (),
) -> DataFrame:
    """Source rows shaped for the target, in target order.

    A binding is ``{"column": …}``, ``{"variable": …}`` or ``{"expression": …}``. Without
    bindings, columns map by name ignoring case. Mode is ``insert``, ``upsert`` or ``delete``.
    """
    columns = {c.name.lower(): c for c in target}
    writable = {n for n, c in columns.items() if not c.generated or (mode == "delete" and c.key)}
    if bindings:
        asked = [(name.lower(), binding) for name, binding in bindings.items()]
    else:
        asked = [(name.lower(), {"column": name}) for name in source.columns if name.lower() in writable]
    names = {n for n, _ in asked}
    primary, wanted = {n for n, c in columns.items() if c.key}, {k.lower() for k in keys}
    needed = {n for n, c in columns.items() if not (c.generated or c.nullable or c.has_default)}
    keyed = mode in ("upsert", "delete")
    # What must hold, as (holds, code, what is wrong); the first that doesn't is reported.
    rules = [
        (not bindings or len(bindings) <= 512, "target.bindings", "at most 512 bindings"),
        (names <= columns.keys(), "target.column", f"no such target column: {sorted(names - columns.keys())}"),
        (names & columns.keys() <= writable, "target.generated", f"generated target column bound: {sorted(names - writable)}"),
        (len(names) == len(asked), "target.duplicate", "a target column is bound twice"),
        (bool(names), "target.mappings", "no writable target column matches the input"),
        (not keyed or (primary and primary == wanted), "target.keys", "the keys must be exactly the primary key"),
        (not keyed or wanted <= names, "target.keys.missing", "every key column must be mapped"),
        (mode != "upsert" or bool(names - wanted), "target.values", "upsert needs at least one mapped non-key column"),
        (mode == "delete" or needed <= names, "target.required", f"required target column not mapped: {sorted(needed - names)}"),
    ]
    for holds, code, wrong in rules:
        if not holds:
            raise TabularError(code, wrong)
    frozen = {n.lower(): v for n, v in (variables or {}).items()}
    values = {n: _bound(source, binding, frozen) for n, binding in asked}
    return with_variables(source, variables).select(*[values[n].cast(c.type).alias(c.name) for n, c in columns.items() if n in values])


def _bound(source: DataFrame, binding: Mapping, variables: Mapping[str, object]) -> Column:
    if len(binding) != 1:
        raise TabularError("target.binding", f"invalid binding {dict(binding)}")
    (kind, value), = binding.items()
    if kind == "column":
        return F.col(f"row.{quoted(actual_name(source, value))}")
    if kind == "variable":
        if value.lower() not in variables:
            raise TabularError("target.variable", f"variable '{value}' is not set")
        return as_column(variables[value.lower()])
    if kind == "expression":
        return F.expr(value)
    raise TabularError("target.binding", f"unknown binding kind '{kind}'")


def check_mutation_keys(source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reject null and repeated keys. Reads the key columns only; stops at the first problem."""
    check_names(list(keys))
    cells = [column(source, k) for k in keys]
    counted = source.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    has_null = F.greatest(*[column(counted, k).isNull() for k in keys], F.lit(False))
    found = counted.where(has_null | (F.col("__n") > 1)).select(has_null.alias("null")).take(1)
    if found:
        what = "null" if found[0]["null"] else "repeated"
        raise TabularError(f"target.key.{what}", f"the input holds a {what} key")
    return source


def _same_key(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    condition = F.lit(True)
    for key in keys:
        condition = condition & (column(left, key) == column(right, key))
    return condition


def aligned(target: DataFrame, source: DataFrame) -> DataFrame:
    """Source rows with all target columns, null where the source has none."""
    present = {c.lower() for c in source.columns}
    return source.select(
        *[
            (column(source, f.name) if f.name.lower() in present else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )


def insert_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target rows plus mapped source rows; unmapped target columns are null."""
    return target.union(aligned(target, source))


def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str], check_keys: bool = True) -> DataFrame:
    """The target after updating matching rows and adding the others.

    Target columns the source does not carry keep their value. A source small enough to
    broadcast never makes the target shuffle: the update is a left join, and new rows are
    the source minus the target keys it hits.
    """
    if check_keys:
        check_mutation_keys(source, keys)
    key_names = {k.lower() for k in keys}
    values = [c for c in source.columns if c.lower() not in key_names]
    if not values:
        raise TabularError("target.values", "upsert needs at least one non-key column")
    for name in source.columns:
        actual_name(target, name)
    staged = source.select(
        *[column(source, k).alias(f"__k{i}") for i, k in enumerate(keys)],
        F.struct(*[column(source, v) for v in values]).alias("__new"),
    )
    on_key = F.lit(True)
    for i, key in enumerate(keys):
        on_key = on_key & (column(target, key) == staged[f"__k{i}"])
    joined = target.join(staged, on_key, "left")
    carried = {v.lower(): v for v in values}
    updated = joined.select(
        *[
            (
                F.when(F.col("__new").isNotNull(), F.col(f"__new.{quoted(carried[f.name.lower()])}").cast(f.dataType)).otherwise(column(target, f.name))
                if f.name.lower() in carried
                else column(target, f.name)
            ).alias(f.name)
            for f in target.schema.fields
        ]
    )
    hit = target.select(*[column(target, k).alias(f"__h{i}") for i, k in enumerate(keys)])
    wanted = source.select(*[column(source, k).alias(f"__w{i}") for i, k in enumerate(keys)])
    both = F.lit(True)
    for i in range(len(keys)):
        both = both & (hit[f"__h{i}"] == wanted[f"__w{i}"])
    matched = hit.join(wanted, both, "left_semi")
    absent = F.lit(True)
    for i, key in enumerate(keys):
        absent = absent & (column(source, key) == matched[f"__h{i}"])
    return insert_rows(updated, source.join(matched, absent, "left_anti"))


def delete_keys(target: DataFrame, source: DataFrame, keys: Sequence[str], check_keys: bool = True) -> DataFrame:
    """The target without the rows whose key is in the source; absent keys are fine."""
    if check_keys:
        check_mutation_keys(source, keys)
    doomed = source.select(*[column(source, k).alias(f"__k{i}") for i, k in enumerate(keys)])
    on_key = F.lit(True)
    for i, key in enumerate(keys):
        on_key = on_key & (column(target, key) == doomed[f"__k{i}"])
    return target.join(doomed, on_key, "left_anti")


def publish_table(spark: SparkSession, table: str, state: DataFrame, root: str) -> str:
    """Write a new state next to the old one, then point the table at it.

    The directory readers are using is never touched, so a failed write changes nothing.
    """
    import uuid

    location = f"{root.rstrip('/')}/{uuid.uuid4().hex}"
    state.write.mode("errorifexists").parquet(location)
    if spark.catalog.tableExists(table):
        spark.sql(f"ALTER TABLE {table} SET LOCATION '{location}'")
        spark.catalog.refreshTable(table)
    else:
        spark.catalog.createTable(table, path=location, source="parquet")
    return location


def mutate_table(
    source: DataFrame,
    table: str,
    root: str,
    mode: str = "insert",
    keys: Sequence[str] = (),
    bindings: Mapping[str, Mapping] | None = None,
    variables: Mapping[str, object] | None = None,
) -> None:
    """Insert into, upsert into or delete from a published table, all or nothing.

    An insert appends files in one committed job; the other modes publish a new state, the whole table anew. Tables
    whose changes should cost what they touch are kept as ``published`` files.
    """
    spark = source.sparkSession
    target = spark.table(table)
    if mode not in ("insert", "upsert", "delete"):
        raise TabularError("target.mode", f"unknown mode '{mode}'")
    bound = bind_columns(source, target_columns(target, keys), bindings, variables, mode, keys)
    if mode == "insert":
        aligned(target, bound).write.insertInto(table)
        return
    # Checked and applied from one copy: a source need not give the same rows twice.
    staged = written(bound, "staged")
    try:
        change = upsert if mode == "upsert" else delete_keys
        publish_table(spark, table, change(target, staged, keys), root)
    finally:
        dropped(staged)
