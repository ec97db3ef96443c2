"""Staged edits: snapshot diff, validation, typed changes and all-or-nothing apply."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import BASE64_TEXT, GUID_TEXT
from tablewright.governed.cells import parse_public
from tablewright.governed.contract import ContractColumn, TableContract, check_schema
from tablewright.governed.ordered import PARTS as STAGED_PARTS
from tablewright.governed.ordered import as_parts, compose
from tablewright.governed.references import missing_references
from tablewright.schema import column
from tablewright.session import written

# Size bounds of staged JSON, in characters.
MAX_KEY_JSON = 16 * 1024
MAX_ROW_JSON = 256 * 1024


def _all(tests: Sequence[Column]) -> Column:
    return reduce(Column.__and__, tests, F.lit(True))


def _any(tests: Sequence[Column]) -> Column:
    return reduce(Column.__or__, tests, F.lit(False))


def diff_snapshots(original: DataFrame, current: DataFrame, contract: TableContract) -> DataFrame:
    """Changes that turn ``original`` into ``current``; both carry public aliases.

    ``op``, ``key``, ``before`` (all readable columns), ``after`` (insertable columns, null
    where unchanged) and ``changed`` (the aliases set). One changed part of a foreign key
    brings the whole tuple along.
    """
    keys = [k.alias for k in contract.keys]
    readable = [c.alias for c in contract.readable]
    old = original.select(
        *[column(original, k).alias(f"__o{i}") for i, k in enumerate(keys)],
        F.struct(*[column(original, a).alias(a) for a in readable]).alias("before"),
    )
    new = current.select(
        *[column(current, k).alias(f"__n{i}") for i, k in enumerate(keys)],
        F.struct(*[column(current, a).alias(a) for a in readable]).alias("now"),
    )
    # Keys are unique on both sides, so no key can be hot here.
    pairs = old.join(new, _all([old[f"__o{i}"] == new[f"__n{i}"] for i in range(len(keys))]), "full")
    differs = {c.alias: ~F.col(f"before.`{c.alias}`").eqNullSafe(F.col(f"now.`{c.alias}`")) for c in contract.updatable}
    for parts in contract.foreign_keys().values():
        mutable = [p.alias for p in parts if p.alias in differs]
        together = _any([differs[a] for a in mutable])
        differs.update({a: together for a in mutable})
    updated = _present([F.when(test, a) for a, test in differs.items()])
    inserted = F.array(*[F.lit(c.alias) for c in contract.insertable]).cast("array<string>")
    op = (
        F.when(F.col("before").isNull(), "insert")
        .when(F.col("now").isNull(), "delete")
        .when(F.size("__updated") > 0, "update")
    )
    marked = pairs.withColumn("__updated", updated).withColumn("op", op).where(F.col("op").isNotNull())
    changed = (
        F.when(F.col("op") == "insert", inserted)
        .when(F.col("op") == "update", F.col("__updated"))
        .otherwise(F.array().cast("array<string>"))
    )
    return marked.withColumn("changed", changed).select(
        "op",
        F.when(F.col("op") != "insert", F.struct(*[F.col(f"__o{i}").alias(k) for i, k in enumerate(keys)])).alias("key"),
        "before",
        F.struct(
            *[F.when(F.array_contains("changed", c.alias), F.col(f"now.`{c.alias}`")).alias(c.alias) for c in contract.insertable]
        ).alias("after"),
        "changed",
    )


PARTS = ("key", "before", "after")


def _bind(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns in a projection of their own, so that later steps reuse their values."""
    return df.select("*", *[value.alias(name) for name, value in columns.items()])


def _present(codes: Sequence[Column]) -> Column:
    """The distinct non-null texts, in order.

    The lambda keeps the projection out of whole-stage code, where so many tests become one method, too long for the
    JVM to compile; alone, a projection's code is split into short ones.
    """
    return F.array_distinct(F.filter(F.array(*codes), lambda c: c.isNotNull()))


def _parsed(changes: DataFrame) -> DataFrame:
    """Add, per JSON part, ``__<part>_names`` (null unless an object) and ``__<part>``.

    The latter maps lower-case names to JSON kind and text; it is null when names repeat. Each part is parsed once.
    """
    named = _bind(changes, {f"__{p}_names": F.json_object_keys(F.col(f"{p}_json")) for p in PARTS})

    def described(part: str) -> Column:
        cells = F.transform_values(
            F.from_json(F.col(f"{part}_json"), "map<string,variant>"),
            # A JSON null may come back as an SQL null or as a null variant.
            lambda _, v: F.struct(F.coalesce(F.schema_of_variant(v), F.lit("VOID")).alias("kind"), F.try_variant_get(v, "$", "string").alias("text")),
        )
        names = F.col(f"__{part}_names")
        return F.when(names.isNotNull() & ~_repeats(_lower(names)), F.transform_keys(cells, lambda k, _: F.lower(k)))

    lowered = {f"__{p}_lower": F.coalesce(_lower(F.col(f"__{p}_names")), F.array().cast("array<string>")) for p in PARTS}
    return _bind(named, {f"__{p}": described(p) for p in PARTS} | lowered)


def _lower(names: Column) -> Column:
    return F.transform(names, lambda n: F.lower(n))


def _repeats(lower: Column) -> Column:
    return F.size(F.array_distinct(lower)) != F.size(lower)


def _value(part: str, c: ContractColumn) -> Column:
    return F.col(f"__{part}")[F.lit(c.alias.lower())]


def _compatible(value: Column, c: ContractColumn) -> Column:
    """Whether a JSON value fits the column."""
    kind, text = value["kind"], value["text"]
    is_text = kind == "STRING"
    number = kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    if c.type == "boolean":
        fits = kind == "BOOLEAN"
    elif c.type in ("byte", "int16", "int32", "int64"):
        fits = (kind == "BIGINT") & parse_public(text, c).isNotNull()
    elif c.type == "decimal":
        fits = number & text.try_cast("decimal(38,9)").isNotNull()
    elif c.type in ("single", "double"):
        fits = number & (F.abs(text.try_cast("float" if c.type == "single" else "double")) < float("inf"))
    elif c.type == "string":
        fits = is_text if c.max_length is None else is_text & (F.char_length(text) <= c.max_length)
    elif c.type == "guid":
        fits = is_text & text.rlike(GUID_TEXT)
    elif c.type == "binary":
        bare = F.regexp_replace(text, r"\s", "")
        fits = is_text & bare.rlike(BASE64_TEXT)
        if c.max_length is not None:
            fits = fits & (F.octet_length(F.unbase64(F.when(bare.rlike(BASE64_TEXT), bare))) <= c.max_length)
    else:
        fits = is_text & parse_public(text, c).isNotNull()
    return F.when(kind == "VOID", F.lit(c.nullable)).otherwise(F.coalesce(fits, F.lit(False)))


def validate_changes(changes: DataFrame, contract: TableContract) -> DataFrame:
    """Add ``problems``, the codes of everything wrong with a change; empty when it is valid.

    Input columns: ``op`` and the JSON objects ``key_json``, ``before_json``, ``after_json``.
    """
    if contract.concurrency == "read_only":
        raise TabularError("changes.read_only", "the contract does not allow edits")
    judged = _judged(_parsed(changes), contract)
    return judged.select(*[column(changes, c) for c in changes.columns], "problems")


def _judged(prepared: DataFrame, contract: TableContract) -> DataFrame:
    """Parsed changes with their ``problems``."""
    groups = contract.foreign_keys()
    op = F.lower("op")
    is_insert, is_update, is_delete = op == "insert", op == "update", op == "delete"
    parts = {"key": (~is_insert, MAX_KEY_JSON), "before": (~is_insert, MAX_ROW_JSON), "after": (~is_delete, MAX_ROW_JSON)}
    for part in PARTS:
        values = {f"__v{i}": _value(part, c) for i, c in enumerate(contract.readable)}
        looked_up = _bind(prepared, values)
        # As in _present, the lambda lets the tests' code be split.
        wrong = F.exists(F.array(*[F.col(v).isNotNull() & ~_compatible(F.col(v), c) for v, c in zip(values, contract.readable)]), lambda x: x)
        prepared = _bind(looked_up, {f"__{part}_wrong": wrong}).drop(*values)

    def names(part: str) -> Column:
        return F.col(f"__{part}_lower")

    def includes(part: str, wanted: Sequence[str]) -> Column:
        return _all([F.array_contains(names(part), w.lower()) for w in wanted])

    def within(part: str, allowed: Sequence[str]) -> Column:
        return F.size(F.array_except(names(part), _string_array([a.lower() for a in allowed]))) == 0

    def supplies(c: ContractColumn) -> Column:
        return F.array_contains(names("after"), c.alias.lower())

    problems: list[Column] = [F.when(~op.isin("insert", "update", "delete") | op.isNull(), "change_operation_invalid")]
    for part, (needed, limit) in parts.items():
        text = F.col(f"{part}_json")
        problems += [
            F.when(needed & text.isNull(), f"change_{part}_required"),
            F.when(F.char_length(text) > limit, f"change_{part}_too_large"),
            F.when(text.isNotNull() & F.col(f"__{part}_names").isNull(), f"change_{part}_invalid"),
            F.when(F.col(f"__{part}_names").isNotNull() & _repeats(names(part)), f"change_{part}_duplicate"),
        ]
    keys = [k.alias for k in contract.keys]
    readable = [c.alias for c in contract.readable]
    key_exact = includes("key", keys) & (F.size(names("key")) == len(keys))
    problems.append(F.when(~is_insert & ~key_exact, "change_key_invalid"))
    for part in parts:
        used = F.lit(True) if part == "key" else (~is_insert if part == "before" else ~is_delete)
        problems.append(F.when(used & ~within(part, readable), "change_alias_invalid"))
        problems.append(F.when(used & F.col(f"__{part}_wrong"), "change_value_invalid"))
    problems.append(F.when(~is_insert & ~includes("before", keys), "change_before_invalid"))
    if contract.concurrency == "row_version":
        originals = [c.alias for c in contract.columns if c.token]
        problems.append(F.when(~is_insert & ~includes("before", originals), "change_concurrency_values_missing"))
    else:
        originals = [c.alias for c in contract.updatable]
        problems.append(F.when(is_delete & ~includes("before", originals), "change_concurrency_values_missing"))
        problems.append(
            F.when(is_update & (F.size(F.array_except(names("after"), names("before"))) > 0), "change_original_values_missing")
        )
    insertable, updatable = [c.alias for c in contract.insertable], [c.alias for c in contract.updatable]
    allowed = (is_insert & within("after", insertable)) | (is_update & within("after", updatable))
    problems.append(F.when(~is_delete & ((F.size(names("after")) == 0) | ~allowed), "change_after_invalid"))
    for components in groups.values():
        supplied = reduce(Column.__add__, [supplies(c).cast("int") for c in components])
        nulls = reduce(
            Column.__add__,
            [
                F.when(supplies(c) & (_value("after", c)["kind"] == "VOID"), 1).otherwise(0)
                for c in components
            ],
        )
        size = len(components)
        problems.append(F.when(~is_delete & (supplied > 0) & (supplied < size), "foreign_key_partial_update"))
        problems.append(F.when(~is_delete & (supplied == size) & (nulls > 0) & (nulls < size), "foreign_key_partial_null"))
    required = [c.alias for c in contract.insertable if not c.nullable]
    problems.append(F.when(is_insert & ~includes("after", required), "change_required_values_missing"))
    return _bind(prepared, {"problems": _present(problems)})


def split_changes(changes: DataFrame, contract: TableContract) -> tuple[DataFrame, DataFrame]:
    """Valid changes in typed form, and the others with their problems.

    Changes are parsed, judged and typed in one pass, and written once: a filter on ``problems`` would otherwise
    move below the projections that compute it and repeat them.
    """
    if contract.concurrency == "read_only":
        raise TabularError("changes.read_only", "the contract does not allow edits")
    judged = _judged(_parsed(changes), contract)
    typed = _typed(judged, contract)
    # Only valid cells can be cast without failing the job.
    judged = judged.select(*[column(judged, c) for c in changes.columns], "problems", F.when(F.size("problems") == 0, F.struct(*typed)).alias("__typed"))
    judged = written(judged, "judged")
    return judged.where("__typed IS NOT NULL").select("__typed.*"), judged.where("__typed IS NULL").drop("__typed")


@dataclass(frozen=True)
class StagedSet:
    """A set that is ``Pending`` with its typed changes, or ``Rejected`` with what is wrong and nothing to apply."""

    status: str
    problems: DataFrame
    missing: DataFrame | None
    changes: DataFrame | None


def stage_changes(changes: DataFrame, contract: TableContract, references: Mapping[str, DataFrame], target: DataFrame | None = None) -> StagedSet:
    """Accept a set of JSON changes whole, or refuse it whole; with ``target``, only while its schema is the contract's.

    Every change must be valid, and every complete reference tuple in the set must have its row in ``references``,
    the tables by the names that the contract's foreign keys use. Runs jobs: the set is judged and written once.
    """
    if target is not None:
        check_schema(target, contract)
    valid, problems = split_changes(changes, contract)
    if problems.take(1):
        return StagedSet("Rejected", problems, None, None)
    missing = missing_references(valid, contract, references)
    if missing.take(1):
        return StagedSet("Rejected", problems, missing, None)
    return StagedSet("Pending", problems, missing, valid)


def _string_array(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def typed_changes(changes: DataFrame, contract: TableContract) -> DataFrame:
    """Validated JSON changes in the shape ``diff_snapshots`` gives, plus ``before_names``, and ``ordinal`` where they have one."""
    parsed = _parsed(changes)
    return parsed.select(*_typed(parsed, contract))


def _typed(parsed: DataFrame, contract: TableContract) -> list[Column]:
    def typed(part: str, columns: Sequence[ContractColumn]) -> Column:
        cells = []
        for c in columns:
            text = _value(part, c)["text"]
            value = text if c.type in ("decimal", "single", "double") else parse_public(text, c)
            cells.append(value.cast(c.spark_type).alias(c.alias))
        return F.struct(*cells)

    def present(part: str, columns: Sequence[ContractColumn]) -> Column:
        return _present([F.when(_value(part, c).isNotNull(), c.alias) for c in columns])

    op = F.lower("op")
    return [
        op.alias("op"), *(["ordinal"] if "ordinal" in parsed.columns else []),
        F.when(op != "insert", typed("key", contract.keys)).alias("key"),
        F.when(op != "insert", typed("before", contract.readable)).alias("before"),
        typed("after", contract.insertable).alias("after"),
        present("after", contract.insertable).alias("changed"),
        present("before", contract.readable).alias("before_names"),
    ]


@dataclass(frozen=True)
class ApplyOutcome:
    """``Applied`` with the new state, or ``Conflict`` with the state unchanged."""

    status: str
    conflicts: DataFrame
    state: DataFrame


def find_conflicts(target: DataFrame, changes: DataFrame, contract: TableContract, ordered: bool = False) -> DataFrame:
    """Keys of changes that would not hit exactly one row as expected, with a reason.

    ``ordered`` changes have an ``ordinal``; those to one key run in its order and are judged together. Without it
    two changes to one key conflict.
    """
    return _conflicts(target, _staged(changes, contract, ordered), contract)


def _staged(changes: DataFrame, contract: TableContract, ordered: bool) -> DataFrame:
    """One row of parts per key, ``__k0…``; and one per insert whose key the target makes, which meets no other change."""
    names = [f"__k{i}" for i in range(len(contract.keys))]
    keyed = _keyed(changes, contract)
    brings_key = (F.col("op") != "insert") | _all([F.col(n).isNotNull() for n in names])
    keyless = as_parts(keyed.where(~brings_key)).drop("ordinal")
    if ordered:
        return compose(keyed.where(brings_key), names, contract).unionByName(keyless)
    parts = as_parts(keyed.where(brings_key)).drop("ordinal")
    per_key = parts.groupBy(*names).agg(F.count(F.lit(1)).alias("__n"), F.any_value(F.struct(*STAGED_PARTS)).alias("part"))
    problem = F.when(F.col("__n") > 1, "key_repeated")
    return per_key.select(*names, *[f"part.{p}" for p in STAGED_PARTS if p != "problem"], problem.alias("problem")).unionByName(keyless)


def _conflicts(target: DataFrame, staged: DataFrame, contract: TableContract) -> DataFrame:
    """The target joins the (usually small) change set, never the other way round: what is left
    of it are the hits, so a broadcast change set costs no shuffle of the target.
    """
    keys = contract.keys
    key_names = [f"__k{i}" for i in range(len(keys))]
    # Rows without a key of their own cannot meet a row of the target.
    staged = staged.where(F.col("starts") | _all([F.col(n).isNotNull() for n in key_names]))
    on_key = _all([column(target, k.source) == F.col(f"__k{i}") for i, k in enumerate(keys)])
    judged_columns = staged.select(*key_names, "before", "before_names")
    hits = target.join(judged_columns, on_key, "inner").select(*key_names, _expected(target, contract).alias("__as_expected"))
    found = hits.groupBy(*[F.col(n).alias(f"__h{i}") for i, n in enumerate(key_names)]).agg(
        F.count(F.lit(1)).alias("__hits"), F.bool_and("__as_expected").alias("__ok")
    )
    judged = staged.join(found, _all([F.col(n).eqNullSafe(F.col(f"__h{i}")) for i, n in enumerate(key_names)]), "left")
    hit_count = F.coalesce("__hits", F.lit(0))
    reason = (
        F.when(F.col("problem").isNotNull(), F.col("problem"))
        .when(~F.col("starts") & (hit_count > 0), "key_exists")
        .when(F.col("starts") & (hit_count == 0), "row_missing")
        .when(F.col("starts") & (hit_count > 1), "row_ambiguous")
        .when(F.col("starts") & ~F.col("__ok"), "row_changed")
    )
    named = [F.col(n).alias(k.alias) for n, k in zip(key_names, keys)]
    return judged.select(*named, reason.alias("reason")).where(F.col("reason").isNotNull())


def _keyed(changes: DataFrame, contract: TableContract) -> DataFrame:
    """Changes with their key in ``__k0…``; an insert takes it from its values."""
    if "before_names" not in changes.columns:
        every = _string_array([c.alias for c in contract.readable])
        changes = changes.withColumn("before_names", F.when(F.col("before").isNotNull(), every))
    keys = []
    for i, k in enumerate(contract.keys):
        given = F.col(f"key.`{k.alias}`")
        keys.append((F.coalesce(given, F.col(f"after.`{k.alias}`")) if k.insertable else given).alias(f"__k{i}"))
    ordinal = ["ordinal"] if "ordinal" in changes.columns else []
    return changes.select("op", "before", "before_names", "after", "changed", *ordinal, *keys)


def _expected(target: DataFrame, contract: TableContract) -> Column:
    """Whether the stored row still is the one the change was made against."""
    if contract.concurrency == "row_version":
        token = next(c for c in contract.columns if c.token)
        return column(target, token.source).eqNullSafe(F.col(f"before.`{token.alias}`"))
    return _all(
        [
            ~F.coalesce(F.array_contains("before_names", c.alias), F.lit(False))
            | column(target, c.source).eqNullSafe(F.col(f"before.`{c.alias}`"))
            for c in contract.readable
        ]
    )


def apply_changes(
    target: DataFrame, changes: DataFrame, contract: TableContract, ordered: bool = False, references: Mapping[str, DataFrame] | None = None
) -> ApplyOutcome:
    """The table after all changes, or unchanged when any of them conflicts.

    ``ordered`` changes carry an ``ordinal``: changes to one key run in its order, each against what the ones before
    it leave, and reach the table as one. Otherwise changes are one set, where two to one key conflict.
    ``references`` are tables by the names that the contract's foreign keys use; a set with a tuple that one of them
    lacks conflicts as a whole. Runs jobs: the changes are written and judged before the new state is returned, unread.
    """
    if contract.concurrency == "read_only":
        raise TabularError("changes.read_only", "the contract does not allow edits")
    check_schema(target, contract)
    if ordered and "ordinal" not in changes.columns:
        raise TabularError("changes.order", "ordered changes need an 'ordinal' column")
    changes = written(changes, "changes")
    if references is not None:
        missing = missing_references(changes, contract, references)
        if missing.take(1):
            return ApplyOutcome("Conflict", missing.withColumn("reason", F.lit("reference_missing")), target)
    # Judged and applied from one written copy, whose known size lets Spark broadcast it.
    staged = written(_staged(changes, contract, ordered), "staged")
    conflicts = _conflicts(target, staged, contract)
    if conflicts.take(1):
        return ApplyOutcome("Conflict", conflicts, target)
    return ApplyOutcome("Applied", conflicts, _changed(target, staged, contract))


def changed_state(target: DataFrame, changes: DataFrame, contract: TableContract, ordered: bool = False) -> DataFrame:
    """The target with a conflict-free change set applied."""
    return _changed(target, _staged(changes, contract, ordered), contract)


def _changed(target: DataFrame, staged: DataFrame, contract: TableContract) -> DataFrame:
    # A row that is made anew, or gone, leaves the table; the rest of what is hit is updated in place.
    edits = staged.where("starts").select(
        (F.col("ends") & ~F.col("made")).alias("__stays"), F.col("after").alias("__after"), F.col("changed").alias("__changed"),
        *[f"__k{i}" for i in range(len(contract.keys))],
    )
    on_key = _all([column(target, k.source) == F.col(f"__k{i}") for i, k in enumerate(contract.keys)])
    joined = target.join(edits, on_key, "left").where(F.coalesce("__stays", F.lit(True)))
    settable = {c.source.lower(): c for c in contract.updatable}
    kept = joined.select(
        *[
            (
                F.when(F.array_contains("__changed", settable[f.name.lower()].alias), F.col(f"__after.`{settable[f.name.lower()].alias}`").cast(f.dataType)).otherwise(column(target, f.name))
                if f.name.lower() in settable
                else column(target, f.name)
            ).alias(f.name)
            for f in target.schema.fields
        ]
    )
    given = {c.source.lower(): c for c in contract.insertable}
    added = staged.where("ends AND made").select(
        *[
            (F.col(f"after.`{given[f.name.lower()].alias}`") if f.name.lower() in given else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in target.schema.fields
        ]
    )
    return kept.union(added)


__all__ = [
    "ApplyOutcome", "StagedSet", "apply_changes", "changed_state", "diff_snapshots", "find_conflicts", "split_changes", "stage_changes", "typed_changes",
    "validate_changes",
]
