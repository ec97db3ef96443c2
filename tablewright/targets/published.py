"""Published tables as folders of Parquet files with commits: a change rewrites only the files that hold its rows.

A mutation finds the files with rows it hits, by ``_metadata.file_path``, writes their successors beside them, and
commits a new list of files. Readers of the old state keep theirs until ``sweep`` removes what no state needs.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.schema import column
from tablewright.session import dropped, written
from tablewright.targets.commits import Commit, commit, file_names, hadoop_path, latest
from tablewright.targets.mutations import aligned, bind_columns, check_mutation_keys, delete_keys, target_columns, upsert

DATA_FILE = re.compile(r"data/[0-9a-f]{32}/[^/]+$")


def _written_files(state: DataFrame, root: str) -> list[str]:
    folder = f"data/{uuid.uuid4().hex}"
    state.write.mode("errorifexists").parquet(f"{root.rstrip('/')}/{folder}")
    return [f"{folder}/{name}" for name in file_names(state.sparkSession, f"{root.rstrip('/')}/{folder}")]


def _rows(spark: SparkSession, root: str, files: Sequence[str], schema: T.StructType) -> DataFrame:
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root.rstrip('/')}/{f}" for f in files])


def publish_state(state: DataFrame, root: str) -> Commit:
    """Make these rows the next state of the table at ``root``; a failed write changes nothing."""
    spark = state.sparkSession
    base = latest(spark, root)
    return commit(spark, root, base, _written_files(state, root), {"schema": state.schema.json()})


def read_published(spark: SparkSession, root: str) -> DataFrame:
    """The newest state; later states don't change the rows of this DataFrame until ``sweep`` removes its files."""
    state = latest(spark, root)
    if not state.number:
        raise TabularError("target.state", f"nothing is published at {root}")
    return _rows(spark, root, state.files, _schema(state))


def _schema(state: Commit) -> T.StructType:
    return T.StructType.fromJson(json.loads(state.notes["schema"]))


def mutate_published(
    source: DataFrame, root: str, mode: str = "insert", keys: Sequence[str] = (), bindings: Mapping[str, Mapping] | None = None, variables: Mapping[str, object] | None = None
) -> Commit:
    """Insert into, upsert into or delete from the table at ``root``, all or nothing.

    The source is computed once, and checked and applied from that copy. An insert adds files; an upsert or delete
    rewrites the files that hold a key of the source, and leaves the others where they are. Runs jobs; the list of
    touched files, at most that of the table's files, reaches the driver.
    """
    if mode not in ("insert", "upsert", "delete"):
        raise TabularError("target.mode", f"unknown mode '{mode}'")
    spark = source.sparkSession
    base = latest(spark, root)
    if not base.number:
        raise TabularError("target.state", f"nothing is published at {root}")
    schema = _schema(base)
    target = _rows(spark, root, base.files, schema)
    staged = written(bind_columns(source, target_columns(target, keys), bindings, variables, mode, keys), "staged")
    try:
        if mode == "insert":
            return commit(spark, root, base, [*base.files, *_written_files(aligned(target, staged), root)], base.notes)
        check_mutation_keys(staged, keys)
        touched = _touched(target, staged, keys) if base.files else set()
        rows = _rows(spark, root, sorted(touched), schema)
        changed = upsert(rows, staged, keys, check_keys=False) if mode == "upsert" else delete_keys(rows, staged, keys, check_keys=False)
        if mode == "delete" and not touched:
            return base
        return commit(spark, root, base, [*[f for f in base.files if f not in touched], *_written_files(changed, root)], base.notes)
    finally:
        dropped(staged)


def _touched(target: DataFrame, staged: DataFrame, keys: Sequence[str]) -> set[str]:
    wanted = staged.select(*[column(staged, k).alias(f"__k{i}") for i, k in enumerate(keys)])
    placed = target.select(*[column(target, k).alias(f"__t{i}") for i, k in enumerate(keys)], F.col("_metadata.file_path").alias("file"))
    on_key = F.lit(True)
    for i in range(len(keys)):
        on_key = on_key & (F.col(f"__t{i}") == F.col(f"__k{i}"))
    return {DATA_FILE.search(r["file"])[0] for r in placed.join(wanted, on_key, "left_semi").select("file").distinct().collect()}


def sweep(spark: SparkSession, root: str) -> int:
    """Remove data files that the newest state doesn't list, and older commits; returns how many files went.

    Only when no reader of an older state and no writer is at work.
    """
    state = latest(spark, root)
    data, fs = hadoop_path(spark, f"{root.rstrip('/')}/data")
    kept, gone = set(state.files), 0
    if not fs.exists(data):
        return 0
    for folder in fs.listStatus(data):
        name = f"data/{folder.getPath().getName()}"
        for file in file_names(spark, f"{root.rstrip('/')}/{name}"):
            if f"{name}/{file}" not in kept:
                fs.delete(hadoop_path(spark, f"{root.rstrip('/')}/{name}/{file}")[0], False)
                gone += 1
        if not file_names(spark, f"{root.rstrip('/')}/{name}"):
            fs.delete(folder.getPath(), True)
    for old in range(1, state.number):
        path, _ = hadoop_path(spark, f"{root.rstrip('/')}/_commits/{old:012d}")
        if fs.exists(path):
            fs.delete(path, False)
    return gone
