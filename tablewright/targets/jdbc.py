"""Relational targets: stage in parallel, then one set-based statement in one transaction.

Task retries can leave a task's rows twice in a staging table, so every staged row carries
its partition and position, and the final statement reads distinct staged rows. Data moves
from executors to the database only; the driver just sends the statement.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.sources.jdbc import database_kind, qualified_name, quote_identifier
from tablewright.targets.mutations import check_mutation_keys

ROW_ID = "stage_row"


def mutation_statements(
    kind: str, target: str, stage: str, columns: Sequence[str], keys: Sequence[str], mode: str
) -> list[str]:
    """The statements that apply a staged input to the target."""

    def q(name: str) -> str:
        return quote_identifier(kind, name)

    names = ", ".join(q(c) for c in columns)
    fresh = f"SELECT DISTINCT {q(ROW_ID)}, {names} FROM {stage}"
    same = " AND ".join(f"s.{q(k)} = {target}.{q(k)}" for k in keys)
    if mode == "insert":
        return [f"INSERT INTO {target} ({names}) SELECT {names} FROM ({fresh}) d"]
    if mode == "delete":
        return [f"DELETE FROM {target} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})"]
    if mode != "upsert":
        raise TabularError("target.mode", f"unknown mode '{mode}'")
    lowered = {k.lower() for k in keys}
    values = [c for c in columns if c.lower() not in lowered]
    if not values:
        raise TabularError("target.values", "upsert needs at least one non-key column")
    one = f"SELECT DISTINCT s.%s FROM {stage} s WHERE {same}"
    settings = ", ".join(f"{q(v)} = ({one % q(v)})" for v in values)
    source = f"({fresh}) s"
    return [
        f"UPDATE {target} SET {settings} WHERE EXISTS (SELECT 1 FROM {stage} s WHERE {same})",
        f"INSERT INTO {target} ({names}) SELECT {', '.join('s.' + q(c) for c in columns)} FROM {source} "
        f"WHERE NOT EXISTS (SELECT 1 FROM {target} WHERE {same})",
    ]


def write_table(
    source: DataFrame,
    url: str,
    table: str,
    schema: str | None = None,
    mode: str = "insert",
    keys: Sequence[str] = (),
    batch_size: int = 1000,
    properties: Mapping[str, str] | None = None,
) -> int:
    """Insert, upsert or delete by key, all or nothing; returns the affected row count."""
    spark, kind = source.sparkSession, database_kind(url)
    if mode in ("upsert", "delete"):
        check_mutation_keys(source, keys)
    columns = source.columns if mode != "delete" else [c for c in source.columns if c.lower() in {k.lower() for k in keys}]
    stage_table = f"stage_{uuid.uuid4().hex[:16]}"
    stage = qualified_name(kind, stage_table, schema)
    target = qualified_name(kind, table, schema)
    staged = source.select(*columns).withColumn(ROW_ID, F.monotonically_increasing_id())
    try:
        (
            staged.write.format("jdbc")
            .option("url", url)
            .option("dbtable", stage)
            .option("batchsize", batch_size)
            .options(**(properties or {}))
            .mode("errorifexists")
            .save()
        )
        return run_statements(
            spark, url, mutation_statements(kind, target, stage, columns, keys, mode), properties
        )
    finally:
        run_statements(spark, url, [f"DROP TABLE {stage}"], properties, missing_ok=True)


def run_statements(
    spark: SparkSession,
    url: str,
    statements: Sequence[str],
    properties: Mapping[str, str] | None = None,
    missing_ok: bool = False,
) -> int:
    """Run statements in one transaction through the JVM's driver manager."""
    jvm = spark.sparkContext._jvm
    settings = jvm.java.util.Properties()
    for name, value in (properties or {}).items():
        settings.setProperty(name, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        affected = sum(statement.executeUpdate(text) for text in statements)
        connection.commit()
        return affected
    except Exception:
        connection.rollback()
        if missing_ok:
            return 0
        raise
    finally:
        connection.close()
