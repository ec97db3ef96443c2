"""Every registered query against its SQL, and rules all plans must keep."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as registry
from compare import compare, connect
from pyspark.sql import functions as F

from tablewright.operators.distinct import distinct_rows
from tablewright.operators.filter import filter_rows
from tablewright.operators.sort import top_rows
from tablewright.plans.registry import ORACLES, QUERIES

# Python runs only where no expression exists: workbooks and keyed state.
PYTHON = {"workbook_roundtrip"}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def database(folder):
    return connect(folder)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, folder, database, name):
    df = QUERIES[name](spark, folder)
    assert compare(df, database, ORACLES[name]) is None
    plan = plan_of(df)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    if name not in PYTHON:
        assert "Python" not in plan and "MapInPandas" not in plan


def test_entry(spark):
    assert registry.entry(spark).columns == ["o_orderpriority", "line_count", "sum_quantity", "avg_price", "first_ship", "last_ship"]


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_corpus_operators(tmp_path, pipeline):
    """The rest must import alone, whether or not the pipeline's file is left behind."""
    home, copy = Path(registry.__file__).parent, tmp_path / "repo"
    shutil.copytree(home / "tablewright", copy / "tablewright", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(home / "__spark_entry__.py", copy)
    if pipeline and (home / "corpus_pipeline.py").exists():
        shutil.copy(home / "corpus_pipeline.py", copy)
    code = "import __spark_entry__ as e; print(sorted(e.queries()) == sorted(e.oracle_sql()), len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin"})
    assert out.stdout.split() == ["True", str(len(QUERIES))]


def test_filters_and_columns_reach_the_scan(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    out = filter_rows(lines, [
        {"column": "l_shipdate", "operator": "greaterThanOrEqual", "value": "1996-01-01"},
        {"column": "l_returnflag", "operator": "equals", "value": "R"},
        {"column": "l_linestatus", "operator": "notEquals", "value": "O"},
        {"column": "l_linenumber", "operator": "lessThan", "value": "3"},
    ]).select("l_orderkey")
    plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    for pushed in ("GreaterThanOrEqual(l_shipdate", "EqualNullSafe(l_returnflag,R)", "Not(EqualNullSafe(l_linestatus,O))", "LessThan(l_linenumber,3)"):
        assert pushed in plan
    assert "l_comment" not in plan and "l_extendedprice" not in plan


def test_distinct_limits_groups_before_the_shuffle(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet").select("l_returnflag", "l_orderkey", "l_shipdate")
    plan = plan_of(distinct_rows(lines, ["l_returnflag"], ["l_shipdate"]))
    assert "WindowGroupLimit" in plan.split("Exchange")[1]


def test_top_rows_do_not_sort_everything(spark, folder):
    lines = spark.read.parquet(f"{folder}/lineitem.parquet")
    assert "TakeOrderedAndProject" in plan_of(top_rows(lines, ["l_shipdate"], 10))


def test_outer_join_splits_a_hot_key_on_the_other_side(spark):
    """Full-size skew is out of reach here: the thresholds are lowered instead."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k) for k in settings}
    from tablewright.operators.join import join

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        left = spark.range(0, 100).select(F.col("id").alias("k"), F.lit("l").alias("l"))
        hot = spark.range(0, 60_000, numPartitions=8).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.col("id")).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("r"))
        out = join(left, hot, ["k"], ["k"], "left")
        rows = out.collect()
        want = 20_000 + sum(1 for i in range(100) if i % 3 and i != 5) + 1 + sum(1 for i in range(100) if i % 3 == 0)
        assert len(rows) == want
        assert "skew=true" in plan_of(out)
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
