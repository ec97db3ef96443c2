import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.operators import ranks
from tablewright.oplog.alerts import check_template, match_rules, render_template
from tablewright.oplog.pages import matching, page, total, with_label
from tablewright.oplog.steps import TOTALS, block_width, carried, event_problems, fold_events, status_rollup
from tablewright.streaming import steps as streamed_steps
from tablewright.streaming.alerts import deliver_available, match_rules_stream
from tablewright.streaming.run import read_stream, run_available
from tablewright.streaming.steps import fold_available, fold_stream, latest_steps

START = datetime(2024, 1, 1)
LOG = "run_id long, node_id string, seq long, kind string, at timestamp, rows_read long, rows_written long, batches long, bytes_read long, bytes_written long, error_code string"
KINDS = ["started", "progressed", "progressed", "progressed", "succeeded", "failed", "retry_scheduled", "cancelled", "skipped"]


def random_log(seed, size=400):
    """A log in which one (run, node) owns most events."""
    rng = random.Random(seed)
    rows = []
    for seq in range(size):
        run = rng.choice([1, 1, 1, 1, 2, 3])
        node = "hot" if run == 1 else rng.choice(["a", "b"])
        kind = rng.choice(KINDS)
        error = f"e{seq % 3}" if kind == "failed" and seq % 2 else None
        totals = [rng.choice([None, seq, seq // 2]) for _ in TOTALS]
        rows.append((run, node, seq * 3 + 1, kind, START + timedelta(minutes=seq), *totals, error))
    return rows


def fold_by_hand(rows):
    """The event protocol, one event at a time."""
    steps, bad = {}, []
    for run, node, seq, kind, at, *totals, error in sorted(rows, key=lambda r: r[2]):
        mine = steps.setdefault((run, node), [])
        running = next((s for s in mine if s["status"] == "Running"), None)

        def opened(status, started, completed):
            mine.append({"status": status, "started": started, "completed": completed, "totals": [0] * len(TOTALS), "error": None})
            return mine[-1]

        if kind == "started":
            if running:
                running.update(status="Failed", completed=at, error="execution.lease-recovered")
            opened("Running", at, None)
            continue
        if kind == "skipped":
            opened("Skipped", None, at)
            continue
        if running is None and kind == "cancelled":
            running = opened("Running", at, None)
        if running is None:
            bad.append((run, node, seq, kind, "no_running_attempt"))
            continue
        if any(t is not None and t < top for t, top in zip(totals, running["totals"])):
            bad.append((run, node, seq, kind, "total_moved_backwards"))
        running["totals"] = [max(top, t or 0) for t, top in zip(totals, running["totals"])]
        if kind == "succeeded":
            running.update(status="Succeeded", completed=at)
        elif kind in ("failed", "retry_scheduled"):
            running.update(status="Failed", completed=at, error=error or "execution.node.failed")
        elif kind == "cancelled":
            running.update(status="Cancelled", completed=at)
    flat = [
        (run, node, i, s["status"], s["started"], s["completed"], *s["totals"], s["error"])
        for (run, node), mine in steps.items()
        for i, s in enumerate(mine, 1)
    ]
    return sorted(flat, key=repr), sorted(bad)


@pytest.mark.parametrize("seed,width", [(1, 7), (2, 50), (3, 1), (4, 100_000)])
def test_fold_matches_the_protocol_across_blocks(spark, seed, width):
    rows = random_log(seed)
    events = spark.createDataFrame(rows, LOG).repartition(3)
    want, bad = fold_by_hand(rows)
    assert sorted(map(tuple, fold_events(events, width).collect()), key=repr) == want
    assert sorted(map(tuple, event_problems(events, width).collect())) == bad


def test_fold_without_optional_columns(spark):
    rows = [r[:5] for r in random_log(5, 100)]
    got = fold_events(spark.createDataFrame(rows, LOG.split(", rows_read")[0]))
    want, _ = fold_by_hand([(*r, None, None, None, None, None, None) for r in rows])
    assert sorted(map(tuple, got.collect()), key=repr) == want


def test_carried_bounds_its_windows(spark):
    df = spark.range(1, 1001).select(F.lit("hot").alias("k"), F.col("id").alias("seq"), (F.col("id") * 7919 % 1000).alias("v"))
    got = carried(df, ["k"], "seq", 64, maxes={"top": F.col("v")}, sums={"n": F.col("v")}).orderBy("seq").collect()
    top = total_so_far = 0
    for r in got:
        total_so_far += r["v"]
        assert r["n"] == total_so_far and (r["top"] or 0) == top
        top = max(top, r["v"])
    assert block_width(df, "seq") == 1 << 16
    assert block_width(spark.range(0, 2).selectExpr("id * (1L << 40) AS seq"), "seq") == (1 << 24) + 1


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_matches_the_protocol(spark, tmp_path, batches):
    rows = random_log(7, 300)
    source = str(tmp_path / "log")
    per = len(rows) // batches
    for i in range(batches):
        spark.createDataFrame(rows[i * per : (i + 1) * per], LOG).coalesce(1).write.mode("append").parquet(source)
    stream = fold_stream(read_stream(spark, source, spark.read.parquet(source).schema, files_per_trigger=1))
    log = run_available(stream, "fold", str(tmp_path / "out"), str(tmp_path / "ck"))
    got = latest_steps(log).withColumn("run_id", F.col("run_id").cast("bigint"))
    want, _ = fold_by_hand(rows)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    # Nothing new: a second run adds nothing.
    before = log.count()
    assert run_available(stream, "fold", str(tmp_path / "out"), str(tmp_path / "ck")).count() == before


@pytest.mark.parametrize("hot", [False, True])
def test_micro_batches_match_the_protocol(spark, tmp_path, monkeypatch, hot):
    monkeypatch.setattr(streamed_steps, "SNAPSHOT", 2)
    rows = random_log(11, 300)
    if hot:
        rows = [(1, "n", *r[2:]) for r in rows]
    source, out, log = (str(tmp_path / f) for f in ("log", "out", "ck"))
    schema = spark.createDataFrame([], LOG).schema
    spark.createDataFrame([], LOG).coalesce(1).write.parquet(source)

    def fold():
        got = fold_available(read_stream(spark, source, schema, files_per_trigger=1), "fold", out, log)
        assert "Python" not in got._jdf.queryExecution().executedPlan().toString()
        return sorted(map(tuple, got.withColumn("run_id", F.col("run_id").cast("bigint")).collect()), key=repr)

    assert fold() == []
    for start in range(0, 300, 100):
        # Two micro-batches a call: attempts, running ones too, go on from call to call.
        for at in (start, start + 50):
            spark.createDataFrame(rows[at : at + 50], LOG).coalesce(1).write.mode("append").parquet(source)
        assert fold() == fold_by_hand(rows[: start + 100])[0]
    assert fold() == fold_by_hand(rows)[0]
    # An event without a run is left out.
    spark.createDataFrame([(None, "n", 1000, *r[3:]) for r in rows[:1]], LOG).write.mode("append").parquet(source)
    assert fold() == fold_by_hand(rows)[0]


def test_rollup(spark):
    steps = spark.createDataFrame([(1, "Succeeded"), (1, "Skipped"), (2, "Failed"), (2, "Cancelled"), (3, "Failed"), (3, "Succeeded"), (4, "Skipped")], "run_id long, status string")
    assert dict(map(tuple, status_rollup(steps).collect())) == {1: "Succeeded", 2: "Cancelled", 3: "Failed", 4: "Succeeded"}


RULES = [(10, 1, 1, True), (11, 1, 7, True), (12, 1, 7, False), (13, 2, 6, True), (14, 2, 0, True)]
RUNS = [(100, 1, "Failed"), (101, 1, "Succeeded"), (102, 2, "Cancelled"), (103, 2, "Running"), (104, 3, "Failed")]
HITS = [(10, 100, "Failed"), (11, 100, "Failed"), (11, 101, "Succeeded"), (13, 102, "Cancelled")]


def test_alert_rules(spark, tmp_path):
    rules = spark.createDataFrame(RULES, "rule_id long, workflow_id long, triggers int, enabled boolean")
    runs = spark.createDataFrame([(*r, START + timedelta(seconds=i)) for i in range(3) for r in RUNS], "run_id long, workflow_id long, status string, completed_at timestamp")
    got = match_rules(runs, rules)
    assert sorted((r["rule_id"], r["run_id"], r["status"]) for r in got.collect()) == HITS
    assert got.where("rule_id = 10").first()["delivery_key"] == "rule:10:run:100:event:RunFailed"
    assert {r["completed_at"] for r in got.collect()} == {START}
    source = str(tmp_path / "runs")
    for _ in range(2):
        runs.coalesce(1).write.mode("append").parquet(source)
    for again in (False, True):
        stream = match_rules_stream(read_stream(spark, source, runs.schema, files_per_trigger=1), rules)
        streamed = deliver_available(stream, "alerts", str(tmp_path / f"out{again}"), str(tmp_path / f"ck{again}"))
        assert sorted((r["rule_id"], r["run_id"], r["status"]) for r in streamed.collect()) == HITS


def test_late_runs_are_delivered(spark, tmp_path):
    """One file per micro-batch, the newest runs first: a run ten days older still gives its delivery."""
    rules = spark.createDataFrame(RULES, "rule_id long, workflow_id long, triggers int, enabled boolean")
    schema, source = "run_id long, workflow_id long, status string, completed_at timestamp", str(tmp_path / "runs")
    days = [(200 + i, 1, "Failed", START - timedelta(days=10 * i)) for i in range(4)]
    for row in days:
        spark.createDataFrame([row, days[0]], schema).coalesce(1).write.mode("append").parquet(source)
    runs = spark.read.parquet(source)
    stream = match_rules_stream(read_stream(spark, source, runs.schema, files_per_trigger=1), rules)
    got = deliver_available(stream, "late", str(tmp_path / "out"), str(tmp_path / "ck"))
    want = match_rules(runs, rules)
    assert sorted(r["delivery_key"] for r in got.collect()) == sorted(r["delivery_key"] for r in want.collect()) and want.count() == 8


@pytest.mark.parametrize("kept", [True, False])
def test_a_second_call_adds_to_what_was_delivered(spark, tmp_path, kept):
    """With the same checkpoint, or with a new one each time."""
    rules = spark.createDataFrame(RULES, "rule_id long, workflow_id long, triggers int, enabled boolean")
    schema, source, out = "run_id long, workflow_id long, status string, completed_at timestamp", str(tmp_path / "runs"), str(tmp_path / "out")
    seen = []
    for run in (1, 2, 3):
        spark.createDataFrame([(run, 1, "Failed", START)], schema).coalesce(1).write.mode("append").parquet(source)
        stream = match_rules_stream(read_stream(spark, source, spark.read.parquet(source).schema), rules)
        got = deliver_available(stream, "again", out, str(tmp_path / "ck") if kept else None)
        seen.append(sorted({r["run_id"] for r in got.collect()}))
        assert got.count() == got.select("delivery_key").distinct().count()
    assert seen == [[1], [1, 2], [1, 2, 3]]


def test_templates(spark):
    df = spark.createDataFrame([("r1", None), ("{{run.id}}", "E")], "id string, code string")
    text = "{{run.id}}|{{ error.code }}|{{workflow.name}}"
    shown = df.select(render_template(text, {"run.id": F.col("id"), "error.code": F.col("code")})).collect()
    assert [r[0] for r in shown] == ["r1||", "{{run.id}}|E|"]
    assert render_template("", {}) is not None
    for bad in ("{{run.id", "run.id}}", "{{other}}", "}}{{run.id}}"):
        with pytest.raises(TabularError):
            check_template(bad)


def test_pages_and_search(spark, monkeypatch):
    data = [(i, START + timedelta(hours=i % 10), "ok" if i % 3 else "bad", None if i % 2 else f"x%{i}") for i in range(100)]
    df = spark.createDataFrame(data, "id long, at timestamp, outcome string, note string")
    want = sorted((r[0] for r in data if r[2] == "ok"), key=lambda i: (i % 10, i), reverse=True)
    found = matching(df, {"outcome": "ok"})
    assert [r["id"] for r in page(found, "at", "id", 20, 15).collect()] == want[20:35]
    monkeypatch.setattr(ranks, "NEAR", 10)
    assert sorted(r["id"] for r in page(found, "at", "id", 20, 15).collect()) == sorted(want[20:35])
    assert total(found).first()[0] == len(want)
    ranged = matching(df, time_column="at", from_time=START + timedelta(hours=2), to_time=START + timedelta(hours=3))
    assert ranged.count() == 20
    assert matching(df, search="%4", search_columns=["note", "outcome"]).count() == 6
    labels = spark.createDataFrame([(1, "One"), (2, None)], "k long, label string")
    named = with_label(df.where("id < 4"), "id", labels, "k", "label", "Deleted workflow")
    assert [r["label"] for r in named.orderBy("id").collect()] == ["Deleted workflow", "One", "Deleted workflow", "Deleted workflow"]
    with pytest.raises(TabularError):
        page(df, "at", "id", -1, 5)
