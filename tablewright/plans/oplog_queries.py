"""Registered queries over event logs, alerts, sizes, streams and node graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.functions.values import TypedColumn
from tablewright.sources.delimited import read_delimited
from tablewright.session import scratch_path
from tablewright.oplog.alerts import match_rules, render_template
from tablewright.oplog.metrics import estimate_bytes
from tablewright.oplog.pages import matching, page, total, with_label
from tablewright.oplog.steps import event_problems, fold_events, status_rollup
from tablewright.plans.node_graph import run_nodes
from tablewright.plans.tables import table
from tablewright.plans.transform_queries import ORACLES, query
from tablewright.streaming.alerts import deliver_available, match_rules_stream
from tablewright.streaming.run import read_stream
from tablewright.streaming.steps import fold_available


@query("SELECT event_id, ts, user_id, event_type FROM events WHERE event_type = 'error' ORDER BY ts DESC, event_id DESC LIMIT 50 OFFSET 100")
def oplog_page(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type")
    return page(matching(events, {"event_type": "error"}), "ts", "event_id", 100, 50)


@query("SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 200000 OFFSET 500")
def oplog_deep_page(spark, folder):
    """A page too deep for top lists goes through distributed row numbers."""
    return page(table(spark, folder, "events").select("event_id", "ts"), "ts", "event_id", 500, 200_000)


@query("SELECT count(*) AS total_count FROM events WHERE event_type = 'error' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-25'")
def oplog_total(spark, folder):
    events = table(spark, folder, "events")
    return total(matching(events, {"event_type": "error"}, "ts", "2024-01-05", "2024-01-25"))


@query(
    """
    SELECT doc_id, lang, source FROM documents
    WHERE contains(text, 'the%') OR contains(text, 'tion') OR contains(source, 'tion') OR contains(coalesce(nullif(lang, 'en'), ''), 'tion')
    """
)
def oplog_search(spark, folder):
    """Text found in any of three columns, one of them nullable."""
    documents = table(spark, folder, "documents").select(
        "doc_id", "lang", "source", "text", F.nullif("lang", F.lit("en")).alias("other_lang")
    )
    return matching(documents, search="tion", search_columns=["text", "source", "other_lang"]).select("doc_id", "lang", "source")


@query(
    """
    SELECT e.event_id, e.user_id, coalesce(c.c_name, 'Deleted workflow') AS label
    FROM events e LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') c ON e.user_id = c.c_custkey
    """
)
def lookup_default_label(spark, folder):
    buyers = table(spark, folder, "customer").where("c_mktsegment <> 'BUILDING'")
    events = table(spark, folder, "events").select("event_id", "user_id")
    return with_label(events, "user_id", buyers, "c_custkey", "c_name", "Deleted workflow")


# --- event folding ------------------------------------------------------------------------


def node_events(events: DataFrame) -> DataFrame:
    """The event table read as a log: a user's events are a run's, value tells the node."""
    kind = (
        F.when(F.col("event_type") == "click", "started")
        .when(F.col("event_type") == "view", "progressed")
        .when(F.col("event_type") == "purchase", "succeeded")
        .when((F.col("event_type") == "error") & (F.col("value") < 20), "failed")
        .when(F.col("event_type") == "error", "retry_scheduled")
        .when(F.col("value") < 20, "cancelled")
        .otherwise("skipped")
    )
    return events.select(
        F.col("user_id").alias("run_id"), F.when(F.col("value") < 10, "extract").otherwise("load").alias("node_id"),
        F.col("event_id").alias("seq"), kind.alias("kind"), F.col("ts").alias("at"),
        F.col("event_id").alias("rows_read"),
        F.get_json_object("props", "$.k").cast("bigint").alias("rows_written"),
    )


LOG = """
    log AS (
        SELECT user_id AS run_id, CASE WHEN value < 10 THEN 'extract' ELSE 'load' END AS node_id, event_id AS seq, ts AS seen_at,
               CASE WHEN event_type = 'click' THEN 'started' WHEN event_type = 'view' THEN 'progressed'
                    WHEN event_type = 'purchase' THEN 'succeeded' WHEN event_type = 'error' AND value < 20 THEN 'failed'
                    WHEN event_type = 'error' THEN 'retry_scheduled' WHEN value < 20 THEN 'cancelled' ELSE 'skipped' END AS kind,
               event_id AS rows_read, CAST(json_extract_string(props, '$.k') AS BIGINT) AS rows_written
        FROM events),
    seen AS (
        SELECT *, max(CASE WHEN kind = 'started' THEN seq END) OVER w AS s,
               max(CASE WHEN kind IN ('succeeded', 'failed', 'retry_scheduled', 'cancelled') THEN seq END) OVER w AS e
        FROM log WINDOW w AS (PARTITION BY run_id, node_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    placed AS (
        SELECT *, s IS NOT NULL AND (e IS NULL OR s > e) AS running,
               kind IN ('started', 'skipped') OR (kind = 'cancelled' AND NOT (s IS NOT NULL AND (e IS NULL OR s > e))) AS opens
        FROM seen),
    homed AS (SELECT *, CASE WHEN opens THEN seq WHEN running THEN s END AS step FROM placed)
"""
STEPS = f"""
    WITH {LOG},
    parts AS (
        SELECT run_id, node_id, step, kind, CASE WHEN opens AND kind <> 'skipped' THEN seen_at END AS started_at,
               CASE WHEN kind NOT IN ('started', 'progressed') THEN seen_at END AS completed_at,
               CASE WHEN kind NOT IN ('started', 'skipped') THEN rows_read END AS rr,
               CASE WHEN kind NOT IN ('started', 'skipped') THEN rows_written END AS rw
        FROM homed WHERE step IS NOT NULL
        UNION ALL SELECT run_id, node_id, s, 'abandoned', NULL, seen_at, NULL, NULL FROM homed WHERE kind = 'started' AND running)
    SELECT run_id, node_id, row_number() OVER (PARTITION BY run_id, node_id ORDER BY step) AS attempt,
           CASE WHEN bool_or(kind = 'succeeded') THEN 'Succeeded'
                WHEN bool_or(kind IN ('failed', 'retry_scheduled', 'abandoned')) THEN 'Failed'
                WHEN bool_or(kind = 'cancelled') THEN 'Cancelled' WHEN bool_or(kind = 'skipped') THEN 'Skipped' ELSE 'Running' END AS status,
           max(started_at) AS started_at, max(completed_at) AS completed_at, coalesce(max(rr), 0) AS rows_read,
           coalesce(max(rw), 0) AS rows_written,
           CASE WHEN bool_or(kind = 'abandoned') THEN 'execution.lease-recovered'
                WHEN bool_or(kind IN ('failed', 'retry_scheduled')) THEN 'execution.node.failed' END AS error_code
    FROM parts GROUP BY run_id, node_id, step
"""


def _shown(steps: DataFrame) -> DataFrame:
    return steps.select(
        F.col("run_id").cast("bigint").alias("run_id"), "node_id", "attempt", "status",
        F.col("started_at").cast("timestamp_ntz").alias("started_at"),
        F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), "rows_read", "rows_written", "error_code",
    )


@query(STEPS)
def fold_events_batch(spark, folder):
    return _shown(fold_events(node_events(table(spark, folder, "events"))))


@query(
    f"""
    WITH {LOG},
    judged AS (
        SELECT *, max(CASE WHEN kind NOT IN ('started', 'skipped') THEN rows_written END) OVER w AS top
        FROM homed WINDOW w AS (PARTITION BY run_id, node_id, step ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
    SELECT run_id, node_id, seq, kind, CASE WHEN step IS NULL THEN 'no_running_attempt' ELSE 'total_moved_backwards' END AS problem
    FROM judged
    WHERE step IS NULL OR (kind NOT IN ('started', 'skipped') AND rows_written < coalesce(top, 0))
    """
)
def fold_event_problems(spark, folder):
    return event_problems(node_events(table(spark, folder, "events")))


@query(
    f"""
    SELECT run_id, CASE WHEN bool_or(status = 'Cancelled') THEN 'Cancelled' WHEN bool_or(status = 'Failed') THEN 'Failed'
           ELSE 'Succeeded' END AS run_status
    FROM ({STEPS}) GROUP BY run_id
    """
)
def run_status_rollup(spark, folder):
    steps = fold_events(node_events(table(spark, folder, "events")))
    return status_rollup(steps)


@query(STEPS)
def fold_events_stream(spark, folder):
    """The same fold as a stateful stream over the event table."""
    schema = table(spark, folder, "events").schema
    stream = node_events(read_stream(spark, folder, schema, "events.parquet"))
    return _shown(fold_available(stream, "steps"))


# --- alerts -------------------------------------------------------------------------------


def finished_runs(events: DataFrame) -> DataFrame:
    status = (
        F.when(F.col("event_type") == "purchase", "Succeeded").when(F.col("event_type") == "error", "Failed")
        .when(F.col("event_type") == "signup", "Cancelled").otherwise("Running")
    )
    return events.select(
        F.col("event_id").alias("run_id"), F.col("user_id").alias("workflow_id"), status.alias("status"),
        F.col("ts").alias("completed_at"),
    )


def customer_rules(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").selectExpr(
        "c_custkey AS rule_id", "c_custkey AS workflow_id", "c_nationkey % 8 AS triggers", "c_mktsegment <> 'MACHINERY' AS enabled"
    )


ORACLES["match_rules_batch"] = ORACLES["match_rules_streamed"] = """
    SELECT c_custkey AS rule_id, event_id AS run_id, user_id AS workflow_id, status,
           'rule:' || c_custkey || ':run:' || event_id || ':event:Run' || status AS delivery_key
    FROM customer JOIN (
        SELECT *, CASE event_type WHEN 'purchase' THEN 'Succeeded' WHEN 'error' THEN 'Failed' WHEN 'signup' THEN 'Cancelled' END AS status
        FROM events) ON user_id = c_custkey
    WHERE c_mktsegment <> 'MACHINERY'
      AND ((c_nationkey % 8) & CASE status WHEN 'Failed' THEN 1 WHEN 'Succeeded' THEN 2 WHEN 'Cancelled' THEN 4 ELSE 0 END) <> 0
"""


@query()
def match_rules_batch(spark, folder):
    """Every run event arrives twice; each delivery is made once."""
    runs = finished_runs(table(spark, folder, "events"))
    return match_rules(runs.union(runs), customer_rules(spark, folder)).drop("completed_at")


@query()
def match_rules_streamed(spark, folder):
    schema = table(spark, folder, "events").schema
    runs = finished_runs(read_stream(spark, folder, schema, "events.parquet"))
    twice = runs.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    matched = match_rules_stream(twice, customer_rules(spark, folder))
    return deliver_available(matched, "deliveries").drop("completed_at")


@query(
    """
    SELECT event_id, 'Run ' || event_id || ' is ' || event_type || ': ' || coalesce(nullif(event_type, 'error'), '') || ' {{run.id}}' AS message
    FROM events
    """
)
def render_template_messages(spark, folder):
    events = table(spark, folder, "events")
    values = {
        "run.id": F.col("event_id"), "run.status": F.col("event_type"),
        "error.code": F.concat(F.nullif("event_type", F.lit("error"))), "error.summary": F.lit("{{run.id}}"),
    }
    text = "Run {{run.id}} is {{ run.status }}: {{error.code}} {{error.summary}}{{workflow.name}}"
    return events.select("event_id", render_template(text, values).alias("message"))


@query(
    """
    SELECT CAST(sum(8 + CASE WHEN o_orderstatus = 'P' THEN 1 ELSE octet_length(encode(o_orderstatus)) END + 8 + 16
                    + octet_length(encode(o_orderpriority)) + 1 + 8) AS BIGINT) AS estimated_bytes
    FROM orders
    """
)
def estimate_bytes_orders(spark, folder):
    orders = table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))
    return estimate_bytes(orders.withColumn("big", F.col("o_totalprice") > 5))


# --- node graph ---------------------------------------------------------------------------


def flagship_graph(folder: str) -> dict:
    return {
        "nodes": [
            {"id": "lines", "kind": "parquetSource", "settings": {"path": f"{folder}/lineitem.parquet"}},
            {"id": "orders", "kind": "parquetSource", "settings": {"path": f"{folder}/orders.parquet"}},
            {"id": "recent", "kind": "filterRows", "settings": {"conditions": [
                {"column": "l_shipdate", "operator": "greaterThanOrEqual", "value": "1996-01-01"}]}},
            {"id": "priced", "kind": "deriveColumns", "settings": {"columns": [
                {"name": "taxed", "expression": "l_quantity * vars.factor", "type": "double"}]}},
            {"id": "joined", "kind": "join", "settings": {"left_keys": ["l_orderkey"], "right_keys": ["o_orderkey"], "how": "inner"}},
            {"id": "totals", "kind": "aggregateRows", "settings": {"group_by": ["o_orderpriority"], "aggregates": [
                {"name": "line_count", "operation": "count"},
                {"name": "weighted", "operation": "sum", "column": "taxed"}]}},
            {"id": "sorted", "kind": "sortRows", "settings": {"keys": ["o_orderpriority"]}},
        ],
        "edges": [
            {"from": "lines", "to": "recent"}, {"from": "recent", "to": "priced"}, {"from": "priced", "to": "joined"},
            {"from": "orders", "to": "joined"}, {"from": "joined", "to": "totals"}, {"from": "totals", "to": "sorted"},
        ],
    }


@query(
    """
    SELECT o_orderpriority, count(*) AS line_count, sum(l_quantity * 3) AS weighted
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= TIMESTAMP '1996-01-01' GROUP BY 1
    """
)
def node_graph_totals(spark, folder):
    table(spark, folder, "orders")
    run = run_nodes(spark, flagship_graph(folder.rstrip("/")), {"factor": 3})
    return run.frames["sorted"]


def bound_graph(folder: str, output: str) -> dict:
    """Orders above a looked-up balance, derived by a function and written through bindings."""
    return {
        "variables": [
            {"name": "least", "type": "double", "lookup": {"path": f"{folder}/customer.parquet", "value": "c_acctbal", "filter": "c_custkey", "equals": 1}},
            {"name": "mark", "type": "string", "value": "checked"},
        ],
        "functions": [{"name": "share_of", "parameters": {"part": "double", "whole": "double"}, "returns": "double", "expression": "round(part / (whole + 1), 2)"}],
        "nodes": [
            {"id": "orders", "kind": "parquetSource", "settings": {"path": f"{folder}/orders.parquet"}},
            {"id": "urgent", "kind": "filterRows", "settings": {"conditions": [{"column": "o_orderpriority", "operator": "equals", "value": "1-URGENT"}]}},
            {"id": "shared", "kind": "deriveColumns", "settings": {"columns": [
                {"name": "share", "expression": "share_of(o_totalprice, abs(vars.least))", "type": "double"}, {"name": "kind", "expression": "lower(o_orderstatus)", "type": "string"}]}},
            {"id": "written", "kind": "csvTarget", "settings": {"path": output, "columns": "id bigint, share double, kind string, mark string", "bindings": {
                "id": {"column": "o_orderkey"}, "share": {"column": "share"}, "kind": {"expression": "concat(kind, '-', o_orderstatus)"}, "mark": {"variable": "mark"}}}},
        ],
        "edges": [{"from": "orders", "to": "urgent"}, {"from": "urgent", "to": "shared"}, {"from": "shared", "to": "written"}],
    }


@query(
    """
    SELECT o_orderkey AS id, round(o_totalprice / (abs(c_acctbal) + 1), 2) AS share, lower(o_orderstatus) || '-' || o_orderstatus AS kind, 'checked' AS mark
    FROM orders, (SELECT c_acctbal FROM customer WHERE c_custkey = 1) WHERE o_orderpriority = '1-URGENT'
    """
)
def node_graph_bindings(spark, folder):
    """A graph with a looked-up variable, a function and bindings; its target, read back."""
    table(spark, folder, "orders")
    output = scratch_path(spark, "graph-out")
    run = run_nodes(spark, bound_graph(folder.rstrip("/"), output))
    assert set(run.status.values()) == {"Succeeded"}, run.errors
    columns = [TypedColumn("id", "int64"), TypedColumn("share", "double"), TypedColumn("kind"), TypedColumn("mark")]
    return read_delimited(spark, output, columns=columns)


SIZE = "8 + 8 + strlen(o_orderstatus) + 8 + 16 + strlen(o_orderpriority)"


@query(
    f"""
    SELECT 'orders' AS node, count(*) AS rows, sum({SIZE})::BIGINT AS bytes FROM orders
    UNION ALL SELECT 'urgent', count(*), sum({SIZE})::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'shared', count(*), sum({SIZE} + 8 + 1)::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT'
    UNION ALL SELECT 'written', count(*), sum({SIZE} + 8 + 1)::BIGINT FROM orders WHERE o_orderpriority = '1-URGENT'
    """
)
def node_graph_progress(spark, folder):
    """Rows and estimated bytes that each node of a run gave, counted while its target was written."""
    table(spark, folder, "orders")
    run = run_nodes(spark, bound_graph(folder.rstrip("/"), scratch_path(spark, "graph-out")), progress=True)
    return spark.createDataFrame([(n, p["rows"], p["bytes"]) for n, p in run.progress.items()], "node string, rows long, bytes long")
