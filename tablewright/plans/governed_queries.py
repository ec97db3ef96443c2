"""Registered queries over governed tables: contracts, pages, references and staged edits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.governed.cells import normalise_cell
from tablewright.governed.changes import (
    apply_changes,
    diff_snapshots,
    split_changes,
    stage_changes,
    validate_changes,
)
from tablewright.governed.contract import ContractColumn, ForeignKey, TableContract, contract_for, pinned, project
from tablewright.governed.query import count_rows, keyset_page, where_contract
from tablewright.governed.references import fk_lookup, fk_tuples, missing_fk, resolve_labels
from tablewright.plans.tables import table
from tablewright.plans.transform_queries import query
from tablewright.schema import schema_drift

ORDERS = TableContract(
    (
        ContractColumn("o_orderkey", "orderKey", "int64", nullable=False, key=0),
        ContractColumn("o_custkey", "customer", "int64", writable=True),
        ContractColumn("o_orderstatus", "status", "string", writable=True, max_length=1),
        ContractColumn("o_totalprice", "price", "double", writable=True),
        ContractColumn("o_orderdate", "orderDate", "datetime"),
        ContractColumn("o_orderpriority", "priority", "string", readable=False),
    )
)
PUBLIC_ORDERS = """
    (SELECT o_orderkey AS "orderKey", o_custkey AS customer, nullif(o_orderstatus, 'P') AS status,
            o_totalprice AS price, o_orderdate AS "orderDate" FROM orders)
"""


def orders_source(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").withColumn("o_orderstatus", F.nullif("o_orderstatus", F.lit("P")))


def public_orders(spark, folder) -> DataFrame:
    return project(orders_source(spark, folder), ORDERS)


@query(f"SELECT * FROM {PUBLIC_ORDERS}")
def contract_projection(spark, folder):
    return public_orders(spark, folder)


CONTRACT_FILTERS = {
    "eq": ("status", "eq", "O", "status = 'O'"),
    "ne": ("status", "ne", "O", "status <> 'O'"),
    "gt": ("price", "gt", "250000.5", "price > 250000.5"),
    "ge": ("orderDate", "ge", "1998-01-01T00:00:00", "\"orderDate\" >= TIMESTAMP '1998-01-01'"),
    "lt": ("customer", "lt", "100", "customer < 100"),
    "le": ("price", "le", "50000", "price <= 50000"),
    "startswith": ("status", "startswith", "F", "starts_with(status, 'F')"),
    "contains": ("status", "contains", "O", "contains(status, 'O')"),
    "isnull": ("status", "isnull", None, "status IS NULL"),
    "isnotnull": ("status", "isnotnull", None, "status IS NOT NULL"),
}


def _contract_filter(name: str, test):
    def run(spark, folder):
        return where_contract(public_orders(spark, folder), ORDERS, [test])

    run.__name__ = f"contract_filter_{name}"
    return run


for _name, (_alias, _operator, _value, _where) in CONTRACT_FILTERS.items():
    query(f"SELECT * FROM {PUBLIC_ORDERS} WHERE {_where}")(_contract_filter(_name, (_alias, _operator, _value)))


@query(f"SELECT count(*) AS row_count FROM {PUBLIC_ORDERS} WHERE status <> 'F' AND price > 100000")
def contract_count(spark, folder):
    return count_rows(public_orders(spark, folder), ORDERS, [("status", "ne", "F"), ("price", "gt", "100000")])


@query(
    f"""
    SELECT * FROM {PUBLIC_ORDERS}
    WHERE status > 'F' OR (status = 'F' AND ("orderDate" < TIMESTAMP '1998-03-04' OR "orderDate" IS NULL))
       OR (status = 'F' AND "orderDate" = TIMESTAMP '1998-03-04' AND "orderKey" > 5)
    ORDER BY status NULLS FIRST, "orderDate" DESC NULLS LAST, "orderKey" LIMIT 101
    """
)
def keyset_page_orders(spark, folder):
    after = ["F", datetime(1998, 3, 4), 5]
    return keyset_page(public_orders(spark, folder), ORDERS, [("status", False), ("orderDate", True)], after, 100)


@query(
    f"""
    SELECT * FROM {PUBLIC_ORDERS} WHERE status IS NOT NULL OR (status IS NULL AND "orderKey" > 20)
    ORDER BY status NULLS FIRST, "orderKey" LIMIT 51
    """
)
def keyset_page_after_null(spark, folder):
    return keyset_page(public_orders(spark, folder), ORDERS, [("status", False)], [None, 20], 50)


@query(
    """
    SELECT octet_length(encode(text)) > 2000 AS "__oversize", doc_id,
           CASE WHEN octet_length(encode(text)) > 2000 THEN NULL ELSE text END AS text, lang, source, n_chars
    FROM documents
    """
)
def oversize_guard(spark, folder):
    documents = table(spark, folder, "documents")
    return project(documents, contract_for(documents, ["doc_id"], max_cell_bytes=2000), guard_cells=True)


# --- references ---------------------------------------------------------------------------

NATION_KEY = ForeignKey("customer_nation", "nation", "n_nationkey", "n_name", ("n_name", "n_nationkey"))
CUSTOMERS = TableContract(
    (
        ContractColumn("c_custkey", "id", "int64", nullable=False, key=0),
        ContractColumn("c_name", "name", "string", writable=True, max_length=40),
        ContractColumn("c_nationkey", "nation", "int32", writable=True, foreign_key=NATION_KEY),
        ContractColumn("c_acctbal", "balance", "double", writable=True),
        ContractColumn("c_mktsegment", "segment", "string", writable=True),
    )
)


def public_customers(spark, folder) -> DataFrame:
    return project(table(spark, folder, "customer"), CUSTOMERS)


@query(
    """
    SELECT n_name AS display, n_nationkey AS nation FROM nation
    WHERE contains(n_name, '1') OR contains(CAST(n_nationkey AS VARCHAR), '1') ORDER BY n_name, n_nationkey LIMIT 11
    """
)
def fk_lookup_nation(spark, folder):
    nations = table(spark, folder, "nation")
    return fk_lookup(nations, [CUSTOMERS.find("nation")], "n_name", NATION_KEY.search, "1", take=10)


@query("SELECT c_custkey AS id, c_nationkey AS nation, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 2")
def fk_labels(spark, folder):
    """Labels for the nations that exist; requests for the others are left out."""
    requests = public_customers(spark, folder).select("id", "nation")
    nations = table(spark, folder, "nation").where("n_regionkey <> 2")
    return resolve_labels(requests, ["nation"], nations, ["n_nationkey"], "n_name")


def edited_customers(spark, folder) -> DataFrame:
    """Customers after an editing session: some changed, some gone, some new."""
    now = public_customers(spark, folder)
    kept = now.where("segment <> 'MACHINERY'").select(
        "id",
        F.when(F.col("nation") == 3, F.concat("name", F.lit(" (moved)"))).otherwise(F.col("name")).alias("name"),
        F.when(F.col("nation") == 4, 40).otherwise(F.col("nation")).alias("nation"),
        F.when(F.col("balance") < 0, None).otherwise(F.col("balance")).alias("balance"),
        "segment",
    )
    new = now.where("nation = 7").select(
        (F.col("id") + 10_000_000).alias("id"), F.lit("New").alias("name"), F.lit(7).alias("nation"),
        F.lit(0.0).alias("balance"), "segment",
    )
    return kept.union(new)


EDITED = """
    (SELECT c_custkey AS id, CASE WHEN c_nationkey = 3 THEN c_name || ' (moved)' ELSE c_name END AS name,
            CASE WHEN c_nationkey = 4 THEN 40 ELSE c_nationkey END AS nation,
            CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END AS balance, c_mktsegment AS segment
     FROM customer WHERE c_mktsegment <> 'MACHINERY'
     UNION ALL SELECT c_custkey + 10000000, 'New', 7, 0.0, c_mktsegment FROM customer WHERE c_nationkey = 7)
"""
CUSTOMER_ROWS = "(SELECT c_custkey AS id, c_name AS name, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer)"
DIFF = f"""
    SELECT CASE WHEN o.id IS NULL THEN 'insert' WHEN n.id IS NULL THEN 'delete' ELSE 'update' END AS op, o.id AS id,
           CASE WHEN n.id IS NULL THEN NULL WHEN o.id IS NULL THEN n.id END AS new_id,
           CASE WHEN n.id IS NOT NULL AND o.name IS DISTINCT FROM n.name THEN n.name END AS name,
           CASE WHEN n.id IS NOT NULL AND o.nation IS DISTINCT FROM n.nation THEN n.nation END AS nation,
           CASE WHEN n.id IS NOT NULL AND o.balance IS DISTINCT FROM n.balance THEN n.balance END AS balance,
           CASE WHEN n.id IS NULL THEN '' WHEN o.id IS NULL THEN 'id,name,nation,balance,segment'
                ELSE concat_ws(',', CASE WHEN o.name IS DISTINCT FROM n.name THEN 'name' END,
                                    CASE WHEN o.nation IS DISTINCT FROM n.nation THEN 'nation' END,
                                    CASE WHEN o.balance IS DISTINCT FROM n.balance THEN 'balance' END,
                                    CASE WHEN o.segment IS DISTINCT FROM n.segment THEN 'segment' END) END AS changed
    FROM {CUSTOMER_ROWS} o FULL JOIN {EDITED} n ON o.id = n.id
    WHERE o.id IS NULL OR n.id IS NULL OR o.name IS DISTINCT FROM n.name OR o.nation IS DISTINCT FROM n.nation
       OR o.balance IS DISTINCT FROM n.balance OR o.segment IS DISTINCT FROM n.segment
"""


def customer_changes(spark, folder) -> DataFrame:
    return diff_snapshots(public_customers(spark, folder), edited_customers(spark, folder), CUSTOMERS)


@query(DIFF)
def diff_snapshots_customers(spark, folder):
    changes = customer_changes(spark, folder)
    return changes.select(
        "op", F.col("key.id").alias("id"), F.col("after.id").alias("new_id"), "after.name", "after.nation",
        "after.balance", F.array_join("changed", ",").alias("changed"),
    )


@query(f"SELECT DISTINCT n.nation FROM ({DIFF}) n WHERE n.nation IS NOT NULL AND n.nation NOT IN (SELECT n_nationkey FROM nation)")
def fk_missing(spark, folder):
    """Nation 40 does not exist, so the edit would be rejected."""
    return missing_fk(customer_changes(spark, folder), CUSTOMERS, "customer_nation", table(spark, folder, "nation"))


@query(f"SELECT nation FROM ({DIFF}) WHERE nation IS NOT NULL")
def fk_tuples_changed(spark, folder):
    return fk_tuples(customer_changes(spark, folder), CUSTOMERS, "customer_nation")


# --- staged JSON edits --------------------------------------------------------------------

STAGED = """
    (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority,
            CASE o_orderpriority WHEN '1-URGENT' THEN 'update' WHEN '2-HIGH' THEN 'delete' WHEN '5-LOW' THEN 'update' ELSE 'insert' END AS op
     FROM orders)
"""


def staged_json(spark, folder) -> DataFrame:
    """Order edits as JSON: good updates, deletes and inserts, and three kinds of bad ones."""
    orders = table(spark, folder, "orders")
    urgent, high, low = (F.col("o_orderpriority") == p for p in ("1-URGENT", "2-HIGH", "5-LOW"))
    op = F.when(urgent | low, "update").when(high, "delete").otherwise("insert")
    key = F.to_json(F.struct(F.col("o_orderkey").alias("orderKey")))
    before = F.to_json(
        F.struct(
            F.col("o_orderkey").alias("orderKey"), F.col("o_custkey").alias("customer"),
            F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"),
        )
    )
    # Low-priority updates set a two-letter status; 4-NOT SPECIFIED inserts lack their key.
    changed = F.to_json(F.struct(F.lit("F").alias("status"), (F.col("o_totalprice") + 1).alias("Price")))
    too_long = F.to_json(F.struct(F.lit("FF").alias("status")))
    fresh = F.to_json(
        F.struct((F.col("o_orderkey") + 10_000_000).alias("orderKey"), F.col("o_custkey").alias("customer"))
    )
    keyless = F.to_json(F.struct(F.col("o_custkey").alias("customer")))
    after = (
        F.when(urgent, changed).when(low, too_long).when(high, None)
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", keyless).otherwise(fresh)
    )
    return orders.select(
        "o_orderkey", "o_orderpriority", op.alias("op"), F.when(op != "insert", key).alias("key_json"),
        F.when(op != "insert", before).alias("before_json"), after.alias("after_json"),
    )


@query(
    """
    SELECT o_orderkey, CASE o_orderpriority WHEN '5-LOW' THEN 'change_value_invalid'
           WHEN '4-NOT SPECIFIED' THEN 'change_required_values_missing' ELSE '' END AS problems
    FROM orders
    """
)
def validate_changes_orders(spark, folder):
    checked = validate_changes(staged_json(spark, folder), ORDERS)
    return checked.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


def valid_changes(spark, folder) -> DataFrame:
    return split_changes(staged_json(spark, folder), ORDERS)[0]


@query(
    """
    SELECT o_orderkey, o_custkey, CASE WHEN o_orderpriority = '1-URGENT' THEN 'F' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice,
           o_orderdate, o_orderpriority
    FROM orders WHERE o_orderpriority <> '2-HIGH'
    UNION ALL SELECT o_orderkey + 10000000, o_custkey, NULL, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '3-MEDIUM'
    """
)
def apply_original_values(spark, folder):
    """All valid edits applied at once against unchanged originals."""
    outcome = apply_changes(table(spark, folder, "orders"), valid_changes(spark, folder), ORDERS)
    assert outcome.status == "Applied", outcome.status
    return outcome.state


@query(
    """
    SELECT o_orderkey AS "orderKey", CASE WHEN o_orderstatus = 'F' THEN 'row_missing' ELSE 'row_changed' END AS reason
    FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND (o_orderstatus = 'F' OR o_custkey < 500)
    """
)
def apply_conflicts(spark, folder):
    """Some originals changed and some rows vanished since the edits were staged."""
    orders = table(spark, folder, "orders")
    stored = orders.where("o_orderstatus <> 'F'").withColumn(
        "o_totalprice", F.when(F.col("o_custkey") < 500, F.col("o_totalprice") + 7).otherwise(F.col("o_totalprice"))
    )
    outcome = apply_changes(stored, valid_changes(spark, folder), ORDERS)
    assert outcome.status == "Conflict", outcome.status
    return outcome.conflicts


VERSIONED = TableContract(
    (
        ContractColumn("o_orderkey", "id", "int64", nullable=False, key=0),
        ContractColumn("o_orderstatus", "status", "string", writable=True),
        ContractColumn("version", "version", "int64", token=True),
    ),
    concurrency="row_version",
)


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_custkey AS version FROM orders")
def apply_row_version(spark, folder):
    """Only the key and the version token must match."""
    stored = table(spark, folder, "orders").selectExpr("o_orderkey", "o_orderstatus", "o_custkey AS version", "o_totalprice")
    target = stored.drop("o_totalprice")
    before = project(target, VERSIONED)
    now = stored.selectExpr(
        "o_orderkey AS id", "CASE WHEN o_totalprice > 200000 THEN 'X' ELSE o_orderstatus END AS status", "version"
    )
    outcome = apply_changes(target, diff_snapshots(before, now, VERSIONED), VERSIONED)
    assert outcome.status == "Applied", outcome.status
    return outcome.state


@query(
    f"""
    SELECT p.*, d.refused FROM (SELECT o_orderkey AS "orderKey", o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price, o_orderdate AS "orderDate" FROM orders) p,
           (SELECT 'type o_totalprice: double -> decimal(20,2); removed o_orderpriority; added rank' AS refused) d
    """
)
def read_under_pinned_contract(spark, folder):
    """Rows are served while the table is what the contract was made for; after a change of columns nothing is."""
    orders = table(spark, folder, "orders")
    contract = pinned(ORDERS, orders)
    changed = orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(20,2)")).withColumnRenamed("o_orderpriority", "rank")
    refused = None
    for attempt in (lambda: project(changed, contract), lambda: apply_changes(changed, valid_changes(spark, folder), contract)):
        try:
            attempt()
        except TabularError as error:
            assert "contract.schema_changed" in str(error)
            drift = schema_drift(orders, changed)
            refused = "; ".join(sorted(drift, key=lambda d: ("type", "removed", "added").index(d.split()[0])))
        else:
            raise AssertionError("a changed table was read")
    return project(orders, contract).withColumn("refused", F.lit(refused))


# --- several changes to one key -----------------------------------------------------------


def ordered_edits(spark, folder) -> DataFrame:
    """Chains of edits per order, each against what the edit before it left; all first edits come before all second ones."""
    orders = table(spark, folder, "orders")
    cells = {"orderKey": "o_orderkey", "customer": "o_custkey", "status": "o_orderstatus", "price": "o_totalprice"}

    def edit(step: int, op: str, shift: int = 0, before: dict | None = None, **after):
        key = F.col("o_orderkey") + shift
        known = {a: F.col(c) for a, c in cells.items()} | {"orderKey": key} | (before or {})
        if op == "insert":
            after = {"orderKey": key} | after
        cell = lambda values, c: values.get(c.alias, F.lit(None)).cast(c.spark_type).alias(c.alias)
        return F.struct(
            (F.lit(step * 10**10) + F.col("o_orderkey")).alias("ordinal"), F.lit(op).alias("op"),
            F.when(F.lit(op != "insert"), F.struct(key.alias("orderKey"))).alias("key"),
            F.when(F.lit(op != "insert"), F.struct(*[cell(known, c) for c in ORDERS.readable])).alias("before"),
            F.array(*[F.lit(a) for a in cells]).alias("before_names"),
            F.struct(*[cell(after, c) for c in ORDERS.insertable]).alias("after"),
            F.array(*[F.lit(a) for a in after]).cast("array<string>").alias("changed"),
        )

    none = F.lit(None)
    made = {"customer": F.col("o_custkey"), "status": F.lit("N"), "price": none}
    chains = {
        "1-URGENT": [edit(1, "update", status=F.lit("X")), edit(2, "update", before={"status": F.lit("X")}, price=F.col("o_totalprice") + 1)],
        "2-HIGH": [edit(1, "delete"), edit(2, "insert", customer=F.lit(7))],
        "3-MEDIUM": [edit(1, "insert", 10**7, customer=F.col("o_custkey"), status=F.lit("N")), edit(2, "update", 10**7, made, price=F.lit(5.0))],
        "4-NOT SPECIFIED": [edit(1, "insert", 2 * 10**7), edit(2, "delete", 2 * 10**7, {"customer": none, "status": none, "price": none})],
        "5-LOW": [edit(1, "update", status=F.lit("Z"))],
    }
    chosen = F.coalesce(*[F.when(F.col("o_orderpriority") == p, F.array(*edits)) for p, edits in chains.items()])
    return orders.select(F.explode(chosen).alias("e")).select("e.*")


@query(
    """
    SELECT o_orderkey, o_custkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'X' WHEN '5-LOW' THEN 'Z' ELSE o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderpriority = '1-URGENT' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderpriority <> '2-HIGH'
    UNION ALL SELECT o_orderkey, 7, NULL, NULL, NULL, NULL FROM orders WHERE o_orderpriority = '2-HIGH'
    UNION ALL SELECT o_orderkey + 10000000, o_custkey, 'N', 5.0, NULL, NULL FROM orders WHERE o_orderpriority = '3-MEDIUM'
    """
)
def apply_ordered_changes(spark, folder):
    """Update after update, insert after delete, update and delete of new rows: each key's edits reach the table as one."""
    outcome = apply_changes(table(spark, folder, "orders"), ordered_edits(spark, folder), ORDERS, ordered=True)
    assert outcome.status == "Applied", outcome.status
    return outcome.state


@query("SELECT o_orderkey AS \"orderKey\", 'row_changed' AS reason FROM orders WHERE o_orderpriority = '1-URGENT'")
def apply_ordered_conflicts(spark, folder):
    """Second edits made against what the first ones had not left refuse the whole set."""
    edits = ordered_edits(spark, folder)
    stale = (F.col("op") == "update") & (F.col("before.status") == "X")
    edits = edits.withColumn("before", F.when(stale, F.col("before").withField("status", F.lit("W"))).otherwise(F.col("before")))
    outcome = apply_changes(table(spark, folder, "orders"), edits, ORDERS, ordered=True)
    assert outcome.status == "Conflict", outcome.status
    return outcome.conflicts


# --- references in the edit path ----------------------------------------------------------

RANK = [ForeignKey("rank", "ranks", column, "label", ("label",), i) for i, column in enumerate(("r_status", "r_priority"))]
RANKED = TableContract(
    (
        ContractColumn("o_orderkey", "id", "int64", nullable=False, key=0),
        ContractColumn("o_orderstatus", "status", "string", writable=True, foreign_key=RANK[0]),
        ContractColumn("o_orderpriority", "priority", "string", writable=True, foreign_key=RANK[1]),
        ContractColumn("o_custkey", "customer", "int64", writable=True),
    )
)


def ranks(spark, folder) -> DataFrame:
    """Pairs of status and priority that orders use, all but those of pending urgent ones."""
    used = table(spark, folder, "orders").select(F.col("o_orderstatus").alias("r_status"), F.col("o_orderpriority").alias("r_priority")).distinct()
    return used.where("NOT (r_status = 'P' AND r_priority = '1-URGENT')").withColumn("label", F.concat_ws(" ", "r_status", "r_priority"))


def ranked_json(spark, folder) -> DataFrame:
    """Edits of a two-column reference: whole, in part, nulled whole or in part; and inserts that bring one."""
    orders = table(spark, folder, "orders")
    kind = F.col("o_custkey") % 6
    key = F.to_json(F.struct(F.col("o_orderkey").alias("id")))
    before = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_custkey").alias("customer")))
    pair = lambda **cells: F.to_json(F.struct(*[c.alias(n) for n, c in cells.items()]), {"ignoreNullFields": "false"})
    none = F.lit(None).cast("string")
    after = (
        F.when(kind == 0, pair(status=F.lit("P"), priority=F.col("o_orderpriority")))
        .when(kind == 1, pair(status=F.lit("P")))
        .when(kind == 2, pair(status=none, priority=none))
        .when(kind == 3, pair(status=none, priority=F.lit("5-LOW")))
        .when(kind == 4, pair(customer=F.lit(1)))
        .otherwise(pair(id=F.col("o_orderkey") + 10**7, status=F.lit("Q"), priority=F.col("o_orderpriority")))
    )
    insert = kind == 5
    return orders.select(
        "o_orderkey", "o_custkey", F.when(insert, "insert").otherwise("update").alias("op"), F.when(~insert, key).alias("key_json"),
        F.when(~insert, before).alias("before_json"), after.alias("after_json"),
    )


@query(
    """
    SELECT o_orderkey, CASE o_custkey % 6 WHEN 1 THEN 'foreign_key_partial_update' WHEN 3 THEN 'foreign_key_partial_null' ELSE '' END AS problems FROM orders
    """
)
def validate_reference_pairs(spark, folder):
    """A two-column reference is set whole or not at all, and is null whole or not at all."""
    checked = validate_changes(ranked_json(spark, folder), RANKED)
    return checked.select("o_orderkey", F.array_join("problems", ",").alias("problems"))


@query(
    """
    SELECT DISTINCT 'rank' AS foreign_key, CASE WHEN o_custkey % 6 = 0 THEN 'P' ELSE 'Q' END AS status, o_orderpriority AS priority
    FROM orders WHERE (o_custkey % 6 = 0 AND o_orderpriority = '1-URGENT') OR o_custkey % 6 = 5
    """
)
def stage_reference_pairs(spark, folder):
    """Pairs that no row has refuse the set, though each change is valid by itself; nulled pairs refer to nothing."""
    staged = stage_changes(ranked_json(spark, folder).where("o_custkey % 6 IN (0, 2, 4, 5)"), RANKED, {"ranks": ranks(spark, folder)})
    assert staged.status == "Rejected", staged.status
    return staged.missing.select("foreign_key", F.col("tuple.status").alias("status"), F.col("tuple.priority").alias("priority"))


@query("SELECT DISTINCT 'customer_nation' AS foreign_key, '40' AS nation FROM customer WHERE c_nationkey = 4 AND c_mktsegment <> 'MACHINERY'")
def apply_missing_reference(spark, folder):
    """An edit that moves customers to a nation that does not exist leaves the table as it is."""
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    outcome = apply_changes(customers, customer_changes(spark, folder), CUSTOMERS, references={"nation": table(spark, folder, "nation")})
    assert outcome.status == "Conflict" and outcome.state is customers
    return outcome.conflicts.select("foreign_key", F.col("tuple.nation").alias("nation"))


@query(
    """
    SELECT o_orderkey AS id, CASE WHEN o_custkey % 3 = 0 THEN 'status,priority' ELSE 'status,priority,customer' END AS changed,
           CASE WHEN o_custkey % 3 = 0 THEN o_orderstatus ELSE 'P' END AS status, CASE WHEN o_custkey % 3 = 0 THEN '5-LOW' ELSE o_orderpriority END AS priority
    FROM orders WHERE (o_custkey % 3 = 0 AND o_orderpriority <> '5-LOW') OR (o_custkey % 3 = 1 AND o_orderstatus <> 'P')
    """
)
def diff_reference_pairs(spark, folder):
    """One changed part of a two-column reference brings the other along."""
    old = project(table(spark, folder, "orders"), RANKED)
    third = F.col("customer") % 3
    new = old.select(
        "id", F.when(third == 1, "P").otherwise(F.col("status")).alias("status"), F.when(third == 0, "5-LOW").otherwise(F.col("priority")).alias("priority"),
        F.when((third == 1) & (F.col("status") != "P"), F.col("customer") + 1).otherwise(F.col("customer")).alias("customer"),
    )
    changes = diff_snapshots(old, new, RANKED)
    return changes.select(F.col("key.id").alias("id"), F.array_join("changed", ",").alias("changed"), "after.status", "after.priority")


CELL_COLUMNS = (
    ContractColumn("", "whole", "int16", nullable=False),
    ContractColumn("", "money", "decimal", precision=7, scale=2),
    ContractColumn("", "word", "string", max_length=8),
    ContractColumn("", "day", "date"),
)


@query(
    """
    SELECT o_orderkey,
           CASE WHEN o_orderstatus = 'P' THEN 'Required' WHEN o_custkey > 32767 THEN 'InvalidType' END AS whole_code,
           CASE WHEN o_orderstatus <> 'P' AND o_custkey <= 32767 THEN CAST(o_custkey AS BIGINT) END AS whole_value,
           CASE WHEN o_totalprice >= 100000 THEN 'NumericPrecision' END AS money_code,
           CASE WHEN o_totalprice < 100000 THEN o_totalprice END AS money_value,
           CASE WHEN length(o_orderpriority) > 8 THEN 'MaximumLength' END AS word_code,
           CASE WHEN length(o_orderpriority) <= 8 THEN o_orderpriority END AS word_value,
           CASE WHEN o_orderstatus = 'F' THEN 'InvalidType' END AS day_code,
           CASE WHEN o_orderstatus <> 'F' THEN CAST(o_orderdate AS DATE) END AS day_value
    FROM orders
    """
)
def normalise_cells(spark, folder):
    """Cell text to typed values, or the reason why not."""
    orders = table(spark, folder, "orders")
    text = orders.select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_custkey").cast("string")).alias("whole"),
        F.format_number("o_totalprice", 2).alias("money"),
        F.col("o_orderpriority").alias("word"),
        F.when(F.col("o_orderstatus") == "F", "tomorrow").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
    )
    cells = text.select("o_orderkey", *[normalise_cell(F.col(c.alias), c).alias(c.alias) for c in CELL_COLUMNS])
    return cells.select(
        "o_orderkey", *[F.col(f"{c.alias}.code").alias(f"{c.alias}_code") for c in CELL_COLUMNS],
        F.col("whole.value").cast("bigint").alias("whole_value"), F.col("money.value").cast("double").alias("money_value"),
        F.col("word.value").alias("word_value"), F.col("day.value").alias("day_value"),
    )
