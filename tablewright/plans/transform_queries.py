"""Registered queries over the relational operators, each with the SQL it must equal."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.functions.values import TypedColumn, parse_text, to_text
from tablewright.functions.variables import lookup_value, register_functions, run_variables
from tablewright.operators.aggregate import aggregate_rows
from tablewright.operators.distinct import distinct_rows
from tablewright.operators.filter import filter_rows
from tablewright.operators.join import join
from tablewright.operators.project import derive_columns, select_columns
from tablewright.operators.sort import number_rows, sort_rows, top_rows
from tablewright.operators.source_order import with_source_order, without_source_order
from tablewright.operators.union import union_rows
from tablewright.plans.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


@query(
    """
    SELECT o_orderpriority, count(*) AS line_count, sum(l_quantity) AS sum_quantity,
           round(avg(l_extendedprice), 6) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    WHERE l_shipdate >= TIMESTAMP '1996-01-01'
    GROUP BY o_orderpriority
    """
)
def order_priority_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Flagship: filter, join, group, aggregate, sort."""
    lines = filter_rows(
        table(spark, folder, "lineitem"),
        [{"column": "l_shipdate", "operator": "greaterThanOrEqual", "value": "1996-01-01"}],
    )
    joined = join(lines, table(spark, folder, "orders"), ["l_orderkey"], ["o_orderkey"])
    totals = aggregate_rows(
        joined,
        ["o_orderpriority"],
        [
            {"name": "line_count", "operation": "count"},
            {"name": "sum_quantity", "operation": "sum", "column": "l_quantity"},
            {"name": "avg_price", "operation": "average", "column": "l_extendedprice"},
            {"name": "first_ship", "operation": "minimum", "column": "l_shipdate"},
            {"name": "last_ship", "operation": "maximum", "column": "l_shipdate"},
        ],
    )
    return sort_rows(totals.withColumn("avg_price", F.round("avg_price", 6)), ["o_orderpriority"])


@query("SELECT c_name, c_custkey, c_mktsegment FROM customer")
def select_columns_customer(spark, folder):
    return select_columns(table(spark, folder, "customer"), ["C_NAME", "c_custkey", "c_mktsegment"])


# --- filters: lineitem with nulls made from the flag 'A' ---------------------------------

LINES = "(SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate, nullif(l_returnflag, 'A') AS flag FROM lineitem)"


def lines_with_nulls(spark, folder) -> DataFrame:
    lines = table(spark, folder, "lineitem")
    flag = F.nullif("l_returnflag", F.lit("A")).alias("flag")
    return lines.select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", flag)


FILTERS = {
    "equals": ("flag", "equals", "R", "flag IS NOT DISTINCT FROM 'R'"),
    "equals_null": ("flag", "equals", None, "flag IS NULL"),
    "not_equals": ("flag", "notEquals", "R", "flag IS DISTINCT FROM 'R'"),
    "greater_than": ("l_quantity", "greaterThan", 25, "l_quantity > 25"),
    "greater_than_or_equal": ("l_shipdate", "greaterThanOrEqual", "1998-01-01T00:00:00Z", "l_shipdate >= TIMESTAMP '1998-01-01'"),
    "less_than": ("l_quantity", "lessThan", 25, "l_quantity < 25"),
    "less_than_or_equal": ("l_linenumber", "lessThanOrEqual", 3, "l_linenumber <= 3"),
    "is_null": ("flag", "isNull", None, "flag IS NULL"),
    "is_not_null": ("flag", "isNotNull", None, "flag IS NOT NULL"),
}


def _filter_query(name, condition):
    def run(spark, folder):
        return filter_rows(lines_with_nulls(spark, folder), [condition])

    run.__name__ = name
    return run


for _name, (_column, _operator, _value, _where) in FILTERS.items():
    query(f"SELECT * FROM {LINES} WHERE {_where}")(
        _filter_query(f"filter_{_name}", {"column": _column, "operator": _operator, "value": _value})
    )


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE contains(o_orderpriority, 'HIGH')")
def filter_contains(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return filter_rows(orders, [{"column": "o_orderpriority", "operator": "contains", "value": "HIGH"}])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE starts_with(o_orderpriority, '1-')")
def filter_starts_with(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return filter_rows(orders, [{"column": "o_orderpriority", "operator": "startsWith", "value": "1-"}])


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE suffix(o_orderpriority, 'LOW')")
def filter_ends_with(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return filter_rows(orders, [{"column": "o_orderpriority", "operator": "endsWith", "value": "LOW"}])


@query(f"SELECT * FROM {LINES} WHERE flag IS DISTINCT FROM 'N' AND l_quantity >= 10 AND l_shipdate < TIMESTAMP '2000-01-01'")
def filter_conjunction(spark, folder):
    return filter_rows(
        lines_with_nulls(spark, folder),
        [
            {"column": "flag", "operator": "notEquals", "value": "N"},
            {"column": "l_quantity", "operator": "greaterThanOrEqual", "value": 10},
            {"column": "l_shipdate", "operator": "lessThan", "value": "2000-01-01"},
        ],
    )


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_tax = 0 OR l_tax < 0.03")
def filter_nan_is_smallest(spark, folder):
    """Untaxed lines get NaN, which counts as less than any number."""
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax")).alias("tax")
    )
    return filter_rows(lines, [{"column": "tax", "operator": "lessThan", "value": 0.03}]).drop("tax")


# --- joins --------------------------------------------------------------------------------

CUSTOMERS = "(SELECT c_custkey, nullif(c_nationkey, 0) AS nationkey FROM customer)"
ORDERS = "(SELECT o_orderkey, o_custkey AS c_custkey, o_orderstatus FROM orders)"


def customers(spark, folder) -> DataFrame:
    return table(spark, folder, "customer").select("c_custkey", F.nullif("c_nationkey", F.lit(0)).alias("nationkey"))


def all_orders(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus")


def _join_sql(kind: str) -> str:
    return f"""
    SELECT c.c_custkey, c.nationkey, o.o_orderkey, o.c_custkey AS "right.c_custkey", o.o_orderstatus
    FROM {CUSTOMERS} c {kind} JOIN {ORDERS} o ON c.c_custkey = o.c_custkey
    """


def _join_query(kind: str):
    def run(spark, folder):
        return join(customers(spark, folder), all_orders(spark, folder), ["c_custkey"], ["C_CUSTKEY"], kind)

    run.__name__ = f"join_{kind}"
    return run


for _kind in ("inner", "left", "right", "full"):
    query(_join_sql(_kind.upper()))(_join_query(_kind))


@query(_join_sql("LEFT").replace("c.c_custkey, c.nationkey, o.o_orderkey, o.c_custkey AS \"right.c_custkey\", o.o_orderstatus",
       "o.o_orderkey, o.c_custkey, o.o_orderstatus, c.c_custkey AS \"right.c_custkey\", c.nationkey")
       .replace(f"{CUSTOMERS} c LEFT JOIN {ORDERS} o", f"{ORDERS} o LEFT JOIN {CUSTOMERS} c"))
def join_left_unique_right(spark, folder):
    """The right side is known to be unique, so a single outer join does."""
    return join(all_orders(spark, folder), customers(spark, folder), ["c_custkey"], ["c_custkey"], "left", unique="right")


@query(
    f"""
    SELECT c.c_custkey, c.nationkey, n.n_nationkey, n.n_name
    FROM {CUSTOMERS} c FULL JOIN (SELECT nullif(n_nationkey, 1) AS n_nationkey, n_name FROM nation) n ON c.nationkey = n.n_nationkey
    """
)
def join_null_keys(spark, folder):
    """Null keys on both sides never match."""
    nations = table(spark, folder, "nation").select(F.nullif("n_nationkey", F.lit(1)).alias("n_nationkey"), "n_name")
    return join(customers(spark, folder), nations, ["nationkey"], ["n_nationkey"], "full")


@query(
    """
    SELECT o_orderkey, o_custkey, c_custkey, c_nationkey, n_nationkey, n_name
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """
)
def join_three_way(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_name")
    return join(join(orders, buyers, ["o_custkey"], ["c_custkey"]), nations, ["c_nationkey"], ["n_nationkey"])


@query(
    """
    SELECT l_orderkey, l_linenumber, o_orderkey, o_orderstatus, l_linestatus
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linestatus = o_orderstatus
    """
)
def join_two_keys(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderstatus")
    return join(lines, orders, ["l_orderkey", "l_linestatus"], ["o_orderkey", "o_orderstatus"])


# --- aggregates ---------------------------------------------------------------------------


@query(
    """
    SELECT l_returnflag, l_linestatus, count(*) AS row_count, CAST(sum(l_linenumber) AS BIGINT) AS sum_line,
           round(avg(l_linenumber), 6) AS avg_line, sum(l_quantity) AS sum_quantity,
           min(l_shipdate) AS first_ship, max(l_extendedprice) AS top_price
    FROM lineitem GROUP BY l_returnflag, l_linestatus
    """
)
def aggregate_grouped(spark, folder):
    result = aggregate_rows(
        table(spark, folder, "lineitem"),
        ["l_returnflag", "l_linestatus"],
        [
            {"name": "row_count", "operation": "count"},
            {"name": "sum_line", "operation": "sum", "column": "l_linenumber"},
            {"name": "avg_line", "operation": "average", "column": "l_linenumber"},
            {"name": "sum_quantity", "operation": "sum", "column": "l_quantity"},
            {"name": "first_ship", "operation": "minimum", "column": "l_shipdate"},
            {"name": "top_price", "operation": "maximum", "column": "l_extendedprice"},
        ],
    )
    return result.withColumn("avg_line", F.round(F.col("avg_line").cast("double"), 6))


@query(
    """
    SELECT count(*) AS row_count, count(nullif(o_orderstatus, 'P')) AS settled, CAST(sum(o_custkey) AS BIGINT) AS sum_key,
           round(avg(o_custkey), 6) AS avg_key, min(o_orderdate) AS first_order, max(o_orderpriority) AS last_priority
    FROM orders
    """
)
def aggregate_global(spark, folder):
    orders = table(spark, folder, "orders").withColumn("settled", F.nullif("o_orderstatus", F.lit("P")))
    result = aggregate_rows(
        orders,
        [],
        [
            {"name": "row_count", "operation": "count"},
            {"name": "settled", "operation": "countNonNull", "column": "settled"},
            {"name": "sum_key", "operation": "sum", "column": "o_custkey"},
            {"name": "avg_key", "operation": "average", "column": "o_custkey"},
            {"name": "first_order", "operation": "minimum", "column": "o_orderdate"},
            {"name": "last_priority", "operation": "maximum", "column": "o_orderpriority"},
        ],
    )
    return result.withColumn("avg_key", F.round(F.col("avg_key").cast("double"), 6))


@query(
    """
    SELECT count(*) AS row_count, count(o_orderstatus) AS present, CAST(sum(o_custkey) AS BIGINT) AS sum_key,
           max(o_orderdate) AS last_order
    FROM orders WHERE o_totalprice < 0
    """
)
def aggregate_empty(spark, folder):
    """A global aggregate of nothing is one row."""
    none = filter_rows(table(spark, folder, "orders"), [{"column": "o_totalprice", "operator": "lessThan", "value": 0}])
    return aggregate_rows(
        none,
        [],
        [
            {"name": "row_count", "operation": "count"},
            {"name": "present", "operation": "countNonNull", "column": "o_orderstatus"},
            {"name": "sum_key", "operation": "sum", "column": "o_custkey"},
            {"name": "last_order", "operation": "maximum", "column": "o_orderdate"},
        ],
    )


@query("SELECT nullif(l_returnflag, 'A') AS flag, count(*) AS row_count, count(nullif(l_returnflag, 'A')) AS present FROM lineitem GROUP BY 1")
def aggregate_null_group(spark, folder):
    return aggregate_rows(
        lines_with_nulls(spark, folder),
        ["flag"],
        [{"name": "row_count", "operation": "count"}, {"name": "present", "operation": "countNonNull", "column": "flag"}],
    )


@query(
    """
    SELECT o_orderpriority, min(o_orderkey) AS low_key, max(o_orderkey) AS high_key, min(o_totalprice) AS low_price,
           max(o_totalprice) AS high_price, min(o_orderdate) AS low_date, max(o_orderdate) AS high_date,
           min(o_orderstatus) AS low_status, max(o_orderstatus) AS high_status,
           bool_and(o_totalprice > 1000) AS low_flag, bool_or(o_totalprice > 1000) AS high_flag
    FROM orders GROUP BY o_orderpriority
    """
)
def aggregate_min_max_types(spark, folder):
    orders = table(spark, folder, "orders").withColumn("flag", F.col("o_totalprice") > 1000)
    columns = {"key": "o_orderkey", "price": "o_totalprice", "date": "o_orderdate", "status": "o_orderstatus", "flag": "flag"}
    wanted = [
        {"name": f"{label}_{short}", "operation": operation, "column": name}
        for short, name in columns.items()
        for label, operation in (("low", "minimum"), ("high", "maximum"))
    ]
    return aggregate_rows(orders, ["o_orderpriority"], wanted)


@query(
    """
    SELECT l_returnflag, bool_or(l_tax = 0) AS low_is_nan, max(l_tax) AS high_tax
    FROM lineitem GROUP BY l_returnflag
    """
)
def aggregate_nan_is_smallest(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn(
        "tax", F.when(F.col("l_tax") == 0, float("nan")).otherwise(F.col("l_tax"))
    )
    result = aggregate_rows(
        lines,
        ["l_returnflag"],
        [
            {"name": "low_tax", "operation": "minimum", "column": "tax"},
            {"name": "high_tax", "operation": "maximum", "column": "tax"},
        ],
    )
    return result.select("l_returnflag", F.isnan("low_tax").alias("low_is_nan"), "high_tax")


@query(
    """
    SELECT o_orderpriority, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS sum_price,
           round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 3) AS avg_price
    FROM orders GROUP BY o_orderpriority
    """
)
def aggregate_decimal(spark, folder):
    orders = table(spark, folder, "orders").withColumn("price", F.col("o_totalprice").cast("decimal(18,2)"))
    result = aggregate_rows(
        orders,
        ["o_orderpriority"],
        [
            {"name": "sum_price", "operation": "sum", "column": "price"},
            {"name": "avg_price", "operation": "average", "column": "price"},
        ],
    )
    return result.select(
        "o_orderpriority", F.col("sum_price").cast("double").alias("sum_price"),
        F.round(F.col("avg_price").cast("double"), 3).alias("avg_price"),
    )


# --- distinct, sort, union ----------------------------------------------------------------


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, nullif(l_quantity, 1) AS quantity FROM lineitem")
def distinct_all(spark, folder):
    lines = table(spark, folder, "lineitem")
    return distinct_rows(
        lines.select("l_returnflag", "l_linestatus", "l_linenumber", F.nullif("l_quantity", F.lit(1.0)).alias("quantity"))
    )


@query(
    """
    SELECT event_id, ts, user_id, event_type, value FROM (
        SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rn FROM events) WHERE rn = 1
    """
)
def distinct_by_key(spark, folder):
    events = table(spark, folder, "events").select("event_id", "ts", "user_id", "event_type", "value")
    return distinct_rows(events, ["user_id", "event_type"], ["event_id"])


@query(
    """
    SELECT l_returnflag, l_orderkey, l_linenumber, l_extendedprice FROM (
        SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rn
        FROM lineitem) WHERE rn = 1
    """
)
def distinct_hot_keys(spark, folder):
    """Three keys share all rows: each task keeps one row per key before the shuffle."""
    lines = table(spark, folder, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_extendedprice")
    order = [{"column": "l_extendedprice", "direction": "descending"}, "l_orderkey", "l_linenumber"]
    return distinct_rows(lines, ["l_returnflag"], order)


ORDERS_WITH_NULLS = "(SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice, o_orderdate FROM orders)"


def orders_with_nulls(spark, folder) -> DataFrame:
    orders = table(spark, folder, "orders")
    return orders.select("o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("status"), "o_totalprice", "o_orderdate")


@query(f"SELECT *, row_number() OVER (ORDER BY status DESC NULLS FIRST, o_orderkey) AS position FROM {ORDERS_WITH_NULLS}")
def sort_nulls_first(spark, folder):
    keys = [{"column": "status", "direction": "descending", "nulls": "first"}]
    return number_rows(sort_rows(orders_with_nulls(spark, folder), keys, ["o_orderkey"]), "position")


@query(f"SELECT *, row_number() OVER (ORDER BY status ASC NULLS LAST, o_orderkey) AS position FROM {ORDERS_WITH_NULLS}")
def sort_nulls_last(spark, folder):
    keys = [{"column": "status", "direction": "ascending", "nulls": "last"}]
    return number_rows(sort_rows(orders_with_nulls(spark, folder), keys, ["o_orderkey"]), "position")


@query(
    f"""
    SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, status ASC NULLS FIRST, o_totalprice, o_orderkey) AS position
    FROM {ORDERS_WITH_NULLS}
    """
)
def sort_multi_key(spark, folder):
    keys = [{"column": "o_orderdate", "direction": "descending", "nulls": "last"}, "status", "o_totalprice"]
    return number_rows(sort_rows(orders_with_nulls(spark, folder), keys, ["o_orderkey"]), "position")


@query(
    """
    SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY o_orderpriority DESC, input, place) AS position FROM (
        SELECT o_orderkey, o_orderpriority, 0 AS input, row_number() OVER () AS place FROM orders
        UNION ALL SELECT -o_orderkey, o_orderpriority, 1, row_number() OVER () FROM orders WHERE o_orderstatus = 'F')
    """
)
def sort_stable_union(spark, folder):
    """Orders alike in the sort key keep the order of the file, the second input's after the first's."""
    orders = with_source_order(table(spark, folder, "orders"))
    again = filter_rows(orders, [{"column": "o_orderstatus", "operator": "equals", "value": "F"}])
    both = union_rows([select_columns(orders, ["o_orderkey", "o_orderpriority"]), select_columns(again.withColumn("o_orderkey", -F.col("o_orderkey")), ["o_orderkey", "o_orderpriority"])])
    ordered = sort_rows(both, [{"column": "o_orderpriority", "direction": "descending"}])
    return number_rows(without_source_order(ordered), "position")


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER () AS place FROM orders) ORDER BY o_custkey, place")
def distinct_first_in_file(spark, folder):
    """Of each customer's orders the one that the file holds first."""
    orders = select_columns(with_source_order(table(spark, folder, "orders")), ["o_custkey", "o_orderkey", "o_orderstatus"])
    return without_source_order(distinct_rows(orders, ["o_custkey"]))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_top_rows(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    return top_rows(orders, [{"column": "o_totalprice", "direction": "descending"}], 25, ["o_orderkey"])


@query(
    """
    SELECT c_custkey AS key, c_name AS name, c_nationkey AS nation FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_nationkey FROM supplier
    """
)
def union_name_all(spark, folder):
    buyers = table(spark, folder, "customer").selectExpr("c_custkey AS key", "c_name AS name", "c_nationkey AS nation")
    sellers = table(spark, folder, "supplier").selectExpr("s_nationkey AS NATION", "s_suppkey AS Key", "s_name AS Name")
    return union_rows([buyers, sellers], "name", "all")


@query("SELECT c_nationkey AS nation, c_mktsegment AS word FROM customer UNION SELECT s_nationkey, 'SUPPLIER' FROM supplier")
def union_position_distinct(spark, folder):
    buyers = table(spark, folder, "customer").selectExpr("c_nationkey AS nation", "c_mktsegment AS word")
    sellers = table(spark, folder, "supplier").select("s_nationkey", F.lit("SUPPLIER").alias("label"))
    return union_rows([buyers, sellers], "position", "distinct")


# --- derived columns, variables, functions ------------------------------------------------


@query(
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, CAST(trunc(l_quantity / 7) AS BIGINT) AS sevenths,
           l_quantity * 2 AS doubled, lower(l_returnflag) || '-' || l_linenumber AS label, l_quantity > 30 AS large
    FROM lineitem
    """
)
def derive_columns_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    return derive_columns(
        lines,
        [
            {"name": "sevenths", "expression": "l_quantity / 7", "type": "int64"},
            {"name": "doubled", "expression": "row.l_quantity * 2", "type": "double", "nullable": False},
            {"name": "label", "expression": "concat(lower(l_returnflag), '-', l_linenumber)", "type": "string"},
            {"name": "large", "expression": "l_quantity > 30", "type": "boolean"},
        ],
    )


@query(
    """
    SELECT o_orderkey, o_custkey, o_custkey + 5 AS adjusted, o_orderdate < TIMESTAMP '1998-05-06' AS before_today,
           'north' AS region, '0f8fad5b-d9cb-469f-a165-70867728950e' AS run
    FROM orders
    """
)
def derive_variables(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    variables = run_variables(
        "{0F8FAD5B-D9CB-469F-A165-70867728950E}",
        datetime(1998, 5, 6, 7, 8, 9),
        {"increment": ("int64", "5"), "region": ("string", "north")},
    )
    derived = derive_columns(
        orders,
        [
            {"name": "adjusted", "expression": "row.o_custkey + vars.increment", "type": "int64"},
            {"name": "before_today", "expression": "o_orderdate < vars.utcToday", "type": "boolean"},
            {"name": "region", "expression": "vars.region"},
            {"name": "run", "expression": "vars.runId", "type": "guid"},
        ],
        variables,
    )
    return derived.drop("o_orderdate")


@query("SELECT c_custkey, c_name, upper(trim(c_name)) || '-north' AS label FROM customer")
def derive_function(spark, folder):
    buyers = table(spark, folder, "customer").select("c_custkey", "c_name")
    register_functions(
        spark, {"tag_name": ({"name": "STRING", "region": "STRING"}, "STRING", "concat(upper(trim(name)), '-', region)")}
    )
    variables = {"region": "north"}
    return derive_columns(buyers, [{"name": "label", "expression": "tag_name(c_name, vars.region)"}], variables)


@query(
    """
    SELECT c_custkey, c_nationkey FROM customer
    WHERE c_nationkey = (SELECT n_nationkey FROM nation WHERE n_name = (SELECT max(n_name) FROM nation))
    """
)
def lookup_value_nation(spark, folder):
    """One value looked up on the driver, frozen, and used as a filter constant."""
    nations = table(spark, folder, "nation")
    name = aggregate_rows(nations, [], [{"name": "n", "operation": "maximum", "column": "n_name"}]).first()["n"]
    key = lookup_value(nations, "n_nationkey", "n_name", name, "int64")
    buyers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    return filter_rows(buyers, [{"column": "c_nationkey", "operator": "equals", "value": key}])


# --- text forms ---------------------------------------------------------------------------


@query(
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS key_text, regexp_replace(CAST(o_totalprice AS VARCHAR), '\\.0$', '') AS price_text,
           strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.%f') || '0+00:00' AS date_text,
           CASE WHEN o_totalprice > 1000 THEN 'True' ELSE 'False' END AS flag_text,
           coalesce(nullif(o_orderstatus, 'P'), '') AS status_text, base64(encode(o_orderpriority)) AS binary_text
    FROM orders
    """
)
def to_text_types(spark, folder):
    orders = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("date"),
        (F.col("o_totalprice") > 1000).alias("flag"), F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.encode("o_orderpriority", "UTF-8").alias("binary"),
    )
    return orders.select(*[to_text(orders[f.name], f.dataType).alias(f"{f.name}_text") for f in orders.schema.fields])


@query(
    """
    SELECT o_orderkey AS key, o_totalprice AS price, CAST(o_totalprice AS DOUBLE) AS amount, o_orderdate AS date,
           o_totalprice > 1000 AS flag, o_orderpriority AS word, CAST(NULL AS BIGINT) AS nothing
    FROM orders
    """
)
def parse_text_types(spark, folder):
    """Orders rendered to text and read back with strict types."""
    orders = table(spark, folder, "orders")
    double = orders.schema["o_totalprice"].dataType
    text = orders.select(
        to_text(F.col("o_orderkey"), orders.schema["o_orderkey"].dataType).alias("key"),
        to_text(F.col("o_totalprice"), double).alias("price"),
        F.format_number("o_totalprice", 2).alias("amount"),
        to_text(F.col("o_orderdate"), orders.schema["o_orderdate"].dataType).alias("date"),
        F.when(F.col("o_totalprice") > 1000, " TRUE ").otherwise("false").alias("flag"),
        F.col("o_orderpriority").alias("word"),
        F.lit("").alias("nothing"),
    )
    kinds = [
        TypedColumn("key", "int64", False), TypedColumn("price", "double"), TypedColumn("amount", "decimal"),
        TypedColumn("date", "timestamp"), TypedColumn("flag", "boolean"), TypedColumn("word"), TypedColumn("nothing", "int64"),
    ]
    parsed = text.select(*[parse_text(F.col(c.name), c.type, c.nullable, c.name).alias(c.name) for c in kinds])
    return parsed.withColumn("amount", F.col("amount").cast("double")).withColumn("date", F.col("date").cast("timestamp_ntz"))
