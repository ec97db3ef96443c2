"""Registered queries over sources and targets."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import functions as F

from tablewright.functions.values import TypedColumn, normalise_types
from tablewright.operators.project import select_columns
from tablewright.plans.tables import table
from tablewright.plans.transform_queries import query as _query
from tablewright.plans import transform_queries
from tablewright.session import scratch_path
from tablewright.sources.delimited import read_delimited, read_tab_delimited
from tablewright.sources.workbook import workbook_rows
from tablewright.targets.delimited import render_path, write_delimited
from tablewright.targets.published import mutate_published, publish_state, read_published
from tablewright.targets.mutations import (
    bind_columns,
    delete_keys,
    insert_rows,
    mutate_table,
    publish_table,
    target_columns,
    upsert,
)

query = _query
QUERIES, ORACLES = transform_queries.QUERIES, transform_queries.ORACLES

ORDER_COLUMNS = [
    TypedColumn("o_orderkey", "int64", False), TypedColumn("o_custkey", "int64"), TypedColumn("o_orderstatus"),
    TypedColumn("o_totalprice", "double"), TypedColumn("o_orderdate", "timestamp"), TypedColumn("o_orderpriority"),
]


def _plain_date(df):
    return df.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz"))


@query("SELECT * FROM orders")
def csv_roundtrip(spark, folder):
    path = scratch_path(spark, "orders-csv")
    write_delimited(table(spark, folder, "orders"), path)
    return _plain_date(read_delimited(spark, path, columns=ORDER_COLUMNS))


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_roundtrip_text(spark, folder):
    """Whole texts with quotes, delimiters and line breaks; the schema comes from the header."""
    path = scratch_path(spark, "documents-csv")
    write_delimited(table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    return read_delimited(spark, path)


@query("SELECT doc_id, text, lang FROM documents")
def csv_blocks_text(spark, folder):
    """The same texts read block by block, as files too large for one task are."""
    path = scratch_path(spark, "documents-csv")
    write_delimited(table(spark, folder, "documents").select("doc_id", "text", "lang"), path)
    columns = [TypedColumn("doc_id", "int64", False), TypedColumn("text"), TypedColumn("lang")]
    return read_delimited(spark, path, columns=columns)


@query("SELECT * FROM orders")
def tsv_roundtrip(spark, folder):
    path = scratch_path(spark, "orders-tsv")
    write_delimited(table(spark, folder, "orders"), path, header=False, delimiter="\t")
    return _plain_date(
        read_tab_delimited(spark, path, has_header=False, columns=ORDER_COLUMNS, embedded_newlines=False)
    )


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT n_nationkey + 100, n_name, n_regionkey FROM nation")
def csv_append(spark, folder):
    nations = table(spark, folder, "nation")
    path = render_path(scratch_path(spark, "nation-") + "{batch}", {"batch": "append"})
    write_delimited(nations, path)
    write_delimited(nations.withColumn("n_nationkey", F.col("n_nationkey") + 100), path, mode="append")
    columns = [TypedColumn("n_nationkey", "int64"), TypedColumn("n_name"), TypedColumn("n_regionkey", "int64")]
    return read_delimited(spark, path, columns=columns).select(
        F.col("n_nationkey").cast("int"), "n_name", F.col("n_regionkey").cast("int")
    )


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal >= 0")
def csv_replace(spark, folder):
    buyers = select_columns(table(spark, folder, "customer"), ["c_custkey", "c_name", "c_acctbal"])
    path = scratch_path(spark, "customer-csv")
    write_delimited(buyers, path)
    write_delimited(buyers.where("c_acctbal >= 0"), path, mode="replace")
    columns = [TypedColumn("c_custkey", "int64"), TypedColumn("c_name"), TypedColumn("c_acctbal", "double")]
    return read_delimited(spark, path, columns=columns)


@query(
    """
    SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem
    """
)
def normalise_types_lineitem(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate")
    return normalise_types(lines).withColumn("l_shipdate", F.col("l_shipdate").cast("timestamp_ntz"))


# --- workbooks ----------------------------------------------------------------------------

WORKBOOK_ROWS = 50_000


def _sheet_xml(rows: pd.DataFrame) -> str:
    def cell(value) -> str:
        if isinstance(value, str):
            return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(value)}</t></is></c>'
        return f"<c><v>{value!r}</v></c>"

    lines = [list(rows.columns), *rows.astype(object).values.tolist()]
    body = "".join(f'<row r="{i}">{"".join(cell(v) for v in line)}</row>' for i, line in enumerate(lines, 1))
    return f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{body}</sheetData></worksheet>'


def _workbook(rows: pd.DataFrame, sheet: str) -> bytes:
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr(
            "xl/workbook.xml",
            f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="{sheet}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        )
        book.writestr(
            "xl/_rels/workbook.xml.rels",
            f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        )
        book.writestr("xl/worksheets/sheet1.xml", _sheet_xml(rows))
    return buffer.getvalue()


def _as_workbooks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for start in range(0, len(batch), WORKBOOK_ROWS):
            yield pd.DataFrame({"content": [_workbook(batch.iloc[start : start + WORKBOOK_ROWS], "Orders")]})


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def workbook_roundtrip(spark, folder):
    """Orders packed into workbooks by tasks, then read back with strict types."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    books = orders.mapInPandas(_as_workbooks, "content binary")
    return workbook_rows(books, "ORDERS", columns=ORDER_COLUMNS[:4])


# --- mutations ----------------------------------------------------------------------------

EDITS = """
    (SELECT c_custkey + 100 AS c_custkey, c_acctbal + 1 AS c_acctbal, 'EDITED' AS c_mktsegment
     FROM customer WHERE c_nationkey IN (1, 2, 3))
"""


def _edits(spark, folder):
    buyers = table(spark, folder, "customer").where("c_nationkey IN (1, 2, 3)")
    return buyers.selectExpr("c_custkey + 100 AS c_custkey", "c_acctbal + 1 AS c_acctbal", "'EDITED' AS c_mktsegment")


@query(
    f"""
    SELECT coalesce(t.c_custkey, s.c_custkey) AS c_custkey, t.c_name, t.c_nationkey,
           CASE WHEN s.c_custkey IS NOT NULL THEN s.c_acctbal ELSE t.c_acctbal END AS c_acctbal,
           CASE WHEN s.c_custkey IS NOT NULL THEN s.c_mktsegment ELSE t.c_mktsegment END AS c_mktsegment
    FROM customer t FULL JOIN {EDITS} s ON t.c_custkey = s.c_custkey
    """
)
def upsert_by_key(spark, folder):
    """Unmapped columns keep their value; new rows have them null."""
    return upsert(table(spark, folder, "customer"), _edits(spark, folder), ["c_custkey"])


@query(f"SELECT * FROM customer t WHERE NOT EXISTS (SELECT 1 FROM {EDITS} s WHERE s.c_custkey = t.c_custkey)")
def delete_by_key(spark, folder):
    return delete_keys(table(spark, folder, "customer"), _edits(spark, folder).select("c_custkey"), ["c_custkey"])


@query(
    """
    SELECT * FROM customer
    UNION ALL SELECT s_suppkey + 1000000, s_name || '!', s_nationkey, CAST(0 AS DOUBLE), 'SUPPLIER' FROM supplier
    """
)
def insert_bound_columns(spark, folder):
    """Columns, a variable and expressions bound to the target's columns, then appended."""
    target = table(spark, folder, "customer")
    bound = bind_columns(
        table(spark, folder, "supplier"),
        target_columns(target, ["c_custkey"]),
        {
            "c_custkey": {"expression": "s_suppkey + 1000000"},
            "c_name": {"expression": "concat(row.s_name, '!')"},
            "c_nationkey": {"column": "S_NATIONKEY"},
            "c_acctbal": {"expression": "0"},
            "c_mktsegment": {"variable": "segment"},
        },
        {"segment": "SUPPLIER"},
    )
    return insert_rows(target, bound)


@query("SELECT n_nationkey, n_name, n_regionkey + 1 AS n_regionkey FROM nation")
def publish_table_state(spark, folder):
    """A table's second state, written beside the first and then pointed at."""
    nations, root = table(spark, folder, "nation"), scratch_path(spark, "nation-table")
    name = "published_" + root.rsplit("-", 1)[-1]
    publish_table(spark, name, nations, root)
    publish_table(spark, name, spark.table(name).withColumn("n_regionkey", F.col("n_regionkey") + 1), root)
    return spark.table(name)


@query(
    f"""
    SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {EDITS}) AND c_nationkey <> 5
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM {EDITS}
    WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)
    UNION ALL SELECT s_suppkey + 1000000, 'SUPPLIER', NULL FROM supplier
    """
)
def mutate_published_table(spark, folder):
    """One published table after an upsert, a delete and an insert; each rewrites the files it touches only."""
    buyers, root = table(spark, folder, "customer"), scratch_path(spark, "customer-table")
    publish_state(buyers.select("c_custkey", "c_mktsegment", "c_acctbal"), root)
    mutate_published(_edits(spark, folder), root, "upsert", ["c_custkey"])
    mutate_published(buyers.where("c_nationkey = 5"), root, "delete", ["c_custkey"], {"c_custkey": {"column": "c_custkey"}})
    suppliers = table(spark, folder, "supplier")
    bindings = {"c_custkey": {"expression": "s_suppkey + 1000000"}, "c_mktsegment": {"variable": "segment"}}
    mutate_published(suppliers, root, "insert", [], bindings, {"segment": "SUPPLIER"})
    return read_published(spark, root)


@query(
    f"""
    SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {EDITS}) AND c_nationkey <> 5
    UNION ALL SELECT c_custkey, c_mktsegment, c_acctbal FROM {EDITS}
    WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 5)
    """
)
def mutate_catalog_table(spark, folder):
    """The same edits of a table that the catalog points at, which are whole new states."""
    buyers, root = table(spark, folder, "customer"), scratch_path(spark, "customer-table")
    name = "published_" + root.rsplit("-", 1)[-1]
    publish_table(spark, name, buyers.select("c_custkey", "c_mktsegment", "c_acctbal"), root)
    mutate_table(_edits(spark, folder), name, root, "upsert", ["c_custkey"])
    mutate_table(buyers.where("c_nationkey = 5"), name, root, "delete", ["c_custkey"], {"c_custkey": {"column": "c_custkey"}})
    return spark.table(name)


@query(
    """
    SELECT doc_id, text, lang FROM documents
    """
)
def csv_mixed_line_ends(spark, folder):
    """Whole texts in files whose records end with LF or CRLF in turn; line breaks inside quotes stay."""
    documents = table(spark, folder, "documents").where("text IS NOT NULL")
    cells = F.concat(F.col("doc_id").cast("string"), F.lit(',"'), F.replace("text", F.lit('"'), F.lit('""')), F.lit('",'), F.coalesce("lang", F.lit("")))
    lines = documents.select(F.concat(cells, F.when(F.col("doc_id") % 2 == 0, "\r").otherwise("")).alias("value"))
    path = scratch_path(spark, "mixed-csv")
    lines.write.text(path)
    columns = [TypedColumn("doc_id", "int64", False), TypedColumn("text"), TypedColumn("lang")]
    return read_delimited(spark, path, has_header=False, columns=columns)
