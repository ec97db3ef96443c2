import io
import os
import random
import zipfile
from datetime import datetime
from decimal import Decimal

import duckdb
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import TabularError
from tablewright.functions.values import TypedColumn
from tablewright.sources.delimited import read_delimited, read_tab_delimited
from tablewright.sources.jdbc import database_kind, qualified_name, quote_identifier
from tablewright.sources.workbook import parse_range, read_workbooks
from tablewright.targets.commits import commit, latest
from tablewright.targets.delimited import render_path, write_delimited
from tablewright.targets.published import mutate_published, publish_state, read_published, sweep
from tablewright.targets.jdbc import mutation_statements
from tablewright.targets.mutations import (
    TargetColumn,
    mutate_table,
    bind_columns,
    check_mutation_keys,
    delete_keys,
    publish_table,
    target_columns,
    upsert,
)

JOB_FAILURES = (PySparkException, Py4JJavaError)
PEOPLE = [TypedColumn("Id", "int64", nullable=False), TypedColumn("Name")]


def put(folder, name, text):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    return str(folder)


def test_read_quoted_text_and_bom(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", '﻿ id ,NAME\r\n1,"a ""b"", c\nd"\r\n2,\r\n')
    assert sorted(map(tuple, read_delimited(spark, path, columns=PEOPLE).collect())) == [(1, 'a "b", c\nd'), (2, "")]
    assert read_delimited(spark, path).columns == ["id", "NAME"]


@pytest.mark.parametrize("body", ["Id,Name\n1\n", "Id,Name\n1,a,b\n", "Id,Name\nx,a\n", "Id,Name\n,a\n"])
def test_ragged_and_bad_rows_fail(spark, tmp_path, body):
    path = put(tmp_path / "in", "a.csv", body)
    with pytest.raises(JOB_FAILURES):
        read_delimited(spark, path, columns=PEOPLE).collect()


def test_ragged_row_fails_under_projection(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", "Id,Name\n1\n")
    with pytest.raises(JOB_FAILURES):
        read_delimited(spark, path, columns=PEOPLE).select("Id").collect()


def test_header_rules(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", "Id,Title\n1,a\n")
    with pytest.raises(TabularError, match="file.header.mismatch"):
        read_delimited(spark, path, columns=PEOPLE)
    with pytest.raises(TabularError, match="file.columns.required"):
        read_delimited(spark, path, has_header=False)
    with pytest.raises(TabularError, match="schema"):
        read_delimited(spark, put(tmp_path / "dup", "a.csv", "Id,id\n1,2\n"))
    with pytest.raises(TabularError, match="file.empty"):
        read_delimited(spark, put(tmp_path / "empty", "a.csv", ""))
    two = put(tmp_path / "two", "a.csv", "Id,Name\n1,a\n")
    put(tmp_path / "two", "b.csv", "Id,Other\n2,b\n")
    with pytest.raises((*JOB_FAILURES, TabularError)):
        read_delimited(spark, two, columns=PEOPLE).collect()


@pytest.mark.parametrize("block", [64, 300, 1 << 20])
def test_large_files_are_read_in_blocks(spark, tmp_path, block):
    """Blocks that begin inside quoted values, files of any order, blank lines and line ends."""
    want, folder = [], tmp_path / "in"
    for name, end in (("a.csv", "\n"), ("b.csv", "\r\n")):
        body = []
        if name == "b.csv":
            lf_only = list(want)
        for i in range(60):
            text = [f"plain{i}", f"two\nlines {i}", "", 'a ""quoted"" word', "x" * (i * 7), "many\r\n\nbreaks\n" * 9, "a, b"][i % 7]
            body.append(f'{i},"{text}"' if i % 2 or "\n" in text or "," in text or '"' in text else f"{i},{text}")
            want.append((i, text.replace('""', '"')))
            if i % 10 == 0:
                body.append("")
        put(folder, name, "\ufeffId,Name" + end + end.join(body) + (end if name == "a.csv" else ""))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        got = read_delimited(spark, str(folder), columns=PEOPLE)
        assert sorted(map(tuple, got.collect())) == sorted(want)
        assert sorted(r[0] for r in got.select("Id").collect()) == sorted(w[0] for w in want)
        for name, rows in (("a.csv", lf_only), ("b.csv", want[60:])):
            assert sorted(map(tuple, read_delimited(spark, str(folder / name), columns=PEOPLE).collect())) == sorted(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize("embedded", [True, False])
@pytest.mark.parametrize(
    "line", ['1,5"6" pipe', '1,5" pipe', '1,"a"b', '1,"a" ', '1, "a"', '"1"x,a', '1,a""', '1,"a""', '1,"a"""b"', '1,""a""', '1,"a\n"b', '1,"a\n,b"c,"', '1,"a\nb"" c', '1,x\n2,5" a\n3,6" b'],
)
def test_stray_quotes_fail(spark, tmp_path, line, embedded):
    path = put(tmp_path / "in", "a.csv", f"Id,Name\n0,z\n{line}\n9,y\n")
    with pytest.raises(JOB_FAILURES, match="file.quotes|file.line_break|MALFORMED"):
        read_delimited(spark, path, columns=PEOPLE, embedded_newlines=embedded).collect()


def test_quotes_against_a_character_automaton(spark, tmp_path):
    """Random texts over quotes, delimiters and line breaks: read as the automaton reads them, or refused with it."""

    def automaton(text):
        rows, row, cell, state = [], [], "", "start"
        for c in text + "\n":
            if state in ("start", "plain") and c == '"':
                if state == "plain":
                    return None
                state = "within"
            elif state == "within":
                state, cell = ("after", cell) if c == '"' else (state, cell + c)
            elif state == "after" and c == '"':
                state, cell = "within", cell + c
            elif c in ",\n":
                row, cell, state = [*row, cell], "", "start"
                if c == "\n":
                    rows, row = rows + ([row] if row != [""] else []), []
            elif state == "after":
                return None
            else:
                state, cell = "plain", cell + c
        return rows if state == "start" and all(len(r) == 2 for r in rows) else None

    rng, seen = random.Random(3), set()
    for n in range(40):
        cells = ['"a"', "b", '"c,"', '"d\ne"', '""', '"f""g"', "", '"\n"', '"""h"""'] + (['i"', 'j"k', '"l"m', '"'] if n % 4 == 0 else [])
        text = "\n".join(f"{rng.choice(cells)},{rng.choice(cells)}" for _ in range(rng.randint(1, 5)))
        want = automaton(text)
        path = put(tmp_path / str(n), "a.csv", "x,y\n" + text)
        try:
            got = sorted(map(list, read_delimited(spark, path, columns=[TypedColumn("x"), TypedColumn("y")]).collect()))
        except JOB_FAILURES:
            got = None
        assert got == (None if want is None else sorted(want)), text
        seen.add(want is None)
    assert seen == {True, False}


def test_flat_files_keep_their_rules(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", '\ufeffId,Name\r\n1,"a, ""b"""\r\n\r\n2,c\n3,\n')
    assert sorted(map(tuple, read_delimited(spark, path, columns=PEOPLE, embedded_newlines=False).collect())) == [(1, 'a, "b"'), (2, "c"), (3, "")]
    broken = put(tmp_path / "broken", "a.csv", 'Id,Name\n1,"a\nb"\n')
    with pytest.raises(JOB_FAILURES, match="file.line_break"):
        read_delimited(spark, broken, columns=PEOPLE, embedded_newlines=False).collect()
    assert read_delimited(spark, broken, columns=PEOPLE).first()["Name"] == "a\nb"


def test_lines_are_dealt_once_and_no_copy_stays(spark, tmp_path):
    from tablewright.session import shared_folder

    path = put(tmp_path / "in", "a.csv", 'Id,Name\n1,"a\nb"\n2,c\n')
    before = set(os.listdir(shared_folder(spark)))
    out = read_delimited(spark, path, columns=PEOPLE)
    assert out.count() == 2 and set(os.listdir(shared_folder(spark))) == before
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


@pytest.mark.parametrize("body", ["Id,Name\n1\n", "Id,Name\n1,a,b\n", "Id,Name\nx,a\n", 'Id,Name\n1,"a\n', "Id,Other\n1,a\n"])
def test_blocks_are_as_strict(spark, tmp_path, body):
    path = put(tmp_path / "in", "a.csv", body)
    with pytest.raises((*JOB_FAILURES, TabularError)):
        read_delimited(spark, path, columns=PEOPLE).collect()


def test_headerless_tabs(spark, tmp_path):
    path = put(tmp_path / "in", "a.tsv", "1\ta,b\n2\t\n")
    got = read_tab_delimited(spark, path, has_header=False, columns=PEOPLE).collect()
    assert sorted(map(tuple, got)) == [(1, "a,b"), (2, "")]


def test_write_modes(spark, tmp_path):
    path = str(tmp_path / "out")
    one = spark.createDataFrame([(1, "One")], "Id long, Name string")
    two = spark.createDataFrame([(2, "Two")], "id long, NAME string")

    def content():
        return sorted(map(tuple, read_delimited(spark, path, columns=PEOPLE).collect()))

    write_delimited(one, path)
    with pytest.raises(JOB_FAILURES):
        write_delimited(one, path)
    write_delimited(two, path, mode="append")
    assert content() == [(1, "One"), (2, "Two")]
    with pytest.raises(TabularError, match="file.header.mismatch"):
        write_delimited(one.withColumnRenamed("Name", "Other"), path, mode="append")
    # A failing replacement leaves the old content alone.
    with pytest.raises(JOB_FAILURES):
        write_delimited(two.withColumn("NAME", F.raise_error(F.lit("no")).cast("string")), path, mode="replace")
    assert content() == [(1, "One"), (2, "Two")]
    # The replaced content may itself come from the target.
    write_delimited(read_delimited(spark, path, columns=PEOPLE).where("Id = 2"), path, mode="replace")
    assert content() == [(2, "Two")]
    write_delimited(one, str(tmp_path / "fresh"), mode="append")


def test_append_checks_arity(spark, tmp_path):
    path = put(tmp_path / "in", "a.csv", "Id,Name\n1\n")
    with pytest.raises(JOB_FAILURES):
        write_delimited(spark.createDataFrame([(2, "b")], "Id long, Name string"), path, mode="append")


def test_single_null_column_survives(spark, tmp_path):
    path = str(tmp_path / "one")
    write_delimited(spark.createDataFrame([("a",), (None,)], "Name string"), path)
    assert sorted(r[0] for r in read_delimited(spark, path).collect()) == ["", "a"]


def test_paths():
    values = {"runId": "0f8fad5b-d9cb-469f-a165-70867728950e", "runStartedAtUtc": datetime(2024, 5, 6, 7, 8, 9, 123000), "n": 7, "region": "north", "price": Decimal("1.5")}
    assert render_path("out/{region}/{runStartedAtUtc}.csv", values) == "out/north/20240506_070809_123.csv"
    assert render_path("{RUNID}-{runId:D}", values) == "0f8fad5bd9cb469fa16570867728950e-0f8fad5b-d9cb-469f-a165-70867728950e"
    assert render_path("{n:000}-{runStartedAtUtc:yyyy-MM-dd}-{price:F2}", values) == "007-2024-05-06-1.50"
    for template, code in [
        ("{missing}", "path.variable"), ("{n", "path.template"), ("n}", "path.template"), ("{n:}", "path.placeholder"), ("{a b}", "path.placeholder"),
        ("", "path.template"), ("{bad}", "path.unsafe"), ("{none}", "path.null"), ("{region:X}", "path.format"),
    ]:
        with pytest.raises(TabularError, match=code):
            render_path(template, {**values, "bad": "a/b", "none": None})


# --- workbooks ----------------------------------------------------------------------------

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"


def workbook(path, rows_xml, strings=(), sheet="Data"):
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    package = "http://schemas.openxmlformats.org/package/2006/relationships"
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{rel}"><sheets><sheet name="Other" sheetId="1" r:id="rId1"/><sheet name="{sheet}" sheetId="2" r:id="rId2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{package}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
        book.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{rows_xml}</sheetData></worksheet>')
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r></si>" for s in strings) + "</sst>")
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs></styleSheet>')
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(buffer.getvalue())


ROWS = (
    '<row r="2"><c r="B2" t="s"><v>0</v></c><c r="C2" t="s"><v>1</v></c><c r="D2" t="inlineStr"><is><t>When</t></is></c><c r="E2" t="inlineStr"><is><t>Ok</t></is></c></row>'
    '<row r="3"><c r="B3"><v>1</v></c><c r="C3" t="s"><v>2</v></c><c r="D3" s="1"><v>45292.5</v></c><c r="E3" t="b"><v>1</v></c></row>'
    '<row r="5"><c r="B5"><v>2.0</v></c><c r="D5" s="2"><v>59</v></c></row>'
)
BOOK = [TypedColumn("Id", "int64"), TypedColumn("Name"), TypedColumn("When", "timestamp"), TypedColumn("Ok", "boolean")]


def test_workbook(spark, tmp_path):
    for name in ("a.xlsx", "b.xlsm"):
        workbook(str(tmp_path / "books" / name), ROWS, ["Id", "Name", "Seven"])
    put(tmp_path / "books", "notes.txt", "not a workbook")
    got = sorted(map(tuple, read_workbooks(spark, str(tmp_path / "books"), "DATA", columns=BOOK).collect()), key=repr)
    want = [(1, "Seven", datetime(2024, 1, 1, 12), True), (None, "", None, None), (2, "", datetime(1900, 2, 28), None)] * 2
    assert got == sorted(want, key=repr)
    text = read_workbooks(spark, str(tmp_path / "books"), "data")
    assert text.columns == ["Id", "Name", "When", "Ok"] and text.where("Id = '1'").first()["When"] == "01/01/2024 12:00:00"
    ranged = read_workbooks(spark, str(tmp_path / "books"), "Data", "C3:D3", has_header=False, columns=[TypedColumn("N"), TypedColumn("W")])
    assert {tuple(r) for r in ranged.collect()} == {("Seven", "01/01/2024 12:00:00")}


def test_workbook_errors(spark, tmp_path):
    path = str(tmp_path / "books")
    workbook(os.path.join(path, "a.xlsx"), ROWS, ["Id", "Name", "Seven"])
    for sheet, columns, code in [("Missing", None, "workbook.worksheet"), ("Other", None, "workbook.empty"), ("Data", BOOK[:3] + [TypedColumn("Bad")], "file.header.mismatch")]:
        with pytest.raises(JOB_FAILURES, match=code):
            read_workbooks(spark, path, sheet, columns=columns).collect()
    workbook(str(tmp_path / "wide" / "a.xlsx"), ROWS + '<row r="6"><c r="F6"><v>1</v></c></row>', ["Id", "Name", "Seven"])
    with pytest.raises(JOB_FAILURES, match="file.header.mismatch"):
        read_workbooks(spark, str(tmp_path / "wide"), "Data", columns=BOOK).collect()
    assert parse_range("$B$2:A10") == (2, 1, 10, 2)
    with pytest.raises(TabularError, match="workbook.range"):
        parse_range("B2")


# --- relational targets -------------------------------------------------------------------


def test_identifiers():
    assert quote_identifier("sqlserver", "a]b") == "[a]]b]" and quote_identifier("mysql", "a`b") == "`a``b`"
    assert qualified_name("postgresql", 'o"x', "s") == '"s"."o""x"'
    assert database_kind("jdbc:postgresql://h/db") == "postgresql"
    for name in ("", " ", "x" * 129, "a\n"):
        with pytest.raises(TabularError):
            quote_identifier("oracle", name)
    with pytest.raises(TabularError):
        database_kind("odbc:x")


@pytest.mark.parametrize("mode,expected", [
    ("insert", [(1, "a", 9), (2, "b", 9), (2, "B", None), (3, "C", None)]),
    ("upsert", [(1, "a", 9), (2, "B", 9), (3, "C", None)]),
    ("delete", [(1, "a", 9)]),
])
def test_mutation_statements(mode, expected):
    """The statements' meaning, on staged rows of which a retried task left one twice."""
    db = duckdb.connect()
    db.execute('CREATE TABLE "t" (id INT, name TEXT, extra INT); INSERT INTO "t" VALUES (1, \'a\', 9), (2, \'b\', 9)')
    db.execute("CREATE TABLE \"s\" (stage_row BIGINT, id INT, name TEXT); INSERT INTO \"s\" VALUES (0, 2, 'B'), (1, 3, 'C'), (1, 3, 'C')")
    columns = ["id"] if mode == "delete" else ["id", "name"]
    for statement in mutation_statements("postgresql", '"t"', '"s"', columns, ["id"], mode):
        db.execute(statement)
    assert sorted(db.execute('SELECT * FROM "t"').fetchall(), key=repr) == sorted(expected, key=repr)


def test_mutation_keys(spark):
    with pytest.raises(TabularError, match="target.key.repeated"):
        check_mutation_keys(spark.createDataFrame([(42,), (42,)], "key long"), ["Key"])
    with pytest.raises(TabularError, match="target.key.null"):
        check_mutation_keys(spark.createDataFrame([(None,)], "key long"), ["key"])


def test_upsert_and_delete(spark):
    target = spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "id long, name string, extra int")
    source = spark.createDataFrame([(2, None), (3, "C")], "ID long, name string")
    assert sorted(map(tuple, upsert(target, source, ["id"]).collect()), key=repr) == [(1, "a", 9), (2, None, 9), (3, "C", None)]
    assert [tuple(r) for r in delete_keys(target, source.select("id"), ["id"]).collect()] == [(1, "a", 9)]
    with pytest.raises(TabularError, match="target.values"):
        upsert(target, source.select("id"), ["id"])
    with pytest.raises(TabularError, match="column.not_found"):
        upsert(target, source.withColumn("other", F.lit(1)), ["id"])


def test_bindings(spark):
    target = [
        TargetColumn("Id", T.LongType(), nullable=False, key=True), TargetColumn("Name", T.StringType(), nullable=False),
        TargetColumn("Stamp", T.LongType(), generated=True), TargetColumn("Note", T.StringType(), nullable=False, has_default=True),
    ]
    source = spark.createDataFrame([(1, "a", 5)], "id int, name string, stamp long")
    assert bind_columns(source, target).columns == ["Id", "Name"]
    bound = bind_columns(source, target, {"Id": {"expression": "row.id + vars.n"}, "name": {"variable": "REGION"}, "Note": {"column": "NAME"}}, {"n": 5, "region": "x"})
    assert bound.schema["Id"].dataType == T.LongType() and tuple(bound.first()) == (6, "x", "a")
    for arguments, code in [
        (({"Nope": {"column": "id"}},), "target.column"), (({"Stamp": {"column": "stamp"}},), "target.generated"),
        (({"Id": {"column": "id"}, "id": {"column": "id"}},), "target.duplicate"), (({"Id": {"column": "id"}},), "target.required"),
        (({"Id": {"column": "id"}, "Name": {"variable": "q"}},), "target.variable"),
        (({"Name": {"column": "name"}}, None, "upsert", ["Id"]), "target.keys.missing"),
        (({"Id": {"column": "id"}}, None, "upsert", ["Id"]), "target.values"), ((None, None, "delete", ["Name"]), "target.keys"),
    ]:
        with pytest.raises(TabularError, match=code):
            bind_columns(source, target, *arguments)
    assert bind_columns(source, target, {"Id": {"column": "id"}}, mode="delete", keys=["id"]).columns == ["Id"]
    assert target_columns(source, ["id"])[0].key


def test_publish_is_a_pointer_switch(spark, tmp_path):
    first = spark.range(3)
    location = publish_table(spark, "pub_case", first, str(tmp_path / "root"))
    held = spark.read.parquet(location)
    with pytest.raises(JOB_FAILURES):
        publish_table(spark, "pub_case", spark.range(1).select(F.raise_error(F.lit("no")).cast("long").alias("id")), str(tmp_path / "root"))
    assert spark.table("pub_case").count() == 3
    publish_table(spark, "pub_case", spark.table("pub_case").where("id > 0"), str(tmp_path / "root"))
    assert spark.table("pub_case").count() == 2 and held.count() == 3
    spark.sql("DROP TABLE pub_case")


def test_mutate_published_table(spark, tmp_path):
    root = str(tmp_path / "root")
    publish_table(spark, "mut_case", spark.createDataFrame([(1, "a", 9), (2, "b", 9)], "id long, name string, extra int"), root)

    def content():
        return sorted(map(tuple, spark.table("mut_case").collect()), key=repr)

    edits = spark.createDataFrame([(2, "B"), (3, "C")], "ID long, NAME string")
    mutate_table(edits, "mut_case", root, "upsert", ["id"])
    assert content() == [(1, "a", 9), (2, "B", 9), (3, "C", None)]
    mutate_table(edits.where("ID = 2"), "mut_case", root, "delete", ["id"])
    mutate_table(edits.where("ID = 2"), "mut_case", root, bindings={"id": {"expression": "ID * vars.n"}}, variables={"n": 10})
    assert content() == [(1, "a", 9), (20, None, None), (3, "C", None)]
    with pytest.raises(TabularError, match="target.key.repeated"):
        mutate_table(edits.union(edits), "mut_case", root, "upsert", ["id"])
    with pytest.raises(JOB_FAILURES):
        mutate_table(edits.withColumn("NAME", F.raise_error(F.lit("no")).cast("string")), "mut_case", root)
    assert content() == [(1, "a", 9), (20, None, None), (3, "C", None)]
    spark.sql("DROP TABLE mut_case")


def test_published_files_that_are_not_touched_stay(spark, tmp_path):
    root = str(tmp_path / "root")
    first = publish_state(spark.range(0, 400, 1, 4).selectExpr("id", "'n' || id AS name", "id % 3 AS extra"), root)
    assert len(first.files) == 4
    old = read_published(spark, root)
    edits = spark.createDataFrame([(5, "five"), (7, "seven"), (1000, "new")], "ID long, NAME string")
    second = mutate_published(edits, root, "upsert", ["id"])
    assert len(set(first.files) & set(second.files)) == 3
    now = {r["id"]: tuple(r)[1:] for r in read_published(spark, root).collect()}
    assert len(now) == 401 and now[5] == ("five", 2) and now[1000] == ("new", None) and now[6] == ("n6", 0)
    assert old.where("id = 5").first()["name"] == "n5"  # a reader keeps its state
    third = mutate_published(edits.select("ID").where("ID = 350"), root, "delete", ["id"])
    assert third == second  # nothing to do
    third = mutate_published(spark.createDataFrame([(399,), (-1,)], "id long"), root, "delete", ["id"])
    assert len(set(second.files) & set(third.files)) == len(second.files) - 1 and read_published(spark, root).count() == 400
    fourth = mutate_published(spark.createDataFrame([(1, "twice")], "id long, name string"), root)
    assert set(third.files) < set(fourth.files) and read_published(spark, root).where("id = 1").count() == 2


def test_failed_and_lost_mutations_change_nothing(spark, tmp_path):
    root = str(tmp_path / "root")
    with pytest.raises(TabularError, match="target.state"):
        read_published(spark, root)
    publish_state(spark.range(3).selectExpr("id", "'a' AS name"), root)
    boom = spark.range(1).selectExpr("id", "raise_error('no') AS name")
    for mode, keys in (("insert", []), ("upsert", ["id"])):
        with pytest.raises(JOB_FAILURES):
            mutate_published(boom, root, mode, keys)
    with pytest.raises(TabularError, match="target.key.repeated"):
        mutate_published(spark.createDataFrame([(1, "x"), (1, "y")], "id long, name string"), root, "upsert", ["id"])
    base = latest(spark, root)
    commit(spark, root, base, list(base.files), base.notes)
    with pytest.raises(TabularError, match="target.concurrent"):
        commit(spark, root, base, [], base.notes)
    # A writer that died within its commit leaves one that nobody reads, and its number.
    (tmp_path / "root" / "_commits" / f"{3:012d}").write_text("{}\ndata/x")
    assert latest(spark, root).number == 2 and read_published(spark, root).count() == 3
    state = mutate_published(spark.range(5, 6).selectExpr("id", "'b' AS name"), root)
    assert state.number == 4 and read_published(spark, root).count() == 4
    assert sweep(spark, root) == 0
    publish_state(spark.createDataFrame([], "id long, name string"), root)
    assert read_published(spark, root).count() == 0 and sweep(spark, root) > 0 and read_published(spark, root).columns == ["id", "name"]


def test_the_source_of_a_mutation_is_computed_once(spark, tmp_path):
    root = str(tmp_path / "root")
    publish_state(spark.range(10).selectExpr("id", "'a' AS name"), root)
    seen = spark.sparkContext.accumulator(0)
    source = spark.createDataFrame(spark.sparkContext.parallelize([(1, "x"), (50, "y")], 1).map(lambda r: (seen.add(1), r)[1]), "id long, name string")
    mutate_published(source, root, "upsert", ["id"])
    assert seen.value == 2


def test_append_reads_none_of_the_listed_files(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "Id long, Name string").coalesce(1)
    write_delimited(rows(1), path)
    listed = latest(spark, path).files
    # A listed file that is no longer well formed is not read again by an append.
    (tmp_path / "out" / listed[0]).write_text("Id,Name\n1\n")
    write_delimited(rows(2), path, mode="append")
    assert len(latest(spark, path).files) == 2
    put(tmp_path / "out", "foreign.csv", "Id,Name\n3,c,d\n")
    with pytest.raises(JOB_FAILURES):
        write_delimited(rows(4), path, mode="append")
    put(tmp_path / "out", "foreign.csv", "Id,Name\n3,c\n")
    write_delimited(rows(4), path, mode="append")
    assert "foreign.csv" in latest(spark, path).files
    with pytest.raises(TabularError, match="file.header.mismatch"):
        write_delimited(rows(4).withColumnRenamed("Name", "Other"), path, mode="append")
    with pytest.raises(TabularError, match="file.header.mismatch"):
        write_delimited(rows(4), path, mode="append", delimiter=";")


def test_replace_never_leaves_a_reader_without_a_target(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = lambda *ids: spark.createDataFrame([(i, f"n{i}") for i in ids], "Id long, Name string").coalesce(1)
    write_delimited(rows(1, 2), path)
    # New files that are not committed yet are not read.
    rows(9).write.mode("append").option("header", "true").csv(path)
    assert sorted(r["Id"] for r in read_delimited(spark, path, columns=PEOPLE).collect()) == [1, 2]
    write_delimited(read_delimited(spark, path, columns=PEOPLE).where("Id = 2"), path, mode="replace")
    assert [r["Id"] for r in read_delimited(spark, path, columns=PEOPLE).collect()] == [2]
    assert set(latest(spark, path).files) == {f.name for f in (tmp_path / "out").glob("*.csv")}
    plain = put(tmp_path / "plain", "a.csv", "Id,Name\n1,a\n")
    write_delimited(rows(5), plain, mode="replace")
    assert [r["Id"] for r in read_delimited(spark, plain, columns=PEOPLE).collect()] == [5]
