import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tablewright.errors import TabularError
from tablewright.governed.changes import (
    apply_changes,
    diff_snapshots,
    find_conflicts,
    split_changes,
    stage_changes,
    typed_changes,
    validate_changes,
)
from tablewright.governed.contract import ContractColumn, ForeignKey, TableContract, pinned, project, table_fingerprint
from tablewright.governed.query import (
    count_rows,
    decode_cursor,
    encode_cursor,
    keyset_page,
    read_page,
    stable_sorts,
    where_contract,
)
from tablewright.governed.references import fk_lookup, fk_tuples, missing_fk, missing_references, resolve_labels
from tablewright.schema import schema_fingerprint

ROWS = TableContract(
    (
        ContractColumn("Id", "id", "int32", nullable=False, key=0),
        ContractColumn("Name", "name", "string", writable=True, max_length=100),
        ContractColumn("IsActive", "isActive", "boolean"),
        ContractColumn("Amount", "amount", "decimal", precision=12, scale=2),
        ContractColumn("CreatedAt", "createdAt", "datetimeoffset"),
        ContractColumn("Secret", "secret", "string", readable=False),
        ContractColumn("Fixed", "fixed", "string", filterable=False, sortable=False),
    )
)


@pytest.fixture(scope="module")
def governed(spark):
    data = [
        (1, "Alpha", True, "10.50", datetime(2024, 1, 1), "s", "f"), (2, "Beta", False, None, datetime(2024, 1, 2), "s", "f"),
        (3, "Gamma%", True, "7.25", datetime(2024, 1, 3), "s", "f"), (4, "Delta", True, "10.50", datetime(2024, 1, 4), "s", "f"),
    ]
    df = spark.createDataFrame(data, "Id int, Name string, IsActive boolean, a string, CreatedAt timestamp, Secret string, Fixed string")
    return project(df.withColumn("Amount", F.col("a").cast("decimal(12,2)")), ROWS)


@pytest.mark.parametrize(
    "filters,ids",
    [
        ([("amount", "ne", "10.50")], [3]), ([("AMOUNT", "eq", "10.5")], [1, 4]), ([("amount", "isnull", None)], [2]),
        ([("amount", "isnotnull", None), ("isActive", "eq", "true")], [1, 3, 4]), ([("name", "contains", "%")], [3]),
        ([("name", "startswith", "Del")], [4]), ([("createdAt", "gt", "2024-01-02T01:00:00+01:00")], [3, 4]),
        ([("id", "le", "2"), ("id", "ge", "2")], [2]), ([("name", "lt", "Beta")], [1]),
    ],
)
def test_contract_filters(governed, filters, ids):
    assert sorted(r["id"] for r in where_contract(governed, ROWS, filters).collect()) == ids
    assert count_rows(governed, ROWS, filters).first()["row_count"] == len(ids)


@pytest.mark.parametrize(
    "test", [("secret", "eq", "s"), ("fixed", "eq", "f"), ("missing", "eq", "1"), ("id", "eq", "x"), ("id", "eq", None), ("id", "isnull", "1"), ("id", "contains", "1"), ("id", "like", "1"), ("isActive", "eq", "yes")]
)
def test_contract_filter_errors(governed, test):
    with pytest.raises(TabularError):
        where_contract(governed, ROWS, [test])


def test_projection_hides_columns(governed):
    assert governed.columns == ["id", "name", "isActive", "amount", "createdAt", "fixed"]


def test_sort_errors(governed):
    for sorts in ([("fixed", False)], [("secret", False)], [("name", False), ("NAME", True)]):
        with pytest.raises(TabularError):
            stable_sorts(ROWS, sorts)


PAGED = TableContract(
    (
        ContractColumn("k1", "k1", "int64", nullable=False, key=0), ContractColumn("k2", "k2", "string", nullable=False, key=1),
        ContractColumn("a", "a", "int64"), ContractColumn("b", "b", "string"),
    )
)


@pytest.mark.parametrize("sorts", [[], [("a", False)], [("a", True), ("b", False)], [("b", True), ("k2", True), ("a", False)]])
def test_paging_visits_every_row_once_in_order(spark, sorts):
    rng = random.Random(3)
    data = [(i % 7, f"k{i}", rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y"])) for i in range(60)]
    df = spark.createDataFrame(data, "k1 long, k2 string, a long, b string").coalesce(1)
    mark, cursor, seen = schema_fingerprint(df), None, []
    while True:
        page = read_page(df, PAGED, mark, [("k1", "lt", "6")], sorts, cursor, take=17)
        seen += [tuple(r) for r in page.rows]
        cursor = page.next_cursor
        if cursor is None:
            break
    terms = [("k1k2ab".index(a) and 0, a, d) for a, d in sorts] + [(0, k, False) for k in ("k1", "k2") if k not in dict(sorts)]
    names = ["k1", "k2", "a", "b"]
    want = [r for r in data if r[0] < 6]
    for _, alias, descending in reversed(terms):
        i = names.index(alias)
        want.sort(key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=descending)
    assert seen == want


def test_cursor_is_bound_to_its_query(governed):
    mark, filters, sorts = schema_fingerprint(governed), [("id", "gt", "0")], [("amount", True)]
    page = read_page(governed, ROWS, mark, filters, sorts, take=2)
    terms = stable_sorts(ROWS, sorts)
    assert [r["id"] for r in page.rows] == [1, 4]
    assert decode_cursor(page.next_cursor, mark, filters, terms) == ["10.50", "4"]
    assert [r["id"] for r in read_page(governed, ROWS, mark, filters, sorts, page.next_cursor, 2).rows] == [3, 2]
    bad = [
        (page.next_cursor, "other", filters, terms), (page.next_cursor, mark, [], terms), ("", mark, filters, terms), ("!!", mark, filters, terms),
        (page.next_cursor, mark, filters, stable_sorts(ROWS, [])), (page.next_cursor, mark, filters, stable_sorts(ROWS, [("amount", False)])),
        (encode_cursor(mark, filters, terms, {"amount": "x", "id": 1}), mark, filters, terms),
        (encode_cursor(mark, filters, terms, {"amount": None, "id": None}), mark, filters, terms),
    ]
    for arguments in bad:
        with pytest.raises(TabularError, match="query.cursor"):
            decode_cursor(*arguments)
    with pytest.raises(TabularError, match="query.take"):
        keyset_page(governed, ROWS, take=0)


def test_oversize_cells(spark):
    contract = TableContract((ContractColumn("id", "id", "int64", key=0), ContractColumn("t", "t", "string"), ContractColumn("b", "b", "binary")), max_cell_bytes=4)
    df = spark.createDataFrame([(1, "éé", b"1234"), (2, "ééé", None), (3, None, b"12345")], "id long, t string, b binary")
    assert [tuple(r) for r in project(df, contract, guard_cells=True).orderBy("id").collect()] == [
        (False, 1, "éé", bytearray(b"1234")), (True, 2, None, None), (True, 3, None, None),
    ]


# --- references ---------------------------------------------------------------------------


def key(ordinal=0, column="DeptId"):
    return ForeignKey("dept", "Departments", column, "Display", ("Display", "Code"), ordinal)


def test_lookup_and_labels(spark):
    departments = spark.createDataFrame([(1, "Sales", "S1"), (2, None, "S%"), (3, "Ops", "O1"), (4, "Sales", "S4")], "DeptId int, Display string, Code string")
    local = [ContractColumn("DepartmentId", "departmentId", "int32", foreign_key=key())]
    first = fk_lookup(departments, local, "Display", ("Display", "Code"), "S", take=2).collect()
    assert [tuple(r) for r in first] == [(None, 2), ("Sales", 1), ("Sales", 4)]
    rest = fk_lookup(departments, local, "Display", ("Display", "Code"), "S", after=["Sales", 1], take=2).collect()
    assert [tuple(r) for r in rest] == [("Sales", 4)]
    requests = spark.createDataFrame([(1, 4), (2, 9), (3, None)], "row int, departmentId int")
    assert [tuple(r) for r in resolve_labels(requests, ["departmentId"], departments, ["DeptId"], "Display").collect()] == [(1, 4, "Sales")]


# --- staged edits -------------------------------------------------------------------------

EDIT = TableContract(
    (
        ContractColumn("id", "id", "int32", nullable=False, key=0), ContractColumn("name", "name", "string", nullable=False, writable=True, max_length=5),
        ContractColumn("r1", "region", "int32", writable=True, foreign_key=ForeignKey("place", "Places", "r", "n", ("n",), 0)),
        ContractColumn("r2", "site", "int32", writable=True, foreign_key=ForeignKey("place", "Places", "s", "n", ("n",), 1)),
        ContractColumn("stamp", "stamp", "datetime"),
    )
)


def change(op, key=None, before=None, after=None):
    return (op, *[None if part is None else part if isinstance(part, str) else json.dumps(part) for part in (key, before, after)])


GOOD = [
    change("update", {"ID": 1}, {"id": 1, "name": "a"}, {"Name": "b"}),
    change("delete", {"id": 2}, {"id": 2, "name": "a", "region": None, "site": None}),
    change("insert", None, None, {"id": 3, "name": "c", "region": 1, "site": 2}),
    change("update", {"id": 4}, {"id": 4, "region": 1, "site": 1}, {"region": None, "site": None}),
]


@pytest.mark.parametrize("row", GOOD)
def test_valid_changes(spark, row):
    df = spark.createDataFrame([row], "op string, key_json string, before_json string, after_json string")
    assert validate_changes(df, EDIT).first()["problems"] == []


@pytest.mark.parametrize(
    "row,problem",
    [
        (change("merge", {"id": 1}, {"id": 1}, {"name": "b"}), "change_operation_invalid"),
        (change("update", None, {"id": 1, "name": "a"}, {"name": "b"}), "change_key_required"),
        (change("update", "[1]", {"id": 1, "name": "a"}, {"name": "b"}), "change_key_invalid"),
        (change("update", {"id": 1, "name": "a"}, {"id": 1, "name": "a"}, {"name": "b"}), "change_key_invalid"),
        (change("update", {"id": "1"}, {"id": 1, "name": "a"}, {"name": "b"}), "change_value_invalid"),
        (change("update", {"id": 1.0}, {"id": 1, "name": "a"}, {"name": "b"}), "change_value_invalid"),
        (change("update", {"id": 2147483648}, {"id": 1, "name": "a"}, {"name": "b"}), "change_value_invalid"),
        (change("update", {"id": 1}, None, {"name": "b"}), "change_before_required"),
        (change("update", {"id": 1}, {"name": "a"}, {"name": "b"}), "change_before_invalid"),
        (change("update", {"id": 1}, {"id": 1}, {"name": "b"}), "change_original_values_missing"),
        (change("delete", {"id": 1}, {"id": 1, "name": "a"}), "change_concurrency_values_missing"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, {}), "change_after_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, "{bad"), "change_after_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, None), "change_after_required"),
        (change("update", {"id": 1}, {"id": 1}, {"id": 2}), "change_after_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, {"name": None}), "change_value_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, {"name": "toolong"}), "change_value_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, {"name": 5}), "change_value_invalid"),
        (change("update", {"id": 1}, {"id": 1, "name": "a"}, '{"name":"a","NAME":"b"}'), "change_after_duplicate"),
        (change("update", {"id": 1}, {"id": 1, "other": 1, "name": "a"}, {"name": "b"}), "change_alias_invalid"),
        (change("insert", None, None, {"id": 1}), "change_required_values_missing"),
        (change("insert", None, None, {"id": 1, "name": "a", "stamp": "2024-01-01"}), "change_after_invalid"),
        (change("update", {"id": 1}, {"id": 1, "region": 1}, {"region": 2}), "foreign_key_partial_update"),
        (change("update", {"id": 1}, {"id": 1, "region": 1, "site": 1}, {"region": 2, "site": None}), "foreign_key_partial_null"),
        (change("update", '{"id":1,' + " " * 20_000 + '"id2":1}', {"id": 1, "name": "a"}, {"name": "b"}), "change_key_too_large"),
    ],
)
def test_invalid_changes(spark, row, problem):
    df = spark.createDataFrame([row], "op string, key_json string, before_json string, after_json string")
    assert problem in validate_changes(df, EDIT).first()["problems"]


def test_read_only_and_policy(spark):
    df = spark.createDataFrame([GOOD[0]], "op string, key_json string, before_json string, after_json string")
    with pytest.raises(TabularError, match="read_only"):
        validate_changes(df, TableContract(EDIT.columns, concurrency="read_only"))
    broken = tuple(c if c.alias != "site" else ContractColumn("r2", "site", "int32", foreign_key=c.foreign_key) for c in EDIT.columns)
    with pytest.raises(TabularError, match="contract.foreign_key"):
        TableContract(broken).foreign_keys()


def test_split_and_typed(spark):
    df = spark.createDataFrame(GOOD + [change("insert", None, None, {"id": 1})], "op string, key_json string, before_json string, after_json string")
    valid, problems = split_changes(df, EDIT)
    assert problems.count() == 1
    got = {r["op"] + str((r["key"] or r["after"])["id"]): r for r in valid.collect()}
    assert got["update1"]["after"]["name"] == "b" and got["update1"]["changed"] == ["name"] and got["update1"]["before_names"] == ["id", "name"]
    assert got["insert3"]["key"] is None and got["insert3"]["changed"] == ["id", "name", "region", "site"]
    assert sorted(map(tuple, fk_tuples(valid, EDIT, "place").collect())) == [(1, 2)]
    places = spark.createDataFrame([(1, 1)], "r int, s int")
    assert [tuple(r) for r in missing_fk(valid, EDIT, "place", places).collect()] == [(1, 2)]


def stored(spark, rows):
    return spark.createDataFrame(rows, "id int, name string, r1 int, r2 int, stamp timestamp_ntz")


def test_diff_drags_whole_foreign_keys(spark):
    old = project(stored(spark, [(1, "a", 1, 1, None), (2, "b", 1, 1, None), (3, "c", None, 1, None), (5, "e", 1, 1, None)]), EDIT)
    new = project(stored(spark, [(1, "a", 2, 1, None), (3, "c", None, 1, datetime(2024, 1, 1)), (4, "d", 1, 1, None), (5, "e2", 1, 1, None)]), EDIT)
    got = {(r["op"], (r["key"] or r["after"])["id"]): r for r in diff_snapshots(old, new, EDIT).collect()}
    # Row 3 changed only in a column nobody may edit.
    assert set(got) == {("update", 1), ("delete", 2), ("insert", 4), ("update", 5)}
    assert got["update", 1]["changed"] == ["region", "site"] and got["update", 1]["after"]["site"] == 1
    assert got["update", 5]["changed"] == ["name"] and got["delete", 2]["before"]["name"] == "b"


def test_apply_is_all_or_nothing(spark):
    table = stored(spark, [(1, "a", None, None, None), (2, "a", None, None, None), (4, "x", 1, 1, datetime(2024, 1, 1))])
    frame = lambda rows: spark.createDataFrame(rows, "op string, key_json string, before_json string, after_json string")
    good = typed_changes(frame(GOOD), EDIT)
    outcome = apply_changes(table, good, EDIT)
    assert outcome.status == "Applied"
    assert sorted(map(tuple, outcome.state.collect())) == [(1, "b", None, None, None), (3, "c", 1, 2, None), (4, "x", None, None, datetime(2024, 1, 1))]
    cases = {
        "row_changed": table.withColumn("name", F.when(F.col("id") == 1, "z").otherwise(F.col("name"))),
        "row_missing": table.where("id <> 2"),
        "key_exists": table.union(stored(spark, [(3, "q", None, None, None)])),
        "row_ambiguous": table.union(table.where("id = 1")),
    }
    for reason, now in cases.items():
        outcome = apply_changes(now, good, EDIT)
        assert outcome.status == "Conflict" and [r["reason"] for r in outcome.conflicts.collect()] == [reason]
        assert outcome.state is now
    twice = typed_changes(frame([GOOD[0], GOOD[0]]), EDIT)
    assert [r["reason"] for r in find_conflicts(table, twice, EDIT).collect()] == ["key_repeated"]


def test_row_version_ignores_other_columns(spark):
    contract = TableContract(
        (ContractColumn("id", "id", "int32", key=0, nullable=False), ContractColumn("name", "name", "string", writable=True), ContractColumn("v", "version", "binary", token=True)), "row_version",
    )
    table = spark.createDataFrame([(7, "now different", b"\x01\x02")], "id int, name string, v binary")
    old = spark.createDataFrame([(7, "before", b"\x01\x02")], "id int, name string, version binary")
    changes = diff_snapshots(old, old.withColumn("name", F.lit("after")), contract)
    assert [tuple(r) for r in apply_changes(table, changes, contract).state.collect()] == [(7, "after", bytearray(b"\x01\x02"))]
    assert apply_changes(table.withColumn("v", F.lit(b"\x09")), changes, contract).status == "Conflict"


# --- several changes to one key -----------------------------------------------------------

STEPS = "ordinal long, op string, key_json string, before_json string, after_json string"


def run_in_order(rows, steps):
    """The steps one after another on a plain table, as a database would run them; None when one fails."""
    table = {r[0]: {"id": r[0], "name": r[1], "region": r[2], "site": r[3]} for r in rows}
    for _, op, key, before, after in sorted(steps, key=lambda s: s[0]):
        if op == "insert":
            if after["id"] in table:
                return None
            table[after["id"]] = {"name": None, "region": None, "site": None} | after
            continue
        row = table.get(key["id"])
        if row is None or any(row[a] != v for a, v in before.items()):
            return None
        if op == "delete":
            del table[key["id"]]
        else:
            row.update(after)
    return sorted(((r["id"], r["name"], r["region"], r["site"]) for r in table.values()), key=str)


def random_steps(rng, rows, wrong):
    """Edits that mostly fit what the edits before them left."""
    now = {r[0]: {"id": r[0], "name": r[1], "region": r[2], "site": r[3]} for r in rows}
    steps = []
    for n in range(rng.randint(1, 14)):
        k = rng.randint(1, 5)
        row = now.get(k)
        pair = rng.choice([{}, {"region": rng.choice([1, 2]), "site": 1}, {"region": None, "site": None}])
        if (row is None) != (rng.random() < wrong):
            after = {"id": k, "name": rng.choice("abc")} | pair
            steps.append([n, "insert", None, None, after])
            now[k] = {"region": None, "site": None} | after
            continue
        row = row or {"id": k, "name": "a", "region": None, "site": None}
        before = dict(row)
        if rng.random() < wrong:
            before["name"] = "zz"
        if rng.random() < 0.3:
            steps.append([n, "delete", {"id": k}, before, None])
            now.pop(k, None)
        else:
            after = pair or {"name": rng.choice("abc")}
            asked = {a: before[a] for a in before if a in after or a == "id" or rng.random() < 0.5}
            steps.append([n, "update", {"id": k}, asked, after])
            now[k] = row | after
    for i, n in enumerate(sorted(rng.sample(range(100_000), len(steps)))):  # far apart, so several rounds of blocks
        steps[i][0] = n
    rng.shuffle(steps)
    return steps


@pytest.mark.parametrize("bits", [10, 1])
def test_ordered_changes_equal_steps_in_order(spark, monkeypatch, bits):
    from tablewright.governed import ordered

    monkeypatch.setattr(ordered, "BLOCK_BITS", bits)
    rng, seen = random.Random(bits), set()
    for turn in range(14 if bits == 10 else 5):
        rows = [(k, "a", *rng.choice([(None, None), (1, 1)]), None) for k in rng.sample(range(1, 6), rng.randint(0, 5))]
        steps = random_steps(rng, rows, 0.06 if turn % 2 else 0)
        frame = spark.createDataFrame([(s[0], *change(*s[1:])) for s in steps], STEPS).repartition(2)
        target = stored(spark, rows)
        outcome = apply_changes(target, typed_changes(frame, EDIT), EDIT, ordered=True)
        want = run_in_order(rows, steps)
        assert (outcome.status == "Applied") == (want is not None), (rows, steps, [tuple(r) for r in outcome.conflicts.collect()])
        if want is None:
            assert outcome.state is target
        else:
            assert sorted((tuple(r)[:4] for r in outcome.state.collect()), key=str) == want
        seen.add(outcome.status)
    assert seen == {"Applied", "Conflict"}


def test_order_must_be_given_and_clear(spark):
    twice = [(1, *change("update", {"id": 1}, {"id": 1, "name": "a"}, {"name": "b"})), (1, *change("update", {"id": 1}, {"id": 1, "name": "b"}, {"name": "c"}))]
    target = stored(spark, [(1, "a", None, None, None)])
    changes = typed_changes(spark.createDataFrame(twice, STEPS), EDIT)
    assert [r["reason"] for r in apply_changes(target, changes, EDIT, ordered=True).conflicts.collect()] == ["order_repeated"]
    with pytest.raises(TabularError, match="changes.order"):
        apply_changes(target, changes.drop("ordinal"), EDIT, ordered=True)
    with pytest.raises(Exception, match="changes.order"):
        apply_changes(target, changes.withColumn("ordinal", F.lit(None).cast("long")), EDIT, ordered=True)
    assert apply_changes(target, changes.limit(0), EDIT, ordered=True).state.count() == 1


def test_a_row_version_covers_one_write(spark):
    contract = TableContract(
        (ContractColumn("id", "id", "int32", key=0, nullable=False), ContractColumn("name", "name", "string", writable=True), ContractColumn("v", "version", "int32", token=True)), "row_version",
    )
    target = spark.createDataFrame([(1, "a", 5)], "id int, name string, v int")
    rows = [(n, "update", (1,), (1, "a", 5), ["id", "version"], (1, f"b{n}"), ["name"]) for n in range(2)]
    shape = "ordinal long, op string, key struct<id:int>, before struct<id:int,name:string,version:int>, before_names array<string>, after struct<id:int,name:string>, changed array<string>"
    edits = spark.createDataFrame(rows, shape)
    assert apply_changes(target, edits.where("ordinal = 0"), contract, ordered=True).status == "Applied"
    outcome = apply_changes(target, edits, contract, ordered=True)
    assert [r["reason"] for r in outcome.conflicts.collect()] == ["row_changed"]


# --- references in the edit path ----------------------------------------------------------


def test_staging_refuses_a_set_with_a_missing_tuple(spark):
    frame = lambda rows: spark.createDataFrame(rows, "op string, key_json string, before_json string, after_json string")
    places = spark.createDataFrame([(1, 2), (3, None)], "r int, s int")
    staged = stage_changes(frame(GOOD), EDIT, {"PLACES": places})
    assert staged.status == "Pending" and staged.changes.count() == 4
    staged = stage_changes(frame([*GOOD, change("insert", None, None, {"id": 9, "name": "x", "region": 9, "site": 9})]), EDIT, {"Places": places})
    assert staged.status == "Rejected" and staged.changes is None
    assert [(r["foreign_key"], r["tuple"]) for r in staged.missing.collect()] == [("place", {"region": "9", "site": "9"})]
    staged = stage_changes(frame([*GOOD, change("insert", None, None, {"id": 9})]), EDIT, {"Places": places})
    assert staged.status == "Rejected" and staged.missing is None and staged.problems.count() == 1
    with pytest.raises(TabularError, match="changes.references"):
        stage_changes(frame(GOOD), EDIT, {})


def test_two_references_in_one_pass(spark):
    contract = TableContract(
        (
            ContractColumn("id", "id", "int32", nullable=False, key=0),
            ContractColumn("a", "a", "int32", writable=True, foreign_key=ForeignKey("one", "t", "k", "n", ("n",), 0)),
            ContractColumn("b", "b", "string", writable=True, foreign_key=ForeignKey("two", "u", "x", "n", ("n",), 0)),
            ContractColumn("c", "c", "int32", writable=True, foreign_key=ForeignKey("two", "u", "y", "n", ("n",), 1)),
        )
    )
    rows = [(i, i % 3, "xy"[i % 2], i % 4) for i in range(24)]
    now = spark.createDataFrame(rows, "id int, a int, b string, c int")
    old = now.where("false")
    t = spark.createDataFrame([(0,), (1,)], "k int")
    u = spark.createDataFrame([("x", 0), ("x", 2), ("y", 1)], "x string, y int")
    changes = diff_snapshots(old, now, contract)
    got = {(r["foreign_key"], tuple(sorted(r["tuple"].items()))) for r in missing_references(changes, contract, {"t": t, "u": u}).collect()}
    assert got == {("one", (("a", "2"),)), ("two", (("b", "y"), ("c", "3")))}
    with pytest.raises(TabularError, match="lookup.type"):
        missing_references(changes, contract, {"t": spark.createDataFrame([("0",)], "k string"), "u": u})
    outcome = apply_changes(old, changes, contract, references={"t": t, "u": u})
    assert outcome.status == "Conflict" and outcome.state is old
    whole = {"t": spark.createDataFrame([(0,), (1,), (2,)], "k int"), "u": u.union(spark.createDataFrame([("y", 3)], u.schema))}
    assert apply_changes(old, changes, contract, references=whole).state.count() == 24


def test_a_pinned_contract_refuses_another_schema(spark):
    target = stored(spark, [(1, "a", None, None, None)])
    contract = pinned(EDIT, target)
    assert project(target, contract).count() == 1
    frame = spark.createDataFrame([GOOD[0]], "op string, key_json string, before_json string, after_json string")
    changes = typed_changes(frame, EDIT)
    assert apply_changes(target, changes, contract).status == "Applied"
    places = spark.createDataFrame([], "r int, s int")
    for changed in (target.withColumn("r1", F.col("r1").cast("long")), target.drop("stamp"), target.select("name", "id", "r1", "r2", "stamp"), target.withColumn("more", F.lit(1))):
        for refused in (lambda: project(changed, contract), lambda: apply_changes(changed, changes, contract), lambda: stage_changes(frame, contract, {"Places": places}, changed)):  # noqa: B023
            with pytest.raises(TabularError, match="contract.schema_changed"):
                refused()
    assert table_fingerprint(target, EDIT) != table_fingerprint(target, TableContract(EDIT.columns[:2]))
