"""Inline-row cases for the relational operators."""

import math
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import LimitExceeded, TabularError
from tablewright.functions.variables import lookup_value, register_functions, run_variables
from tablewright.operators.aggregate import aggregate_rows
from tablewright.operators.distinct import distinct_rows
from tablewright.operators.filter import filter_rows
from tablewright.operators.join import join, join_output_names
from tablewright.operators.project import derive_columns, select_columns
from tablewright.operators.sort import number_rows, sort_rows
from tablewright.operators.union import union_rows

NAN = float("nan")


def rows(df):
    return [tuple(r) for r in df.collect()]


def bag(df):
    return sorted(rows(df), key=repr)


def test_select_keeps_order_and_spelling(spark):
    df = spark.createDataFrame([(7, "Seven")], "Id long, Name string")
    out = select_columns(df, ["name", "ID"])
    assert out.columns == ["Name", "Id"] and rows(out) == [("Seven", 7)]
    with pytest.raises(TabularError, match="schema.duplicate"):
        select_columns(df, ["Id", "id"])
    with pytest.raises(TabularError, match="column.not_found"):
        select_columns(df, ["Missing"])


def test_filter_conjunction(spark):
    df = spark.createDataFrame([(1, "Alpha"), (2, "Beta"), (3, "Alpine")], "Id long, Name string")
    out = filter_rows(
        df,
        [{"column": "id", "operator": "greaterThan", "value": 1}, {"column": "Name", "operator": "startsWith", "value": "Al"}],
    )
    assert rows(out) == [(3, "Alpine")]


def test_filter_null_safe_equality(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, "b")], "id long, v string")

    def ids(operator, value):
        return [r[0] for r in sorted(rows(filter_rows(df, [{"column": "v", "operator": operator, "value": value}])))]

    assert ids("equals", None) == [1] and ids("notEquals", "a") == [1, 3] and ids("notEquals", None) == [2, 3]
    assert ids("greaterThan", None) == [] and ids("lessThan", "b") == [2] and ids("contains", None) == []


@pytest.mark.parametrize(
    "operator,value,expected",
    [
        ("lessThan", 1.0, [1, 2]), ("lessThanOrEqual", 1.0, [1, 2, 3]), ("greaterThan", 0.5, [3, 4]),
        ("greaterThan", NAN, [2, 3, 4]), ("greaterThanOrEqual", NAN, [1, 2, 3, 4]), ("lessThan", NAN, []),
        ("lessThanOrEqual", NAN, [1]), ("equals", NAN, [1]),
    ],
)
def test_nan_is_the_smallest_double(spark, operator, value, expected):
    df = spark.createDataFrame([(1, NAN), (2, 0.5), (3, 1.0), (4, math.inf), (5, None)], "id long, v double")
    out = filter_rows(df, [{"column": "v", "operator": operator, "value": value}])
    assert sorted(r[0] for r in rows(out)) == expected


def test_filter_errors(spark):
    df = spark.createDataFrame([(1,)], "id long")
    for condition, code in [
        ({"column": "id", "operator": "contains", "value": "1"}, "value.format|filter.type"),
        ({"column": "id", "operator": "like", "value": 1}, "filter.operator"),
        ({"column": "id", "operator": "equals", "value": "x"}, "value.format"),
    ]:
        with pytest.raises(TabularError, match=code):
            filter_rows(df, [condition])


def test_join_left_names_and_nulls(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "Id long, Name string")
    right = spark.createDataFrame([(1, "A")], "Id long, Code string")
    for unique in (None, "right"):
        out = join(left, right, ["Id"], ["id"], "left", unique)
        assert out.columns == ["Id", "Name", "right.Id", "Code"]
        assert bag(out) == [(1, "a", 1, "A"), (2, "b", None, None)]


def test_join_name_limit():
    long = "x" * 128
    cut = f"right.{long}"[:128]
    assert join_output_names([long, cut], [long]) == [f"right.{long}"[:126] + "_2"]
    assert join_output_names(["id", "right.Id"], ["ID"]) == ["right.ID_2"]


@pytest.mark.parametrize("unique", [None, "left", "right", "both"])
@pytest.mark.parametrize("how", ["inner", "left", "right", "full"])
def test_join_kinds_against_brute_force(spark, how, unique):
    left_rows = [(1, "l1"), (2, "l2"), (None, "ln"), (4, "l4")]
    right_rows = [(1, "r1"), (3, "r3"), (None, "rn")]
    if unique in (None, "left"):
        right_rows += [(1, "r1b")] * 3
    if unique in (None, "right"):
        left_rows += [(1, "l1b")]
    left = spark.createDataFrame(left_rows, "Id long, L string")
    right = spark.createDataFrame(right_rows, "Id long, R string")
    want = [(*l, *r) for l in left_rows for r in right_rows if l[0] is not None and l[0] == r[0]]
    if how in ("left", "full"):
        want += [(*l, None, None) for l in left_rows if l[0] is None or all(l[0] != r[0] for r in right_rows)]
    if how in ("right", "full"):
        want += [(None, None, *r) for r in right_rows if r[0] is None or all(l[0] != r[0] for l in left_rows)]
    assert bag(join(left, right, ["Id"], ["Id"], how, unique)) == sorted(want, key=repr)


def test_join_structural_equality(spark):
    schema = "d decimal(10,2), t timestamp, z double, v string"
    left = spark.createDataFrame([(Decimal("1.0"), datetime(2024, 1, 1), 0.0, "x"), (Decimal("2"), None, NAN, "y")], schema)
    right = spark.createDataFrame([(Decimal("1.00"), datetime(2024, 1, 1), -0.0, "p"), (Decimal("9"), None, NAN, "q")], schema)
    assert len(rows(join(left, right, ["d", "t", "z"], ["d", "t", "z"], "inner"))) == 1
    assert len(rows(join(left, right, ["z"], ["z"], "inner"))) == 2


def test_join_empty_sides_and_errors(spark):
    empty = spark.createDataFrame([], "Id long")
    two = spark.createDataFrame([(1,), (2,)], "Id long")
    assert len(rows(join(empty, two, ["Id"], ["Id"], "right"))) == 2
    assert rows(join(two, empty, ["Id"], ["Id"], "right")) == []
    with pytest.raises(TabularError, match="join.type_mismatch"):
        join(two, spark.createDataFrame([("1",)], "Id string"), ["Id"], ["Id"])


def test_union_by_name_and_distinct(spark):
    a = spark.createDataFrame([(1, "One")], "Id long, Name string")
    b = spark.createDataFrame([("Two", 2)], "name string, ID long")
    out = union_rows([a, b])
    assert out.columns == ["Id", "Name"] and bag(out) == [(1, "One"), (2, "Two")]
    c = spark.createDataFrame([(1, None), (2, "a:b|c")], "Id long, Value string")
    d = spark.createDataFrame([(1, None), (3, "a:b|c")], "Id long, Value string")
    assert sorted(r[0] for r in rows(union_rows([c, d], "position", "distinct"))) == [1, 2, 3]


@pytest.mark.parametrize("schema", ["Id long", "Id long, Other string", "Id string, Name string"])
def test_union_mismatch(spark, schema):
    a = spark.createDataFrame([], "Id long, Name string")
    with pytest.raises(TabularError, match="union.incompatible"):
        union_rows([a, spark.createDataFrame([], schema)])


def test_derive(spark):
    df = spark.createDataFrame([(7,)], "Amount long")
    column = {"name": "Adjusted", "expression": "row.Amount + vars.increment", "type": "int64", "nullable": False}
    out = derive_columns(df, [column], {"increment": 5})
    assert rows(out) == [(7, 12)]
    with pytest.raises(TabularError, match="derive.collision"):
        derive_columns(df, [{"name": "amount", "expression": "1", "type": "int64"}])
    null = derive_columns(df, [{"name": "N", "expression": "nullif(Amount, 7)", "type": "int64", "nullable": False}])
    with pytest.raises(PySparkException, match="value.null"):
        null.collect()
    with pytest.raises(PySparkException):
        # Siblings are not visible.
        derive_columns(df, [{"name": "A", "expression": "1"}, {"name": "B", "expression": "A"}]).collect()


def test_derive_coercion(spark):
    df = spark.createDataFrame([(7.9, "1.5e2", "AAEC")], "d double, s string, b string")
    out = derive_columns(
        df,
        [
            {"name": "i", "expression": "-d", "type": "int64"},
            {"name": "m", "expression": "s", "type": "decimal", "scale": 2},
            {"name": "raw", "expression": "b", "type": "binary"},
            {"name": "t", "expression": "'2024-01-02T03:04:05+02:00'", "type": "timestamp"},
            {"name": "n", "expression": "null", "type": "guid"},
            {"name": "five", "expression": "d - 2.9D"}, {"name": "yes", "expression": "cast(d > 1 AS string)"},
        ],
    )
    assert rows(out)[0][3:] == (-7, Decimal("150.00"), bytearray(b"\x00\x01\x02"), datetime(2024, 1, 2, 1, 4, 5), None, "5", "true")
    with pytest.raises(PySparkException):
        derive_columns(df, [{"name": "i", "expression": "d * 1e300", "type": "int64"}]).collect()
    with pytest.raises(TabularError, match="derive.type"):
        derive_columns(df, [{"name": "x", "expression": "d", "type": "boolean"}])


def test_expression_function(spark):
    register_functions(spark, {"label_of": ({"name": "STRING", "region": "STRING"}, "STRING", "concat(upper(trim(name)), '-', region)")})
    df = spark.createDataFrame([(" Alice ",)], "Name string")
    out = derive_columns(df, [{"name": "Label", "expression": "label_of(Name, vars.region)"}], {"region": "north"})
    assert rows(out) == [(" Alice ", "ALICE-north")]
    with pytest.raises(TabularError, match="function.name"):
        register_functions(spark, {"row": ({}, "INT", "1")})


def test_variables(spark):
    values = run_variables("0f8fad5bd9cb469fa16570867728950e", datetime(2024, 5, 6, 7, 8, 9), {"n": ("int64", " 5 ")})
    assert values["runId"] == "0f8fad5b-d9cb-469f-a165-70867728950e" and values["n"] == 5
    assert values["utcToday"].hour == 0
    with pytest.raises(TabularError, match="variable.name"):
        run_variables("0f8fad5bd9cb469fa16570867728950e", datetime(2024, 5, 6), {"RUNID": ("int64", "5")})
    with pytest.raises(TabularError, match="variable.value"):
        run_variables("0f8fad5bd9cb469fa16570867728950e", datetime(2024, 5, 6), {"n": ("int64", "5.5")})


def test_lookup_value(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "k long, v string")
    assert lookup_value(df, "v", "k", 1) == "a"
    with pytest.raises(TabularError, match="lookup.none"):
        lookup_value(df, "v", "k", 9)
    with pytest.raises(TabularError, match="lookup.many"):
        lookup_value(df, "v", "k", 2)


SIX = [
    {"name": "Rows", "operation": "count"}, {"name": "Present", "operation": "countNonNull", "column": "Amount"},
    {"name": "Total", "operation": "sum", "column": "Amount"}, {"name": "Mean", "operation": "average", "column": "Amount"},
    {"name": "Lowest", "operation": "minimum", "column": "Amount"}, {"name": "Highest", "operation": "maximum", "column": "Amount"},
]


def test_aggregate(spark):
    df = spark.createDataFrame([("A", 2), ("A", 4), ("A", None), ("B", 9)], "Category string, Amount long")
    out = aggregate_rows(df, ["Category"], SIX)
    assert isinstance(out.schema["Mean"].dataType, T.DecimalType)
    assert bag(out)[0] == ("A", 3, 2, 6, Decimal("3"), 2, 4)
    with pytest.raises(LimitExceeded):
        aggregate_rows(df, ["Category"], SIX, max_groups=1)
    with pytest.raises(TabularError, match="aggregate.type"):
        aggregate_rows(df, [], [{"name": "T", "operation": "sum", "column": "Category"}])


def test_aggregate_empty(spark):
    df = spark.createDataFrame([], "Category string, Amount decimal(10,2)")
    assert rows(aggregate_rows(df, ["Category"], SIX)) == []
    assert rows(aggregate_rows(df, [], SIX)) == [(0, 0, None, None, None, None)]


def test_aggregate_structural_groups(spark):
    schema = "d decimal(10,2), t timestamp, z double, n string, b binary"
    one = (Decimal("1.0"), datetime(2024, 1, 1), 0.0, None, b"\x00\x01\x02\xff")
    two = (Decimal("1.00"), datetime(2024, 1, 1), -0.0, None, b"\x00\x01\x02\xff")
    df = spark.createDataFrame([one, two], schema)
    assert rows(aggregate_rows(df, df.columns, SIX[:1]))[0][-1] == 2
    assert distinct_rows(df).count() == 1


def test_aggregate_overflow(spark):
    def total(values, schema, operation="sum"):
        df = spark.createDataFrame([(v,) for v in values], schema)
        return rows(aggregate_rows(df, [], [{"name": "T", "operation": operation, "column": "v"}]))[0][0]

    for values, schema, operation in [
        ([2**63 - 1, 1], "v long", "sum"), ([1.7e308, 1.7e308], "v double", "sum"), ([NAN], "v double", "average"),
        ([Decimal("9" * 38)] * 2, "v decimal(38,0)", "sum"),
    ]:
        with pytest.raises(PySparkException):
            total(values, schema, operation)
    big = Decimal("79228162514264337593543950335")
    assert total([big, big], "v decimal(29,0)", "average") == big
    assert total([NAN, 1.0], "v double", "maximum") == 1.0 and math.isnan(total([NAN, 1.0], "v double", "minimum"))
    assert math.isnan(total([NAN, None], "v double", "maximum"))


def test_distinct_by_key_keeps_whole_first_row(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "Id long, Version long")
    assert bag(distinct_rows(df, ["id"], ["Version"])) == [(1, 1), (2, 1)]
    newest = [{"column": "Version", "direction": "descending"}]
    assert bag(distinct_rows(df, ["Id"], newest)) == [(1, 2), (2, 1)]
    assert bag(distinct_rows(df, ["Id"])) == [(1, 1), (2, 1)]
    with pytest.raises(LimitExceeded):
        distinct_rows(df, ["Id"], max_keys=1)


def test_sort(spark):
    df = spark.createDataFrame([("B", 2, 1), ("A", None, 2), ("A", 3, 3), ("A", 3, 4)], "Group string, Rank long, Sequence long")
    keys = [{"column": "Group"}, {"column": "Rank", "direction": "descending", "nulls": "first"}]
    assert [r[2] for r in rows(sort_rows(df, keys, ["Sequence"]))] == [2, 3, 4, 1]
    with pytest.raises(LimitExceeded):
        sort_rows(df, keys, max_rows=3)


@pytest.mark.parametrize("direction", ["ascending", "descending"])
@pytest.mark.parametrize("nulls", ["first", "last"])
def test_sort_nan_and_nulls(spark, direction, nulls):
    df = spark.createDataFrame([(1.0,), (None,), (NAN,), (-5.0,)], "v double")
    got = [r[0] for r in rows(sort_rows(df, [{"column": "v", "direction": direction, "nulls": nulls}]))]
    values = [NAN, -5.0, 1.0] if direction == "ascending" else [1.0, -5.0, NAN]
    assert repr(got) == repr([None, *values] if nulls == "first" else [*values, None])


def test_number_rows_is_dense_over_many_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7).select((F.col("id") * 37 % 1000).alias("v"), F.lit("hot").alias("k"))
    numbered = number_rows(sort_rows(df, ["k", "v"]), "n")
    assert sorted((r["v"], r["n"]) for r in numbered.collect()) == [(i, i + 1) for i in range(1000)]


def sorted_in_python(rows, descending, nulls_first):
    """By a (NaN lowest), then b descending with nulls last, then the unique id."""
    def value(x, nulls_first, descending):
        if x is None:
            return (0 if nulls_first else 2, 0)
        number = -math.inf if x != x else x
        return (1, -number if descending else number)

    return sorted(rows, key=lambda r: (value(r[0], nulls_first, descending), value(r[1], False, True), r[2]))


@pytest.mark.parametrize(("pivots", "descending", "nulls_first"), [(63, False, True), (3, True, True), (1, False, False)])
def test_slices_equal_a_sorted_list(spark, monkeypatch, pivots, descending, nulls_first):
    from tablewright.operators import ranks
    from tablewright.operators.sort import SortKey, order_terms

    monkeypatch.setattr(ranks, "PIVOTS", pivots)
    monkeypatch.setattr(ranks, "NEAR", pivots if pivots < 5 else 5_000)
    rng = random.Random(pivots)
    rows = [(rng.choice([None, float("nan"), 0.0, 1.5, -2.0]), rng.choice([None, 1, 2]), i) for i in range(90)]
    df = spark.createDataFrame(rows, "a double, b int, id int").repartition(5)
    terms = order_terms(df, [SortKey("a", descending, nulls_first), SortKey("b", True, False), SortKey("id")])
    want = [r[2] for r in sorted_in_python(rows, descending, nulls_first)]
    for offset, count in ((0, 7), (1, 1), (40, 13), (85, 50), (89, 1), (90, 5), (500, 2)):
        out = ranks.slice_rows(df, terms, offset, count)
        assert [r["id"] for r in out.collect()] == want[offset : offset + count], (offset, count)


def test_slices_of_equal_rows_and_times(spark):
    from datetime import datetime

    from tablewright.operators.ranks import Term, slice_rows

    df = spark.createDataFrame([(1, i) for i in range(50)], "a int, id int").repartition(4)
    first, rest = (slice_rows(df, [Term(F.col("a"))], a, n).collect() for a, n in ((10, 15), (25, 100)))
    assert len(first) == 15 and len(rest) == 25 and not {r["id"] for r in first} & {r["id"] for r in rest}
    moments = [datetime(2024, 1, 1, 0, 0, 0, i) for i in range(40)]
    for kind in ("timestamp_ntz", "timestamp", "date"):
        stamped = spark.createDataFrame([(m, str(m)) for m in moments], "t timestamp_ntz, s string").withColumn("t", F.col("t").cast(kind))
        got = slice_rows(stamped, [Term(F.col("t"), True, False), Term(F.col("s"))], 5, 10).collect()
        order = sorted(map(str, moments), reverse=kind != "date")
        assert [r["s"] for r in got] == order[5:15]


def test_source_order_goes_through_operators(spark, tmp_path):
    from tablewright.operators.source_order import SOURCE, with_source_order, without_source_order

    rng = random.Random(8)
    rows = [(rng.randint(0, 2), i) for i in range(60)]
    spark.createDataFrame(rows, "k int, i int").coalesce(1).write.parquet(str(tmp_path / "t"))
    df = with_source_order(spark.read.parquet(str(tmp_path / "t")))
    picked = select_columns(filter_rows(df, [{"column": "i", "operator": "greaterThan", "value": "4"}]), ["k", "i"])
    assert [tuple(r) for r in without_source_order(sort_rows(picked, ["k"])).collect()] == sorted((r for r in rows if r[1] > 4), key=lambda r: r[0])
    both = union_rows([picked, df])
    assert [tuple(r)[:2] for r in sort_rows(both, ["k"]).collect()] == sorted([r for r in rows if r[1] > 4] + rows, key=lambda r: r[0])
    first = {r["k"]: r["i"] for r in distinct_rows(both, ["k"]).collect()}
    assert first == {k: next(i for a, i in rows if a == k and i > 4) for k in (0, 1, 2)}
    assert without_source_order(distinct_rows(both)).count() == 60
    assert SOURCE not in join(df, df, ["i"], ["i"]).columns and SOURCE not in union_rows([both.drop(SOURCE), df]).columns
