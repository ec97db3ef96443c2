from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.errors import LimitExceeded, TabularError
from tablewright.functions.values import double_text, normalise_types, parse_text, to_text, try_parse
from tablewright.governed.cells import normalise_cell
from tablewright.governed.contract import ContractColumn
from tablewright.limits import within_limits
from tablewright.oplog.metrics import estimate_bytes, with_progress
from tablewright.schema import schema_drift, schema_fingerprint


def parse_all(spark, kind, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(try_parse(F.col("t"), kind)).collect()]


@pytest.mark.parametrize(
    "kind,cases",
    [
        ("boolean", {"true": True, " FALSE ": False, "yes": None, "t": None, "1": None}),
        ("int64", {"1": 1, " +5 ": 5, "-7": -7, "1,0": None, "9223372036854775808": None, "1.0": None}),
        ("decimal", {"1,234.5": Decimal("1234.5"), "5-": -5, "-5": -5, "+5": 5, "5 +": 5, "-5-": None, ".5": Decimal("0.5"), "5.": 5, ",1": None, "1e3": None, "- 5": None}),
        ("double", {"1,234.5e2": 123450.0, "1.0D": None, "5f": None, "-Infinity": float("-inf"), "1e400": float("inf"), "0x1": None}),
        ("guid", {"{0F8FAD5B-D9CB-469F-A165-70867728950E}": "0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5bd9cb469fa16570867728950e": "0f8fad5b-d9cb-469f-a165-70867728950e", "0f8fad5b": None}),
        ("binary", {"AAEC/w==": bytearray(b"\x00\x01\x02\xff"), "abc": None, "AA EC": bytearray(b"\x00\x01\x02"), "!!!!": None}),
        (
            "timestamp",
            {
                "2024-01-02": datetime(2024, 1, 2), "2024-01-02T03:04:05.1234567+02:00": datetime(2024, 1, 2, 1, 4, 5, 123456),
                "2024-01-02 03:04": datetime(2024, 1, 2, 3, 4), "2024-01-02 03:04Z": datetime(2024, 1, 2, 3, 4),
                "2024-01-02 03:04:05": datetime(2024, 1, 2, 3, 4, 5), "2024-13-02": None, "01/02/2024 03:04:05": datetime(2024, 1, 2, 3, 4, 5),
                "1/2/2024": datetime(2024, 1, 2), "yesterday": None, "12:00": None,
            },
        ),
    ],
)
def test_strict_parsing(spark, kind, cases):
    assert parse_all(spark, kind, cases) == list(cases.values())


def test_empty_and_bad_text(spark):
    df = spark.createDataFrame([("",)], "t string")
    assert df.select(parse_text(F.col("t"), "int64"), parse_text(F.col("t"), "string")).first() == (None, "")
    for column, code in [
        (parse_text(F.col("t"), "int64", nullable=False), "value.null"),
        (parse_text(F.lit("x"), "int64"), "value.format"),
        (parse_text(F.lit("xyz"), "string", max_chars=2), "value.format"),
    ]:
        with pytest.raises(PySparkException, match=code):
            df.select(column).collect()


def test_double_text(spark):
    cases = {
        1.0: "1", 0.1: "0.1", 1e7: "10000000", 1234567.5: "1234567.5", 123456789012345.6: "123456789012345.6", 1e14: "100000000000000",
        1e15: "1E+15", 1.5e16: "1.5E+16", 1e-4: "0.0001", 1e-5: "1E-05", -2.5e-10: "-2.5E-10", 1e100: "1E+100", 0.0: "0",
        0.00012345678901234567: "0.00012345678901234567", float("inf"): "Infinity",
    }
    df = spark.createDataFrame([(v,) for v in cases], "v double")
    assert {r[0]: r[1] for r in df.select("v", double_text(F.col("v"))).collect()} == cases


def test_to_text(spark):
    df = spark.createDataFrame(
        [(True, 5, Decimal("1.50"), "a", datetime(2024, 1, 2, 3, 4, 5, 600), b"\x00\xff", None)],
        "b boolean, i int, d decimal(5,2), s string, t timestamp, x binary, n double",
    )
    out = df.select(*[to_text(df[f.name], f.dataType) for f in df.schema.fields]).first()
    assert tuple(out) == ("True", "5", "1.50", "a", "2024-01-02T03:04:05.0006000+00:00", "AP8=", "")


def test_normalise_types(spark):
    df = spark.sql("SELECT 1Y a, 2S b, 3 c, 1.5F d, DATE'2024-01-02' e, TIMESTAMP_NTZ'2024-01-02 03:04:05' f, X'00' g")
    out = normalise_types(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["bigint", "bigint", "bigint", "double", "timestamp", "timestamp", "binary"]
    assert out.first()["e"] == datetime(2024, 1, 2)
    with pytest.raises(TabularError, match="schema.type"):
        normalise_types(spark.sql("SELECT array(1) a"))


@pytest.mark.parametrize(
    "column,cases",
    [
        (ContractColumn("", "c", "byte", nullable=False), {"255": (255, None), "256": (None, "InvalidType"), "": (None, "Required"), "-1": (None, "InvalidType")}),
        (ContractColumn("", "c", "int32"), {"5": (5, None), "2147483648": (None, "InvalidType"), "": (None, None)}),
        (
            ContractColumn("", "c", "decimal", precision=5, scale=2),
            {"123.45": (Decimal("123.45"), None), "1.234": (None, "NumericScale"), "1234.5": (None, "NumericPrecision"), "x": (None, "InvalidType"), "1.230": (Decimal("1.23"), None)},
        ),
        (ContractColumn("", "c", "string", max_length=2), {"ab": ("ab", None), "abc": (None, "MaximumLength"), "": ("", None)}),
        (ContractColumn("", "c", "binary", max_length=2), {"AAE=": (bytearray(b"\x00\x01"), None), "AAEC": (None, "MaximumBinaryLength")}),
        (ContractColumn("", "c", "double"), {"1e3": (1000.0, None), "1e400": (None, "InvalidType"), "NaN": (None, "InvalidType"), "1,000": (None, "InvalidType")}),
        (ContractColumn("", "c", "date"), {"2024-02-30": (None, "InvalidType"), "2024-02-29": (date(2024, 2, 29), None)}),
        (ContractColumn("", "c", "time"), {"3:04": ("03:04:00.0000000", None), "03:04:05.12": ("03:04:05.1200000", None), "25:00": (None, "InvalidType")}),
        (ContractColumn("", "c", "datetime"), {"2024-01-02 03:04:05": (datetime(2024, 1, 2, 3, 4, 5), None), "soon": (None, "InvalidType")}),
        (ContractColumn("", "c", "boolean"), {"True": (True, None), "2": (None, "InvalidType")}),
    ],
)
def test_cells(spark, column, cases):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "i int, t string")
    got = [tuple(r[0]) for r in df.orderBy("i").select(normalise_cell(F.col("t"), column)).collect()]
    assert got == list(cases.values())


def test_fingerprint_and_drift(spark):
    a, b = spark.sql("SELECT 1 id, 'x' name"), spark.sql("SELECT 1L id, 'x' title")
    assert schema_fingerprint(a, ["id"]) == schema_fingerprint(spark.sql("SELECT 2 id, 'y' name"), ["id"])
    assert schema_fingerprint(a) != schema_fingerprint(a, ["id"]) != schema_fingerprint(b, ["id"])
    assert schema_drift(a, a) == [] and schema_drift(a, b) == ["removed name", "added title", "type id: int -> bigint"]


def test_sizes_and_limits(spark):
    df = spark.createDataFrame([(1, "héé", None), (2, None, 1.0)], "a long, b string, c double")
    assert estimate_bytes(df).first()[0] == (8 + 5 + 1) + (8 + 1 + 8)
    watched, seen = with_progress(df, "watch")
    watched.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 2, "bytes": 31}
    assert within_limits(df, max_rows=2, max_columns=3, max_bytes=31) is df
    for limit in ({"max_rows": 1}, {"max_columns": 2}, {"max_bytes": 30}):
        with pytest.raises(LimitExceeded):
            within_limits(df, **limit)


def test_literal_checks(spark):
    from tablewright.functions.values import literal

    with pytest.raises(TabularError):
        literal("abc", T.LongType())
    with pytest.raises(TabularError):
        literal("maybe", T.BooleanType())
    with pytest.raises(TabularError):
        literal("2024-99-01", T.TimestampType())
