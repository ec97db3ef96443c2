import pytest

from tablewright.errors import TabularError
from tablewright.plans.node_graph import run_nodes
from tablewright.sources.delimited import read_delimited


def node(id, kind, **settings):
    return {"id": id, "kind": kind, "settings": settings}


def edge(a, b):
    return {"from": a, "to": b}


def test_graph_runs_targets_and_skips_descendants(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, name string").write.parquet(source)
    spec = {
        "nodes": [
            node("read", "parquetSource", path=source), node("pick", "distinctRows"),
            node("out", "csvTarget", path=str(tmp_path) + "/{region}", mode="createNew"), node("bad", "selectColumns", columns=["missing"]),
            node("after", "sortRows", keys=["id"]), node("late", "csvTarget", path=str(tmp_path / "late")),
            node("boom", "deriveColumns", columns=[{"name": "x", "expression": "raise_error('boom')", "type": "string"}]),
            node("boomOut", "csvTarget", path=str(tmp_path / "boom")),
        ],
        "edges": [edge("read", "pick"), edge("pick", "out"), edge("read", "bad"), edge("bad", "after"), edge("after", "late"), edge("pick", "boom"), edge("boom", "boomOut")],
    }
    run = run_nodes(spark, spec, {"region": "north"})
    assert run.status == {
        "read": "Succeeded", "pick": "Succeeded", "out": "Succeeded", "bad": "Failed", "after": "Skipped", "late": "Skipped",
        "boom": "Failed", "boomOut": "Skipped",
    }
    assert read_delimited(spark, str(tmp_path / "north")).count() == 2 and "missing" in run.errors["bad"]


def test_graph_checks(spark):
    with pytest.raises(TabularError, match="graph.cycle"):
        run_nodes(spark, {"nodes": [node("a", "distinctRows"), node("b", "distinctRows")], "edges": [edge("a", "b"), edge("b", "a")]})
    with pytest.raises(TabularError, match="graph.edge"):
        run_nodes(spark, {"nodes": [node("a", "distinctRows")], "edges": [edge("a", "x")]})
    with pytest.raises(TabularError, match="graph.size"):
        run_nodes(spark, {"nodes": [node("a", "distinctRows"), node("a", "distinctRows")]})
    assert run_nodes(spark, {"nodes": [node("a", "pivot")]}).status == {"a": "Failed"}


def test_the_guilty_node_fails_and_only_its_descendants_are_skipped(spark, tmp_path):
    source, text = str(tmp_path / "in"), tmp_path / "text"
    spark.range(10).selectExpr("id", "CASE WHEN id = 7 THEN NULL ELSE 'a' END AS name", "10 - id AS left").write.parquet(source)
    text.mkdir()
    (text / "a.csv").write_text('Id,Name\n1,"a"b\n')
    derive = lambda id, **c: node(id, "deriveColumns", columns=[{"name": "x", **c}])
    spec = {
        "nodes": [
            node("read", "parquetSource", path=source), derive("strict [1]", expression="name", type="string", nullable=False),
            derive("divide", expression="100 / (left - 3)", type="double"), derive("fine", expression="left", type="int64"),
            node("lines", "csvSource", path=str(text)),
            *[node(f"to {n}", "csvTarget", path=str(tmp_path / f"out{i}")) for i, n in enumerate(("strict", "divide", "fine", "lines"))],
            node("sorted", "sortRows", keys=["id"]), node("wrong", "sortRows", columns=["id"]),
        ],
        "edges": [
            edge("read", "strict [1]"), edge("read", "divide"), edge("read", "fine"), edge("strict [1]", "sorted"), edge("sorted", "to strict"),
            edge("divide", "to divide"), edge("fine", "to fine"), edge("lines", "to lines"), edge("read", "wrong"),
        ],
    }
    run = run_nodes(spark, spec)
    assert run.status == {
        "read": "Succeeded", "strict [1]": "Failed", "sorted": "Skipped", "to strict": "Skipped", "divide": "Failed", "to divide": "Skipped",
        "fine": "Succeeded", "to fine": "Succeeded", "lines": "Failed", "to lines": "Skipped", "wrong": "Failed",
    }
    assert "value.null" in run.errors["strict [1]"] and "DIVIDE_BY_ZERO" in run.errors["divide"] and "graph.settings" in run.errors["wrong"]
    assert set(run.frames) == {"read", "fine"}


def test_programming_errors_go_up(spark, monkeypatch):
    from tablewright.plans import node_graph

    def broken(spark):
        raise KeyError("a fault of the program")

    monkeypatch.setitem(node_graph.SOURCES, "broken", broken)
    with pytest.raises(KeyError):
        run_nodes(spark, {"nodes": [node("a", "broken")]})


def test_functions_variables_bindings_and_progress(spark, tmp_path):
    source, other = str(tmp_path / "in"), str(tmp_path / "other")
    spark.range(6).selectExpr("id", "'n' || id AS name").write.parquet(source)
    spark.createDataFrame([("a", 2), ("b", 9)], "code string, factor long").write.parquet(other)
    spec = {
        "variables": [
            {"name": "factor", "type": "int64", "lookup": {"path": other, "value": "factor", "filter": "code", "equals": "a"}},
            {"name": "place", "type": "string", "value": "north"},
        ],
        "functions": [{"name": "scaled_by", "parameters": {"x": "bigint", "f": "bigint"}, "returns": "bigint", "expression": "x * f + 1"}],
        "nodes": [
            node("read", "parquetSource", path=source),
            node("some", "filterRows", conditions=[{"column": "id", "operator": "lessThan", "value": "4"}]),
            node("made", "deriveColumns", columns=[{"name": "y", "expression": "scaled_by(row.id, vars.factor)", "type": "int64"}]),
            node("out", "csvTarget", path=str(tmp_path) + "/{place}", columns="y bigint, place string, day string",
                 bindings={"y": {"column": "Y"}, "place": {"variable": "place"}, "day": {"expression": "upper(name)"}}),
        ],
        "edges": [edge("read", "some"), edge("some", "made"), edge("made", "out")],
    }
    run = run_nodes(spark, spec, progress=True)
    assert set(run.status.values()) == {"Succeeded"}, run.errors
    assert sorted(tuple(r) for r in read_delimited(spark, str(tmp_path / "north")).collect()) == [(str(2 * i + 1), "north", f"N{i}") for i in range(4)]
    assert run.progress == {"read": {"rows": 6, "bytes": 60}, "some": {"rows": 4, "bytes": 40}, "made": {"rows": 4, "bytes": 72}, "out": {"rows": 4, "bytes": 72}}
    with pytest.raises(TabularError, match="lookup.none"):
        run_nodes(spark, {**spec, "variables": [{"name": "factor", "type": "int64", "lookup": {"path": other, "value": "factor", "filter": "code", "equals": "z"}}]})
