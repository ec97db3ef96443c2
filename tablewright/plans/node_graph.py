"""A graph of named nodes over the operators: each node is a DataFrame, targets run jobs."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark import StorageLevel
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tablewright.errors import TabularError, building, marked_node
from tablewright.functions.variables import MAX_VARIABLES, NAME, lookup_value, register_functions, typed_value
from tablewright.oplog.metrics import progress_of, with_progress
from tablewright.operators.aggregate import aggregate_rows
from tablewright.operators.distinct import distinct_rows
from tablewright.operators.filter import filter_rows
from tablewright.operators.join import join
from tablewright.operators.project import derive_columns, select_columns
from tablewright.operators.sort import sort_rows
from tablewright.operators.union import union_rows
from tablewright.sources.delimited import read_delimited
from tablewright.sources.jdbc import read_table
from tablewright.sources.workbook import read_workbooks
from tablewright.targets.delimited import render_path, write_delimited
from tablewright.targets.jdbc import write_table
from tablewright.targets.mutations import TargetColumn, bind_columns, mutate_table
from tablewright.targets.published import mutate_published, read_published

SOURCES: dict[str, Callable[..., DataFrame]] = {
    "parquetSource": lambda spark, path: spark.read.parquet(path),
    "publishedSource": lambda spark, root: read_published(spark, root),
    "csvSource": read_delimited,
    "tableSource": read_table,
    "workbookSource": read_workbooks,
}
TRANSFORMS: dict[str, Callable[..., DataFrame]] = {
    "selectColumns": select_columns,
    "filterRows": filter_rows,
    "join": join,
    "unionRows": lambda *inputs, **settings: union_rows(inputs, **settings),
    "deriveColumns": derive_columns,
    "aggregateRows": aggregate_rows,
    "distinctRows": distinct_rows,
    "sortRows": sort_rows,
}
TARGETS: dict[str, Callable] = {
    "csvTarget": write_delimited,
    "tableTarget": write_table,
    "publishedTarget": mutate_table,
    "publishedFilesTarget": mutate_published,
}
MAX_NODES, MAX_EDGES = 200, 1000
REPORT_SECONDS = 5.0


# A node's own failures; anything else is a fault of the program and goes up.
NODE_ERRORS = (TabularError, PySparkException, Py4JJavaError)


@dataclass
class GraphRun:
    """DataFrames by node, and Succeeded, Failed or Skipped per node.

    ``progress`` has, per node whose rows a target's job read, the rows and estimated bytes it gave, and per target those
    it wrote; batches are Spark's own and are not counted.
    """

    frames: dict[str, DataFrame] = field(default_factory=dict)
    status: dict[str, str] = field(default_factory=dict)
    errors: dict[str, str] = field(default_factory=dict)
    progress: dict[str, dict[str, int]] = field(default_factory=dict)


def graph_variables(spark: SparkSession, spec: Mapping, given: Mapping[str, object] | None = None) -> dict[str, object]:
    """Values frozen before the run: those given, then the graph's own typed literals and lookups.

    A variable has ``name``, ``type`` and ``value``, or ``lookup``: ``path`` of a Parquet table, ``value``, ``filter`` and
    ``equals``, which must match one row.
    """
    values, declared = dict(given or {}), spec.get("variables", [])
    if len(declared) + len(values) > MAX_VARIABLES:
        raise TabularError("variable.count", f"at most {MAX_VARIABLES} variables")
    for variable in declared:
        name, kind = variable["name"], variable["type"]
        if not NAME.match(name) or name.lower() in {n.lower() for n in values}:
            raise TabularError("variable.name", f"invalid or repeated variable '{name}'")
        if "lookup" in variable:
            wanted = variable["lookup"]
            values[name] = lookup_value(spark.read.parquet(wanted["path"]), wanted["value"], wanted["filter"], wanted["equals"], kind)
        else:
            values[name] = typed_value(kind, variable["value"], name)
    return values


def run_nodes(spark: SparkSession, spec: Mapping, variables: Mapping[str, object] | None = None, progress: bool = False) -> GraphRun:
    """Build every node once, inputs first; run the targets in order.

    ``spec`` has ``nodes`` (``id``, ``kind``, ``settings``) and ``edges`` (``from``, ``to``, in input order), and may have
    ``variables`` (see ``graph_variables``) and ``functions`` (``name``, ``parameters``, ``returns``, ``expression``) for
    the expressions of its nodes. A failed node skips only its descendants: a data error that a target's job meets is
    the failure of the node whose expression raised it. A node that several targets read is kept on disk for the
    length of the run. With ``progress`` every node's rows and bytes are counted, which keeps filters and columns from
    moving past the nodes.
    """
    nodes = {n["id"]: n for n in spec["nodes"]}
    edges = spec.get("edges", [])
    if len(nodes) != len(spec["nodes"]) or len(nodes) > MAX_NODES or len(edges) > MAX_EDGES:
        raise TabularError("graph.size", "repeated node ids, or too many nodes or edges")
    inputs: dict[str, list[str]] = {n: [] for n in nodes}
    for edge in edges:
        if edge["from"] not in nodes or edge["to"] not in nodes:
            raise TabularError("graph.edge", f"unknown node in edge {dict(edge)}")
        inputs[edge["to"]].append(edge["from"])
    readers = _targets_below(nodes, inputs)
    values = graph_variables(spark, spec, variables)
    register_functions(spark, {f["name"]: (f["parameters"], f["returns"], f["expression"]) for f in spec.get("functions", [])})
    run, kept, watched = GraphRun(), [], {}
    try:
        for name in _inputs_first(nodes, inputs):
            if any(run.status[i] != "Succeeded" for i in inputs[name]):
                run.status[name] = "Skipped"
                continue
            frames = [run.frames[i] for i in inputs[name]]
            if progress and nodes[name]["kind"] in TARGETS:
                frames, seen = zip(*[with_progress(f, f"{name}-written") for f in frames]) if frames else ([], [])
                watched[name] = seen
            try:
                with building(name):
                    frame = _build(spark, nodes[name], frames, values)
            except NODE_ERRORS as error:
                guilty = _guilty(name, error, run, inputs) if nodes[name]["kind"] in TARGETS else name
                _failed(guilty, error, run, inputs)
                if guilty != name:
                    run.status[name] = "Skipped"
                continue
            if frame is not None:
                if progress:
                    frame, seen = with_progress(frame, name)
                    watched[name] = [seen]
                if _branches(name, inputs) and len(readers[name]) > 1:
                    frame = frame.persist(StorageLevel.DISK_ONLY)
                    kept.append(frame)
                run.frames[name] = frame
            run.status[name] = "Succeeded"
    finally:
        for frame in kept:
            frame.unpersist()
    for name, seen in watched.items():
        ran = any(run.status[t] == "Succeeded" for t in readers[name])
        counted = [p for o in seen if (p := progress_of(o, REPORT_SECONDS if ran else 0)) is not None]
        if run.status[name] == "Succeeded" and counted:
            run.progress[name] = {k: sum(c[k] for c in counted) for k in ("rows", "bytes")}
    return run


def _ancestors(name: str, inputs: Mapping[str, Sequence[str]]) -> set[str]:
    found: set[str] = set()
    left = [name]
    while left:
        for source in inputs[left.pop()]:
            if source not in found:
                found.add(source)
                left.append(source)
    return found


def _guilty(target: str, error: Exception, run: GraphRun, inputs: Mapping[str, Sequence[str]]) -> str:
    """The node whose rows a target's job could not make.

    The error names it where the library's own checks raised it. Other errors, of arithmetic or of users' expressions,
    are looked for by making each node's rows alone, inputs first, which only a failed run pays for.
    """
    before = _ancestors(target, inputs)
    named = marked_node(str(error))
    if named is not None and (named == target or named in before):
        return named
    if isinstance(error, TabularError):
        return target
    for name in _inputs_first(inputs, inputs):
        if name in before:
            try:
                run.frames[name].write.format("noop").mode("overwrite").save()
            except NODE_ERRORS:
                return name
    return target


def _failed(name: str, error: Exception, run: GraphRun, inputs: Mapping[str, Sequence[str]]) -> None:
    """A failed node takes what is made of its rows along; targets that ran before keep what they wrote."""
    text = str(error)
    # The message of the task's error, below those of job and stage.
    lines = [line for line in text.splitlines() if "[node=" in line or "USER_RAISED_EXCEPTION" in line]
    run.status[name], run.errors[name] = "Failed", (lines or text.splitlines() or [type(error).__name__])[0]
    for other in run.frames:
        if name in _ancestors(other, inputs):
            run.status[other] = "Skipped"
    for other in [o for o in run.frames if run.status[o] != "Succeeded"]:
        del run.frames[other]


def _build(spark: SparkSession, node: Mapping, frames: Sequence[DataFrame], variables: Mapping[str, object]):
    kind, settings = node["kind"], dict(node.get("settings", {}))
    for kinds in (SOURCES, TRANSFORMS, TARGETS):
        if kind in kinds:
            break
    else:
        raise TabularError("graph.kind", f"unknown node kind '{kind}'")
    if kinds is SOURCES and frames:
        raise TabularError("graph.inputs", "a source takes no input")
    if kinds is TARGETS and len(frames) != 1:
        raise TabularError("graph.inputs", "a target takes one input")
    if kinds is TARGETS and "path" in settings:
        settings["path"] = "/".join(render_path(part, variables) if "{" in part else part for part in settings["path"].split("/"))
    if kind in ("deriveColumns", "publishedTarget", "publishedFilesTarget"):
        settings["variables"] = variables
    if kind in ("tableTarget", "csvTarget") and ("columns" in settings or "bindings" in settings):
        frames = [_bound(frames[0], settings, variables)]
    arguments = [spark] if kinds is SOURCES else list(frames)
    try:
        inspect.signature(kinds[kind]).bind(*arguments, **settings)
    except TypeError as error:
        raise TabularError("graph.settings", f"settings of '{kind}': {error}") from error
    made = kinds[kind](*arguments, **settings)
    return None if kinds is TARGETS else made


def _bound(frame: DataFrame, settings: dict, variables: Mapping[str, object]) -> DataFrame:
    """The rows shaped for a target whose columns the settings give as DDL text."""
    columns, bindings = settings.pop("columns", None), settings.pop("bindings", None)
    if columns is None:
        raise TabularError("graph.settings", "bindings need the target's 'columns'")
    keys = settings.get("keys", ())
    lowered = {k.lower() for k in keys}
    target = [TargetColumn(f.name, f.dataType, f.nullable and f.name.lower() not in lowered, key=f.name.lower() in lowered) for f in T.StructType.fromDDL(columns).fields]
    return bind_columns(frame, target, bindings, variables, settings.get("mode", "insert") if keys else "insert", keys)


def _inputs_first(nodes: Mapping, inputs: Mapping[str, Sequence[str]]) -> list[str]:
    order, done = [], set()
    while len(order) < len(nodes):
        ready = sorted(n for n in nodes if n not in done and all(i in done for i in inputs[n]))
        if not ready:
            raise TabularError("graph.cycle", "the graph has a cycle")
        order += ready
        done.update(ready)
    return order


def _branches(name: str, inputs: Mapping[str, Sequence[str]]) -> bool:
    return sum(sources.count(name) for sources in inputs.values()) > 1


def _targets_below(nodes: Mapping, inputs: Mapping[str, Sequence[str]]) -> dict[str, set[str]]:
    below: dict[str, set[str]] = {n: set() for n in nodes}
    for name in reversed(_inputs_first(nodes, inputs)):
        if nodes[name]["kind"] in TARGETS:
            below[name].add(name)
        for source in inputs[name]:
            below[source] |= below[name]
    return below
