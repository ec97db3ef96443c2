"""Connected components by alternating star contractions, with DataFrame functions alone.

Each round links every node's larger neighbours to its smallest one, then every node's smaller neighbours
to the smallest of them, until all edges point to the smallest node of their component. Edges never grow
in number, a hot node's edges are split over tasks by the joins, and every round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch


def components(edges: DataFrame, most_rounds: int = 100, within: Scratch | None = None) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a``, ``b``); the root is the component's smallest node.

    Loops, repeated edges and edges with a null end are left out; no edge gives no row. The last round's edges stay in
    the shared folder, or in that of ``within`` until it is cleared.
    """
    scratch = Scratch(edges.sparkSession, "components", within)
    held = scratch.put("edges", edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(most_rounds):
        # u > v throughout. Large star: a node's larger neighbours go to its smallest neighbour or itself.
        both = held.unionAll(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = held.select(F.col("v").alias("u"), F.col("u").alias("w")).join(low, "u").select(F.col("w").alias("u"), F.col("m").alias("v")).unionAll(low.where("u <> m").select("u", F.col("m").alias("v")))
        held = scratch.put("edges", large.where("u <> v").distinct())
        # Small star: a node's smaller neighbours, and the node, go to the smallest of them.
        least = held.groupBy("u").agg(F.min("v").alias("m"))
        small = held.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionAll(least.select("u", F.col("m").alias("v")))
        held = scratch.put("edges", small.distinct())
        # Done when no node has two roots and no root is below another node.
        ends = held.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(held.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 OR (up = 1 AND down = 1)").limit(1).count():
            roots = held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(roots)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
