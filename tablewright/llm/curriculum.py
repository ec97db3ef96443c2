"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions alone.

Each source has a weight and a slope: its weight at training time t in [0, 1] is
``weight * (1 + slope * (2t - 1))``, which integrates to the weight. The integral says how many words of a
source are demanded by time t; inverting it gives each document the time at which it is due.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import WORD, Scratch, col, whole_text

BLOCK_ROWS = 4096
POSITION_UNITS = 1_000_000_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], slopes: list[float], share: float, cap: float) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``slope``.

    Sources by code point, null last, take the weights and slopes in turn. ``share`` times all words is
    dealt by weight; no source gets more than ``cap`` times its size, and what is above goes to the others
    by weight until none is above. That end state is one level L with target = min(cap, weight * L): with
    sources by cap per weight, L is fixed by the first k sources that are full.
    The windows here hold one row per source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.row_number().over(ordered) - 1
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(turn, F.lit(len(values))) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rows = rows.select("source", "source_size", pick(weights).alias("weight"), pick(slopes).alias("slope"), (F.col("source_size") * F.lit(float(cap))).alias("most"))
    everything = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = Window.partitionBy(F.lit(1)).orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    total = F.sum("source_size").over(everything) * F.lit(float(share))
    full = F.coalesce(F.sum("most").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("weight").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (total - full) / left)
    # The level of the first source that is not full holds for all after it.
    open_level = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    rows = rows.withColumn("level", F.first(open_level, ignorenulls=True).over(filling.rowsBetween(Window.unboundedPreceding, 0)))
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least(F.col("most"), F.col("level") * F.col("weight")))
    return rows.select("source", "source_size", target.alias("target"), "slope")


def running_words(sized: DataFrame, rows: int, *ties: str) -> DataFrame:
    """``sized`` with ``before``: the words of its source that come before each document.

    Documents of a source follow the MD5 digest of their id, rows that share an id the columns ``ties``. Blocks are digest prefixes: each is summed
    first, block offsets are summed per source, then documents within their block, so no task holds a source.
    """
    digits = max(1, math.ceil(math.log(max(1, rows / BLOCK_ROWS), 16)))
    sized = sized.withColumn("digest", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("block", F.left("digest", F.lit(digits)))
    blocks = sized.groupBy("source", "block").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("source", "block", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "block").orderBy("digest", "doc_id", *ties).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    joined = placed.join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.block") == F.col("o.block")))
    return joined.select("d.*", (F.col("base") + F.col("inner")).alias("before"))


def mix(docs: DataFrame, weights: list[int], slopes: list[float] | None = None, share: float = 1.5, cap: float = 2.0,
        key: str = "doc_id", text: str = "text", source: str = "source", row: str | None = None) -> DataFrame:
    """One row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``taken``, ``position``.

    ``size`` counts words; null and blank texts have none and take none. A source is read in the order of
    its documents' MD5 digests, again from the start if its target exceeds it, until its target is reached:
    ``taken`` is what the mix takes of a document, passes added up, so the sum over a source is its target
    rounded down and only the document at the end of a pass is cut. ``position`` is the training time in
    billionths at which the document is first due, null if it is not taken; rows come sorted by it.
    Rows that repeat an id, null ones too, follow each other by size. ``row`` names a column that tells rows apart:
    it comes along as ``row`` and orders rows of one id and size, and so do ``positions``, the times at which each pass
    reaches the row, null from the first pass that doesn't. An empty table gives an empty result. The sizes are
    written to the shared folder once; only ids, sources and sizes are shuffled, never texts.
    """
    spark = docs.sparkSession
    slopes = slopes or [0.0]
    if not weights or min(weights) <= 0 or max(map(abs, slopes)) > 1:
        raise ValueError("weights must be positive and slopes between -1 and 1")
    own = [] if row is None else ["row"]
    sizes = docs.select(col(key).alias("doc_id"), col(source).alias("source"), word_count(whole_text(text)).alias("size"), *[col(row).alias(c) for c in own])
    sized = Scratch(spark, "mix").put("sizes", sizes)
    targets = source_targets(sized, weights, slopes, share, cap)
    rows = running_words(sized, sized.count(), "size", *own).drop("digest", "block", "inner").alias("r")
    # One row per source, and the documents of a source are spread over tasks: AQE splits or broadcasts.
    rows = rows.join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "source_size", "target", "slope")
    due = F.floor(F.col("target"))
    passes = [F.greatest(F.lit(0), F.least(F.col("size"), due - F.col("before") - F.col("source_size") * p)) for p in range(math.ceil(cap))]
    taken = sum(passes[1:], passes[0]).cast("long")
    # demand(t) = target * ((1 - a) t + a t^2) = words before; solved for t without cancellation.
    def position(before: Column, taken: Column) -> Column:
        part, a = before / F.col("target"), F.col("slope")
        when = (2 * part) / ((1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * part))
        return F.when((taken > 0) & (part > 0), F.floor(when * POSITION_UNITS)).when(taken > 0, F.lit(0)).cast("long")

    out = rows.withColumn("taken", taken).withColumn("position", position(F.col("before"), F.col("taken")))
    if own:
        out = out.withColumn("positions", F.array(*[position(F.col("before") + F.col("source_size") * p, n) for p, n in enumerate(passes)]))
        own.append("positions")
    return out.select("doc_id", "source", "size", "source_size", "target", "taken", "position", *own).orderBy(F.col("position").asc_nulls_last(), "doc_id")


WEIGHTS = [3, 1, 2]
SLOPES = [-0.5, 0.5, 0.0]


def op2_curriculum(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    out = mix(table(spark, folder, "documents").select("doc_id", "source", "text"), WEIGHTS, SLOPES)
    return out.select("doc_id", "size", "source_size", "target", "taken", "position")


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS turn FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][turn % 3 + 1] AS weight, [-0.5::DOUBLE, 0.5::DOUBLE, 0.0::DOUBLE][turn % 3 + 1] AS slope, source_size * 2.0::DOUBLE AS most FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(most) OVER (f ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (sum(weight) OVER (f ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level
      FROM w WINDOW f AS (ORDER BY most / weight, source NULLS LAST)),
m AS (SELECT *, first_value(CASE WHEN level * weight <= most THEN level END IGNORE NULLS) OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS flat FROM l),
t AS (SELECT source, source_size, slope, CASE WHEN flat IS NULL THEN most ELSE least(most, flat * weight) END AS target FROM m),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, t.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.digest, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, (greatest(0, least(size, floor(target)::BIGINT - before)) + greatest(0, least(size, floor(target)::BIGINT - before - source_size)))::BIGINT AS taken, before / nullif(target, 0) AS part FROM r)
SELECT doc_id, size, source_size, target, taken,
       CASE WHEN taken > 0 AND part > 0 THEN floor((2 * part) / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * part)) * 1000000000)::BIGINT WHEN taken > 0 THEN 0 END AS position
FROM k
"""
