"""The corpus pipeline: quality, exact copies, near copies, source mix, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again
as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm import content_sort, curriculum, jaccard, packing, quality
from tablewright.llm.common import Scratch, col, fresh, row_place, whole_text
from tablewright.plans.tables import table

QUALITY_THRESHOLD = 0.3


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject; labels of held-out ids are not learned."""
    labels = table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(~quality.held_out("doc_id", 5, 0)))
    return docs.where(quality.score(model)(whole_text("text")) >= QUALITY_THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one that exact dedup keeps."""
    return content_sort.exact_dedup(docs).where("kept").select(*map(col, docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one row: that with the smallest id, null last; of rows that share it, one.

    Rows are told apart by their places in the stage's files, so that a row is dropped for its own text and not for
    that of a namesake. Texts without words have no near copies. What the join writes on the way is removed.
    """
    row, dropped = fresh(docs, "row", "dropped")
    held, work = Scratch(spark, "near"), Scratch(spark, "jaccard")
    docs, columns = row_place(docs, row, held), docs.columns
    groups = jaccard.jaccard_groups(docs, row=row, scratch=work).where("root IS NOT NULL").select("row", "doc_id", "root")
    groups = held.put("groups", groups)
    work.clear()
    first = groups.groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "row")).alias("first")).select(F.col("first.row").alias("row"))
    groups = groups.join(first, "row", "left_anti").select(F.col("row").alias(dropped))
    return docs.join(groups, F.col(row) == F.col(dropped), "left_anti").select(*map(col, columns))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it, to the nearest whole number; each copy in order of its own pass's training position.

    Rows are told apart by their places in the stage's files: those with a null id and those that share an id are each
    taken as the mix says.
    """
    row, mixed, dues, due = fresh(docs, "row", "mixed", "dues", "due")
    docs, columns = row_place(docs, row, Scratch(spark, "rows")), docs.columns
    taken = curriculum.mix(docs, curriculum.WEIGHTS, curriculum.SLOPES, row=row)
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(0).cast("int")
    # Passes reach a row in turn, so its copies are its first passes.
    taken = taken.select(F.col("row").alias(mixed), F.slice("positions", F.lit(1), times).alias(dues)).where(F.size(dues) > 0)
    rows = docs.join(taken, F.col(row) == F.col(mixed)).withColumn(due, F.explode(dues))
    return rows.repartitionByRange(due, "doc_id").sortWithinPartitions(due, "doc_id").select(*map(col, columns))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences; a document that the mix repeats is packed as often."""
    return packing.pack(docs)


STAGES = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_copies),
    ("ngram_jaccard_join", drop_near_copies),
    ("mix_sources", mix_sources),
    ("packing", pack_sequences),
]
# A trained classifier and a tokenizer are beyond SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        docs = scratch.put(name, stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
