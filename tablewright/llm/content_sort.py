"""Exact dedup by content sort.

Normalised texts are range-partitioned by sampled splitters, sorted externally so that equal texts lie
next to each other, and neighbours are compared over their whole length. Built from DataFrame functions
alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import col, fresh, whole_text, without_white

# A text is hot when it makes up this share of the sampled rows; so at most 1,000 texts are hot.
HOT_SHARE = 0.001
SAMPLE_ROWS = 20_000
# Characters of the sort key that the driver sees when it draws splitters.
SPLITTER_CHARS = 16


def exact_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with ``keep_id``, ``group_size``, ``kept`` and ``text_sha256``.

    Texts are equal when identical after deleting blanks, tabs, line breaks, vertical tabs and form feeds.
    Of equal texts the row with the most code points in its own text, then the smallest key, stays; a null
    key is the largest. A null text is an empty one, so null, empty and blank texts are one group. Rows that
    repeat a key and a text count each in ``group_size``, and exactly one of them stays. An empty table
    gives an empty result. Input columns called like one of the four new ones are replaced.

    Splitters are the first characters and a hash of a text, never the whole text, so what the driver
    samples is small; the sort and the comparison use whole texts. A sample of about 20,000 rows shows
    which texts are hot. That decides how a text travels, not what is returned: copies of a hot text are
    counted before the shuffle and get their result by a broadcast of at most 1,000 rows.
    """
    new = ["keep_id", "group_size", "kept", "text_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c.lower() in new])
    chars, digest, start, norm, rank, best, salt = fresh(docs, "chars", "digest", "start", "norm", "rank", "best", "salt")
    names = docs.columns
    stripped = without_white(whole_text(text))
    rows = docs.withColumn(norm, stripped).withColumn(chars, F.char_length(whole_text(text))).withColumn(digest, F.xxhash64(norm))

    every = max(1, docs.count() // SAMPLE_ROWS)
    sample = rows.where(F.pmod(F.xxhash64(col(key)), F.lit(every)) == 0).groupBy(digest).count()
    seen = sample.agg(F.sum("count")).first()[0] or 0
    hot = [r[0] for r in sample.where(F.col("count") >= max(20, seen * HOT_SHARE)).select(digest).collect()]

    cold = rows.where(~F.col(digest).isin(hot)) if hot else rows
    laid = cold.withColumn(start, F.left(norm, F.lit(SPLITTER_CHARS))).drop(norm).repartitionByRange(start, digest).withColumn(norm, stripped)
    equal = Window.partitionBy(start, digest, norm).orderBy(F.desc(chars), col(key).asc_nulls_last())
    whole = equal.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = laid.select(
        *map(col, names), F.first(col(key)).over(whole).alias("keep_id"), F.count(F.lit(1)).over(whole).alias("group_size"),
        (F.row_number().over(equal) == 1).alias("kept"), F.sha2(norm, 256).alias("text_sha256"),
    )
    if not hot:
        return out

    copies = rows.where(F.col(digest).isin(hot))
    counted = copies.groupBy(norm, chars).agg(F.count(F.lit(1)).alias("n"), F.min(col(key)).alias("id"))
    order = Window.partitionBy(norm).orderBy(F.desc(chars))
    totals = counted.select(
        F.sha2(norm, 256).alias("text_sha256"), F.col("id").alias("keep_id"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("group_size"),
        F.col(chars).alias(best), F.row_number().over(order).alias(rank),
    ).where(F.col(rank) == 1).drop(rank)
    joined = copies.withColumn("text_sha256", F.sha2(norm, 256)).join(F.broadcast(totals), "text_sha256")
    joined = joined.withColumn(best, (F.col(chars) == F.col(best)) & col(key).eqNullSafe(F.col("keep_id")))
    # Only rows that repeat the staying row need an order; all others are spread by their key.
    joined = joined.withColumn(salt, F.when(F.col(best), F.lit(None)).otherwise(F.xxhash64(col(key))))
    nth = F.row_number().over(Window.partitionBy("text_sha256", best, salt).orderBy(col(key)))
    return out.unionByName(joined.select(*map(col, names), "keep_id", "group_size", (F.col(best) & (nth == 1)).alias("kept"), "text_sha256"))


def op5_content_sort(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t ORDER BY chars DESC, doc_id NULLS LAST)
"""
