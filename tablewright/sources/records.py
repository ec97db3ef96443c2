"""Quoted records of large text files, read block by block, with strict quotes.

A line is read by an automaton that stands outside quotes or within them when the line begins. Cut at its quotes, a
line falls into pieces that are outside and within in turn, so for either beginning it tells where it ends (by the
number of quotes) and whether it is well formed: a piece outside, between two quotes, is empty, which is an escaped
quote, or goes from one delimiter to another; the first one ends and the last one begins with a delimiter. Each block
adds up its lines; one small row per block then tells how the block begins. No task sees more than a block of lines,
and only records that really span lines are put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.functions.values import fail

QUOTE = '"'
STRAY = ("file.quotes", "a quote stands inside an unquoted value, or text follows a closing quote")
UNCLOSED = ("file.quotes", "a file ends inside a quoted value")
BROKEN = ("file.line_break", "a quoted value holds a line break")


def _fail_if(condition: Column, text: tuple[str, str], otherwise: Column, kind: str) -> Column:
    return F.when(condition, fail(*text).cast(kind)).otherwise(otherwise)


def _ill_formed(value: Column, delimiter: str, within: Column) -> Column:
    """Whether a line, which begins within quotes or not, has a quote where none may stand."""
    pieces = F.split(F.rtrim(value, F.lit("\r")), QUOTE)
    last = F.size(pieces) - 1

    def wrong(piece: Column, i: Column) -> Column:
        opens = (i == 0) | (piece == "") | piece.startswith(delimiter)
        closes = (i == last) | (piece == "") | piece.endswith(delimiter)
        return (i % 2 == within.cast("int")) & ~(opens & closes)

    return F.exists(F.zip_with(pieces, F.sequence(F.lit(0), last), wrong), lambda x: x)


def quoted_records(spark: SparkSession, path: str | list[str], delimiter: str = ",", embedded_newlines: bool = True) -> DataFrame:
    """One row per record: ``record`` (line breaks inside quotes kept) and ``head``, set on the first record of each file.

    Blank lines are skipped. Reading fails on a quote inside an unquoted value, on text after a closing quote, on a
    file that ends within quotes and, without ``embedded_newlines``, on a value that holds a line break.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"),
    )
    # Both uses below read this one exchange: lines are numbered and dealt once, and no copy outlives the job.
    lines = lines.repartition("file", "block")
    lines = lines.withColumn("odd", (F.char_length("value") - F.char_length(F.replace("value", F.lit(QUOTE), F.lit("")))) % 2)
    in_block = Window.partitionBy("file", "block").orderBy("line")
    counted = lines.withColumn("upto", F.sum("odd").over(in_block.rowsBetween(Window.unboundedPreceding, 0)))
    counted = counted.withColumn("before", F.col("upto") - F.col("odd"))
    # What a block passes on, for either way it may begin.
    blocks = counted.groupBy("file", "block").agg(
        F.sum("odd").alias("quotes"),
        F.min("line").alias("first_line"),
        F.max(F.when(F.col("before") % 2 == 0, F.col("line"))).alias("start_if_closed"),
        F.max(F.when(F.col("before") % 2 == 1, F.col("line"))).alias("start_if_open"),
    )
    order = Window.partitionBy("file").orderBy("block")
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    entered = blocks.select("*", (F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2).alias("entry"), F.lead("block").over(order).alias("next"))
    unclosed = F.col("next").isNull() & ((F.col("entry") + F.col("quotes")) % 2 == 1)
    entered = entered.withColumn("open", _fail_if(unclosed, UNCLOSED, F.col("entry"), "bigint"))
    last_start = F.when(F.col("entry") == 0, F.col("start_if_closed")).otherwise(F.col("start_if_open"))
    started = entered.withColumn("mine", F.when(last_start.isNotNull(), F.struct("block", last_start.alias("line"))))
    entry = started.select(
        F.col("file").alias("e_file"), F.col("block").alias("e_block"), "open", "first_line",
        F.last("mine", ignorenulls=True).over(earlier).alias("pending"),
    )
    placed = counted.join(entry, (F.col("file") == F.col("e_file")) & (F.col("block") == F.col("e_block")))
    starts = (F.col("open") + F.col("before")) % 2 == 0
    ends = (F.col("open") + F.col("upto")) % 2 == 0
    stray = F.when(F.col("value").contains(QUOTE), _ill_formed(F.col("value"), delimiter, ~starts)).otherwise(False)
    whole = _fail_if(stray, STRAY, starts & ends, "boolean")
    if not embedded_newlines:
        whole = _fail_if(~(starts & ends), BROKEN, whole, "boolean")
    own = F.max(F.when(starts, F.col("line"))).over(in_block.rowsBetween(Window.unboundedPreceding, 0))
    marked = placed.select(
        "value", "file", "block", "line",
        whole.alias("whole"),
        (starts & (F.col("block") == 0) & (F.col("line") == F.col("first_line"))).alias("head"),
        F.when(own.isNotNull(), F.struct("block", own.alias("line"))).otherwise(F.col("pending")).alias("start"),
    )
    records = marked.where("whole").select(F.rtrim("value", F.lit("\r")).alias("record"), "head").where("record <> '' OR head")
    if embedded_newlines:
        spanning = (
            marked.where("NOT whole")
            .groupBy("file", "start")
            .agg(F.sort_array(F.collect_list(F.struct("block", "line", "value"))).alias("parts"), F.max("head").alias("head"))
            .select(F.rtrim(F.array_join("parts.value", "\n"), F.lit("\r")).alias("record"), "head")
        )
        records = records.union(spanning)
    return records.withColumn("record", F.when(F.col("head"), F.ltrim("record", F.lit("﻿"))).otherwise(F.col("record")))
