"""What the corpus operators share: free column names, scratch tables, white space, document words."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tablewright.session import scratch_path

# The white space of the text contracts, and a word made of anything else.
WHITE = (" ", "\t", "\n", "\x0b", "\x0c", "\r")
WORD = "[^\\x20\\x09-\\x0D]+"


def col(name: str) -> Column:
    """A column by its literal name, dots included."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of the table is called so."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def whole_text(text: str) -> Column:
    return F.coalesce(col(text), F.lit(""))


def without_white(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    before = spark.conf.get(SHUFFLE_CLEANUP, None)
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLE_CLEANUP) if before is None else spark.conf.set(SHUFFLE_CLEANUP, before)


class Scratch:
    """Tables written below the shared folder; each can be dropped once its readers have run."""

    def __init__(self, spark: SparkSession, label: str, within: Scratch | None = None):
        """``within`` another one's folder, these tables go when that one is cleared."""
        self.spark = spark
        self.base = scratch_path(spark, label) if within is None else f"{within.base}/{label}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.count = 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{name}-{self.count}"
        self.count += 1
        with shuffles_removed(self.spark):
            df.write.parquet(path)
        old, self.paths[name] = self.paths.get(name), path
        if old:
            self._delete(old)
        return self.spark.read.schema(df.schema).parquet(path)

    def together(self, schema: StructType, *names: str) -> DataFrame:
        """Tables of one schema read as one."""
        return self.spark.read.schema(schema).parquet(*[self.paths[name] for name in names])

    def drop(self, *names: str) -> None:
        for name in names:
            self._delete(self.paths.pop(name))

    def clear(self) -> None:
        """Remove all tables and those of scratch folders within; nothing that reads them may run after."""
        self.paths.clear()
        self._delete(self.base)

    def _delete(self, path: str) -> None:
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(target, True)


def row_place(docs: DataFrame, name: str, scratch: Scratch) -> DataFrame:
    """The rows with a value of their own in the column ``name``, the same at every reading.

    For rows read from Parquet it is the file's hash and the row's number in it, which costs nothing; others are
    written once with a number each.
    """
    try:
        return docs.withColumn(name, F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")))
    except AnalysisException:
        return scratch.put("rows", docs.withColumn(name, F.monotonically_increasing_id()))
