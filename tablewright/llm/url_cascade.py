"""URL rules looked up in a Bloom filter cascade, with DataFrame functions alone.

The first level encodes the listed keys; each further level encodes what the level before let through
wrongly, alternately keys of the corpus that are not listed and keys that are. Built over every key the
corpus can ask for, the cascade answers each of them exactly, and no lookup is a join.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, col

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The filters travel as literals: a list of this many keys makes a first level of about 4 MB at the most.
MAX_LISTED = 1_000_000
MAX_BITS = 1 << 26


@dataclass(frozen=True)
class Level:
    number: int
    bits: int
    hashes: int
    words: bytes

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(key, F.lit(self.number * 64 + j)), F.lit(self.bits)) for j in range(self.hashes)]

    def holds(self, key: Column) -> Column:
        words = F.lit(self.words)
        at = lambda p: F.conv(F.hex(F.substring(words, F.floor(p / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        tests = [F.getbit(at(p), F.pmod(p, F.lit(8)).cast("int")) == 1 for p in self.positions(key)]
        out = tests[0]
        for t in tests[1:]:
            out = out & t
        return out


def encode(keys: DataFrame, number: int, size: int, rate: float) -> Level:
    """One level over ``size`` keys that lets other keys through at about the given rate."""
    bits = max(64, math.ceil(size * -math.log(rate) / math.log(2) ** 2))
    if bits > MAX_BITS:
        raise ValueError(f"a filter of {bits} bits is above the limit of {MAX_BITS}; split the list by a hash of its keys")
    level = Level(number, bits, max(1, round(-math.log2(rate))), b"")
    set_bits = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    filled = set_bits.groupBy(F.floor(F.col("p") / 8).alias("byte")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1), F.pmod("p", F.lit(8)).cast("int"))).alias("bits"))
    words = bytearray((bits + 7) // 8)
    for byte, value in filled.collect():
        words[byte] = value
    return Level(number, bits, level.hashes, bytes(words))


def build_cascade(listed: DataFrame, universe: DataFrame, max_levels: int = 64) -> list[Level]:
    """Levels that tell the ``listed`` keys from all others in ``universe`` (one column, ``key``, each).

    The first level's rate is chosen so that about as many foreign keys pass as keys are listed, so every
    later level, at rate one half, is smaller than the list however large the universe is.
    """
    spark = listed.sparkSession
    scratch = Scratch(spark, "cascade")
    inside = scratch.put("inside", listed.where(F.col("key").isNotNull()).distinct())
    n_inside, n_all = inside.count(), universe.count()
    if n_inside > MAX_LISTED:
        raise ValueError(f"{n_inside} listed keys; split the list by a hash of its keys")
    if n_inside == 0:
        return []
    first = min(0.5, n_inside * math.sqrt(0.5) / max(1, n_all))
    levels = [encode(inside, 0, n_inside, first)]
    outside = scratch.put("outside", universe.where(levels[0].holds(F.col("key"))).join(F.broadcast(inside), "key", "left_anti"))
    held, other, size = inside, outside, outside.count()
    names = ["inside", "outside"]
    while size and len(levels) < max_levels:
        levels.append(encode(other, len(levels), size, 0.5))
        # What the newest level lets through of the keys it doesn't encode needs the next level.
        held, other = other, scratch.put(names[(len(levels) - 1) % 2 == 0], held.where(levels[-1].holds(F.col("key"))))
        size = other.count()
    if size:
        raise RuntimeError("the cascade did not end; use other hash functions")
    scratch.drop("inside", "outside")
    return levels


def member(levels: list[Level], key: Column) -> Column:
    """Whether a key of the universe is listed: the number of levels it passes is odd."""
    out = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        out = F.when(~levels[i].holds(key), F.lit(i % 2 == 1)).otherwise(out)
    return out


def host_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*", 0))
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    found = F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))
    return F.coalesce(found, F.lit(""))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: ``page_id``, ``host``, ``path``, ``rule``, ``verdict``.

    ``rules`` are (verdict, host, path prefix). A rule fits its host and the hosts below it when the path
    starts with its prefix; of several the longest host and prefix together win, ``block`` before ``allow``
    if a key is in both lists. ``rule`` is the winning host and prefix, null if none fits, and the verdict
    is then ``default``: a URL that no list holds. A null URL or one without ``://`` has an empty host and
    path and fits no rule. Repeated pages give repeated rows; an empty table gives an empty result.

    A page asks for one key per host suffix and prefix length that occur among the rules, so the key
    universe is bounded by the pages; it is made distinct before it is counted.
    """
    spark = pages.sparkSession
    rows = pages.select(col(key).alias("page_id"), host_of(col(url)).alias("host"), path_of(col(url)).alias("path"))
    depth = max((h.count(".") + 1 for _, h, _ in rules), default=0)
    lengths = sorted({len(p) for _, _, p in rules})
    labels = F.split("host", "\\.")
    options = []
    for d in range(1, depth + 1):
        suffix = F.when((F.col("host") != "") & (F.size(labels) >= d), F.array_join(F.slice(labels, -d, d), "."))
        options += [F.when(F.char_length("path") >= n, F.concat(suffix, F.left(F.col("path"), F.lit(n)))) for n in lengths]
    if not options:
        return rows.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit(default))
    asked = rows.withColumn("asked", F.array_compact(F.array(*options)))
    universe = Scratch(spark, "urls").put("keys", asked.select(F.explode("asked").alias("key")).distinct())

    def cascade(verdict: str) -> list[Level]:
        keys = [h + p for v, h, p in rules if v == verdict]
        return build_cascade(spark.range(1).select(F.explode(F.array(*map(F.lit, keys))).alias("key")), universe) if keys else []

    block, allow = cascade("block"), cascade("allow")
    found = asked
    for name, levels in (("blocked", block), ("allowed", allow)):
        hits = F.filter("asked", partial(member, levels))
        longest = F.aggregate(hits, F.lit(""), lambda best, k: F.when(F.char_length(k) > F.char_length(best), k).otherwise(best))
        found = found.withColumn(name, longest)
    blocks = F.char_length("blocked") >= F.char_length("allowed")
    rule = F.when(blocks, F.col("blocked")).otherwise(F.col("allowed"))
    verdict = F.when(rule == "", F.lit(default)).when(blocks, F.lit("block")).otherwise(F.lit("allow"))
    return found.select("page_id", "host", "path", F.nullif(rule, F.lit("")).alias("rule"), verdict.alias("verdict"))


# The rules of the query.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def op7_url_cascade(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return judge_urls(table(spark, folder, "pages").select("page_id", "url"), RULES)


OP7_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(verdict, rhost, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (SELECT h.page_id, h.host, h.path, r.rhost || r.prefix AS rule, r.verdict,
             row_number() OVER (PARTITION BY h.page_id ORDER BY length(r.rhost || r.prefix) DESC NULLS LAST, r.verdict DESC) AS n
      FROM h LEFT JOIN r ON (h.host = r.rhost OR ends_with(h.host, '.' || r.rhost)) AND starts_with(h.path, r.prefix))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1
"""
