"""Benchmark decontamination by Wu-Manber multi-pattern search.

Texts become their words with a blank before, between and after them, in UTF-8; so do the test items, whose
windows of consecutive words are the patterns. Of a pattern's first m bytes (m is the least length in its
table) every block has an entry in the shift table: how far a search window that ends in this block can move
before a pattern could fit; blocks of no pattern move it furthest. Where a block moves nothing, the bucket of
this block, ordered by the patterns' first block, names the patterns to compare byte by byte. Many search
windows, one per stretch of text, move at once as numpy arrays.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.common import col, whole_text
from tablewright.plans.tables import table

# Upper case to lower case; digits, letters and bytes of other characters stay; the rest parts words.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))
WINDOW = 10
# Words of test items in one broadcast table, in bytes; more go to further tables, each with its own pass.
PART_BYTES = 8 << 20
# Patterns are searched apart by length, so that short ones don't shorten the shifts of long ones.
LENGTHS = (1, 8, 24)
SLICE_BYTES, STRETCH, MOST_PAIRS = 4 << 20, 2048, 1 << 20
MULTIPLIER, MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))])


def words_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def eights(held: np.ndarray) -> np.ndarray:
    """At every byte, it and the next seven as one number; the first byte counts least."""
    return np.ndarray(len(held) - 7, "<u8", held, strides=(1,))


def low_bytes(n: int) -> np.uint64:
    return np.uint64((1 << 8 * n) - 1)


TAILS = np.array([low_bytes(n) for n in range(9)], np.uint64)


@dataclass
class Shifts:
    """Shift table and buckets of the patterns of one length class."""

    patterns: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    m: int = 0
    block: int = 0
    bits: int = 0
    shift: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))

    def build(self, held: np.ndarray) -> Shifts:
        self.m = int(self.lengths.min())
        self.block = max(1, min(8, self.m // 3))
        last = self.m - self.block
        at = eights(held)
        self.bits = min(22, max(10, (len(self.starts) * 8).bit_length()))
        self.shift = np.full(1 << self.bits, last + 1, np.int64)
        for j in range(last + 1):  # later blocks overwrite: the least shift of a block stays
            self.shift[self.slot(at[self.starts + j] & low_bytes(self.block))] = last - j
        keys = self.key(at, self.starts)
        order = np.argsort(keys, kind="stable")
        self.keys, self.patterns, self.starts, self.lengths = keys[order], self.patterns[order], self.starts[order], self.lengths[order]
        return self

    def slot(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def key(self, at: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Bucket of the last block within m bytes, and within it the place of the first block."""
        mask = low_bytes(self.block)
        return (at[places + (self.m - self.block)] & mask) * MULTIPLIER ^ (at[places] & mask) * MIXER

    def search(self, at: np.ndarray, size: int, held: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and pattern numbers of all occurrences that start in the first ``size`` bytes."""
        here = np.arange(0, size, STRETCH)
        stop = np.minimum(here + STRETCH, size)
        last, mask, found = self.m - self.block, low_bytes(self.block), []
        while len(here):
            step = self.shift[self.slot(at[here + last] & mask)]
            still = step == 0
            if still.any():
                found.append(here[still])
            here = here + np.maximum(step, 1)
            live = here < stop
            here, stop = here[live], stop[live]
        if not found:
            return
        places = np.concatenate(found)
        keys = self.key(at, places)
        first, after = np.searchsorted(self.keys, keys, "left"), np.searchsorted(self.keys, keys, "right")
        some = after > first
        places, first, many = places[some], first[some], (after - first)[some]
        held_at, done = eights(held), 0
        while done < len(places):  # a crowded bucket is compared in portions
            until = max(done + 1, done + int(np.searchsorted(np.cumsum(many[done:]), MOST_PAIRS, "right")))
            n = many[done:until]
            before = np.cumsum(n) - n
            own = np.repeat(first[done:until] - before, n) + np.arange(n.sum())
            place = np.repeat(places[done:until], n)
            done = until
            for offset in range(0, int(self.lengths.max()), 8):
                left = np.clip(self.lengths[own] - offset, 0, 8)
                same = (at[place + offset * (left > 0)] ^ held_at[self.starts[own] + offset * (left > 0)]) & TAILS[left] == 0
                own, place = own[same], place[same]
                if not len(own):
                    break
            yield place, self.patterns[own]


class Part:
    """Patterns of a bounded part of the test items, ready to search."""

    def __init__(self, pieces: list[tuple[str | None, list[bytes]]], window: int):
        names = sorted({name for name, _ in pieces if name is not None})
        number = {name: i for i, name in enumerate(names)}
        known: dict[bytes, int] = {}
        starts: list[int] = []
        pairs: set[tuple[int, int]] = set()
        size = 0
        for name, words in pieces:
            ends = np.cumsum([len(w) + 1 for w in words]).tolist()
            for i in range(max(1, len(words) - window + 1)):
                held = b" ".join(words[i : i + window])
                k = known.setdefault(held, len(known))
                if k == len(starts):
                    starts.append(size + (ends[i - 1] if i else 0))
                if name is not None:
                    pairs.add((k, number[name]))
            size += ends[-1] + 1
        self.names = names
        self.held = np.frombuffer(b"".join(b" " + b" ".join(words) + b" " for _, words in pieces) + bytes(16), np.uint8)
        lengths = np.array([len(w) + 2 for w in known], np.int64)
        own = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.items, self.item_starts = own[:, 1], np.searchsorted(own[:, 0], np.arange(len(known) + 1))
        self.lengths = lengths
        self.classes = []
        for low, high in zip(LENGTHS, (*LENGTHS[1:], 1 << 62), strict=True):
            mine = np.flatnonzero((lengths >= low) & (lengths < high))
            if len(mine):
                self.classes.append(Shifts(mine, np.array(starts, np.int64)[mine], lengths[mine]).build(self.held))

    def judge(self, texts: list[bytes]) -> list[tuple[int, list, list]]:
        """Per text its number of words, the stretches of words that lie in occurrences, and the items' names."""
        split = [words_of(t) for t in texts]
        counts = [len(w) for w in split]
        if not self.classes:
            return [(n, [], []) for n in counts]
        joined = [b" ".join([b"", *w, b""]) for w in split]
        text = np.frombuffer(b"\0".join(joined) + bytes(int(self.lengths.max()) + 24), np.uint8)
        size = len(text) - int(self.lengths.max()) - 24
        at = eights(text)
        found = [hit for c in self.classes for hit in c.search(at, size, self.held)]
        out: list[tuple[int, list, list]] = [(n, [], []) for n in counts]
        place = np.concatenate([p for p, _ in found]) if found else np.zeros(0, np.int64)
        if not len(place):
            return out
        pattern = np.concatenate([k for _, k in found])
        # Word numbers are those of the blank before; a text has one blank more than words.
        blanks = np.flatnonzero(text[:size] == 32)
        first, after = np.searchsorted(blanks, place), np.searchsorted(blanks, place + self.lengths[pattern] - 1)
        edge = np.bincount(first, minlength=len(blanks) + 1) - np.bincount(after, minlength=len(blanks) + 1)
        inside = np.diff((np.cumsum(edge) > 0).astype(np.int8), prepend=0)
        starts, stops = np.flatnonzero(inside > 0), np.flatnonzero(inside < 0)
        bases = np.concatenate([[0], np.cumsum(np.array(counts) + 1)])
        for d, a, b in zip((np.searchsorted(bases, starts, "right") - 1).tolist(), starts.tolist(), stops.tolist(), strict=True):
            out[d][1].append((a - int(bases[d]), b - int(bases[d])))
        doc = np.searchsorted(bases, first, "right") - 1
        seen = np.unique(np.stack([doc, pattern]), axis=1)
        many = np.diff(self.item_starts)[seen[1]]
        own = np.repeat(self.item_starts[seen[1]] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        for d, i in np.unique(np.stack([np.repeat(seen[0], many), self.items[own]]), axis=1).T.tolist():
            out[d][2].append(self.names[i])
        return out


def parts_of(items: DataFrame, item_id: str, text: str, window: int, part_bytes: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Names and words of the items, long items in overlapping pieces, in parts of bounded size."""
    part, size, step = [], 0, max(1, part_bytes // 8)
    for row in items.select(col(item_id).cast("string").alias("name"), whole_text(text).alias("text")).toLocalIterator():
        words = words_of(row["text"].encode())
        for i in range(0, max(1, len(words) - window + 1) if words else 0, step):
            piece = words[i : i + step + window - 1]
            part.append((row["name"], piece))
            size += sum(map(len, piece)) + len(piece)
            if size >= part_bytes:
                yield part
                part, size = [], 0
    if part:
        yield part


def searched(rows: DataFrame, part: Part) -> DataFrame:
    """The rows with what their texts hold of the part's items, instead of the texts."""
    held = rows.sparkSession.sparkContext.broadcast(part)

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some, size = [], [], 0
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                some.append(t)
                size += len(t)
                if size >= SLICE_BYTES:
                    out += held.value.judge(some)
                    some, size = [], 0
            out += held.value.judge(some) if some else []
            rest = batch.select([c for c in batch.schema.names if c != "text"])
            spans = pa.array([[{"start": a, "stop": b} for a, b in spans] for _, spans, _ in out], to_arrow_type(SPANS))
            columns = [*rest.columns, pa.array([n for n, _, _ in out], pa.int64()), spans, pa.array([names for _, _, names in out], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*rest.schema.names, *RESULT.names])

    return rows.mapInArrow(judged, T.StructType([*(f for f in rows.schema if f.name != "text"), *RESULT]))


@F.arrow_udf(SPANS)
def merged(lists: pa.Array) -> pa.Array:
    out = []
    for spans in lists.to_pylist():
        row: list[dict] = []
        for s in sorted(spans or [], key=lambda x: x["start"]):
            if row and s["start"] <= row[-1]["stop"]:
                row[-1]["stop"] = max(row[-1]["stop"], s["stop"])
            else:
                row.append(s)
        out.append(row)
    return pa.array(out, to_arrow_type(SPANS))


def find_passages(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part_bytes: int = PART_BYTES,
) -> DataFrame:
    """Per row of ``docs`` its id, number of words, the stretches of words inside passages of items, and the items' ids.

    Words are runs of digits, letters and characters beyond ASCII, A-Z in lower case. A passage is ``window``
    consecutive words of an item; an item of fewer words, but not none, is one passage. ``spans`` are word numbers
    from 0, the stop exclusive, in order, apart from each other; ``items`` are distinct, sorted as strings.

    Null texts have no words. Rows with one id are judged each for its own text, null ids like others. Items with a
    null id mark words but are not named; items that share an id are one. No items, or none with words: no spans.
    Other columns are ignored. Whole texts are read: a task holds a few copies of its longest text. The items go to
    the tasks as broadcast tables of at most ``part_bytes`` of words each; the driver holds one at a time. With
    several tables every one has its own pass over the texts, and hits, not texts, are shuffled to be united.
    """
    rows = docs.select(col(doc_id).alias("doc_id"), whole_text(text).alias("text"))
    # Rows alike in id and text have the same hits, so these two tell the rows of several passes apart.
    told = rows.withColumn("digest", F.md5("text"))
    held = parts_of(items, item_id, item_text, window, part_bytes)
    first, second = Part(next(held, []), window), next(held, None)
    if second is None:
        return searched(rows, first)
    passes = [searched(told, first), searched(told, Part(second, window)), *(searched(told, Part(p, window)) for p in held)]
    hits = passes[0].where(F.size("spans") > 0)
    for p in passes[1:]:
        hits = hits.unionAll(p.where(F.size("spans") > 0))
    hits = hits.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("key")).agg(F.flatten(F.collect_set("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    joined = passes[0].select("doc_id", "digest", "n_words").join(hits, F.expr("digest = key AND doc_id <=> id"), "left")
    return joined.select("doc_id", "n_words", merged("spans").alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def op12_wu_manber(spark: SparkSession, folder: str) -> DataFrame:
    found = find_passages(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


OP12_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
k AS (SELECT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda p: array_to_string(w[p:p + least(len(w), 10) - 1], ' '))) AS g FROM i WHERE len(w) > 0),
s AS (SELECT r, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: {'p': p, 'g': array_to_string(w[p:p + n - 1], ' ')})) AS x FROM d, (SELECT DISTINCT n FROM k) WHERE len(w) >= n),
h AS (SELECT DISTINCT s.r, s.n, s.x.p AS p, k.item_id FROM s JOIN k ON s.n = k.n AND s.x.g = k.g),
c AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM h) GROUP BY r),
m AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN m USING (r)
"""
