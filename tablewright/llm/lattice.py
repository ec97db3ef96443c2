"""Near copies of vectors by E8 lattice hashing.

Unit vectors are turned by a random rotation whose coordinates are cut into blocks of at most eight. Two vectors at the
threshold are so near in at least one block as an equal share of their squared distance, and the middle between them lies
within half of that from both. A block's points are decoded to E8, and each vector asks for all cells that come so
near to it, so that every linked pair meets in the cell of its middle. Vectors that meet are verified by their cosine
in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, col
from tablewright.llm.components import components

# Longer vectors are cut into parts of at most so many components, each rotated by itself.
PART = 128
# Cell size: two vectors' share of the distance at the threshold, over this, is one lattice unit. Below 0.89 the cells
# that come near a vector are its own and those behind the 240 shortest and the 2160 next lattice vectors.
REACH = 0.45
# A cell's name holds its block's number in these bits.
BLOCK_MASK = (1 << 16) - 1
TILE_ROWS = 1024
# Pairs whose blocks are looked at together, for vectors of up to PART dimensions, and less for longer ones.
PAIRS = 50_000
SEED = 20_177


@lru_cache(64)
def projections(dimensions: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per part its components and orthonormal random rows over them, eight a block, the last ones of a block zero where there are fewer: (blocks, components, 8).

    All blocks together are a rotation of the whole vector.
    """
    random, out = np.random.default_rng([SEED, dimensions]), []
    for own in np.array_split(np.arange(dimensions) if dimensions <= PART else random.permutation(dimensions), -(-dimensions // PART)):
        q, r = np.linalg.qr(random.standard_normal((len(own), len(own))))
        blocks = np.array_split(q * np.sign(np.diag(r)), -(-len(own) // 8), axis=1)
        out.append((own, np.stack([np.pad(block, ((0, 0), (0, 8 - block.shape[1]))) for block in blocks])))
    return out


def share(dimensions: int, threshold: float) -> float:
    """The squared distance that linked vectors don't exceed in some block."""
    # A little more, as distances are rounded.
    return (2 * (1 - threshold) + 1e-9) / sum(len(blocks) for _, blocks in projections(dimensions))


@lru_cache(1)
def neighbours() -> np.ndarray:
    """The 240 shortest vectors of E8, which lead to the cells that share a wall."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.array(out)


@lru_cache(1)
def second_neighbours() -> np.ndarray:
    """The 2160 next vectors of E8, of squared length 4: sums of two of the shortest at right angles."""
    near = neighbours()
    i, j = np.nonzero(np.rint(near @ near.T) == 0)
    return np.unique(near[i] + near[j], axis=0)


def nearest_even(x: np.ndarray) -> np.ndarray:
    """Nearest points with whole coordinates of even sum: round, and if the sum is odd round the worst the other way."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    gap = x[odd] - r[odd]
    worst = np.abs(gap).argmax(axis=1)
    r[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points: the nearer of the even points and the even points moved by one half."""
    whole, half = nearest_even(x), nearest_even(x - 0.5) + 0.5
    nearer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(nearer[:, None], half, whole)


def cell_numbers(points: np.ndarray, block: int) -> np.ndarray:
    """64-bit names of lattice points, the block in the lowest bits; a clash of names only brings in vectors that verification rejects."""
    out = np.full(points.shape[:-1], block + 1, np.uint64)
    twice = np.rint(points * 2).astype(np.int64).view(np.uint64)
    for i in range(8):
        out = (out ^ twice[..., i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return (out & ~np.uint64(BLOCK_MASK) | np.uint64(block)).view(np.int64)


def cells(unit: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``unit`` and the cells of all blocks that come as near to them as the middle of a link may lie."""
    rows, names = [], []
    scale = REACH / np.sqrt(share(unit.shape[1], threshold))
    near, far, reach = neighbours(), second_neighbours(), REACH / 2 + 1e-9
    for block, (own, projection) in enumerate((own, projection) for own, blocks in projections(unit.shape[1]) for projection in blocks):
        x = unit[:, own] @ projection * scale
        p = decode(x)
        gap = x - p
        # A cell comes so near if its wall against the own cell does, be that wall real or not.
        deep = np.flatnonzero((gap * gap).sum(axis=1) >= (1 - reach) ** 2)
        at, to = np.nonzero(gap @ near.T >= 1 - np.sqrt(2) * reach)
        at2, to2 = np.nonzero(gap[deep] @ far.T >= 2 - 2 * reach)
        for who, points in ((np.arange(len(x)), p), (at, p[at] + near[to]), (deep[at2], p[deep[at2]] + far[to2])):
            rows.append(who)
            names.append(cell_numbers(points, block))
    return np.concatenate(rows), np.concatenate(names)


def classes_of(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """Distinct valid vectors per label: ``label, vector, size`` and the smallest id as ``id``."""
    v = F.transform(col(vector), lambda x: x.cast("double"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(col(key).alias("id"), col(label).alias("label"), v.alias("v")).where(F.col("label").isNotNull() & F.col("v").isNotNull())
    rows = rows.where(finite & F.exists("v", lambda x: x != 0)).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    return rows.groupBy("label", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size"))


def packed(v: np.ndarray) -> bytes:
    """Doubles, as single precision numbers if those are the same."""
    short = v.astype(np.float32)
    return short.tobytes() if (short == v).all() else v.tobytes()


def unpacked(held: bytes, dimensions: int) -> np.ndarray:
    return np.frombuffer(held, np.float32 if len(held) == 4 * dimensions else np.float64).astype(np.float64)


def scaled(x: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which round nothing, as squares of huge or tiny components leave the range of doubles."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def unit_of(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def tile_pairs(x: np.ndarray, unit: np.ndarray, first: np.ndarray, second: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the pairs of one tile at the threshold.

    Pairs so near to it that rounding may decide are taken by the quotient of their product and the root of their
    squared lengths' product, summed in order of components.
    """
    cosine = unit[first] @ unit[second].T
    doubt = (x.shape[1] + 16) * 1e-15
    a, b = np.nonzero(cosine >= threshold - doubt)
    close = cosine[a, b] <= threshold + doubt
    a, b = first[a], second[b]
    if first is second:
        a, b, close = a[a < b], b[a < b], close[a < b]
    keep = np.ones(len(a), bool)
    due, step = np.flatnonzero(close), max(1, (1 << 21) // x.shape[1])
    for at in (due[i : i + step] for i in range(0, len(due), step)):
        y, z = x[a[at]], x[b[at]]
        product, left, right = (np.cumsum(p, axis=1)[:, -1] for p in (y * z, y * y, z * z))
        keep[at] = product / np.sqrt(left * right) >= threshold
    return a[keep], b[keep]


def counted_here(unit: np.ndarray, a: np.ndarray, b: np.ndarray, cell: np.ndarray, threshold: float) -> np.ndarray:
    """Whether the pairs' first block in which they are as near as their share has their middle in the given cell.

    That is one cell for each pair. Sums go in one order, whatever else is in the tile, so that all tiles agree.
    """
    most, held = share(unit.shape[1], threshold), projections(unit.shape[1])
    own, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    parts = []
    for components_here, blocks in held:
        part = np.zeros((len(own), len(blocks), 8))
        for i, component in enumerate(components_here):
            part += unit[own, component][:, None, None] * blocks[:, i]
        parts.append(part)
    x = np.concatenate(parts, axis=1)
    y, z = x[at[: len(a)]], x[at[len(a) :]]
    gap = y - z
    distance = np.zeros(gap.shape[:2])
    for i in range(8):
        distance += gap[:, :, i] * gap[:, :, i]
    near = distance <= most
    block = near.argmax(axis=1)
    out = near.any(axis=1) & (block == (cell & BLOCK_MASK))
    for k in np.unique(block[out]):
        due = np.flatnonzero(out & (block == k))
        out[due] = cell_numbers(decode((y[due, k] + z[due, k]) / 2 * (REACH / np.sqrt(most))), int(k)) == cell[due]
    return out


def joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots of rows once the pairs are joined too; each row's root has itself as root, before and after."""
    while True:
        x, y = root[a], root[b]
        due = x != y
        if not due.any():
            return root
        a, b, x, y = a[due], b[due], x[due], y[due]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def linked_rows(rows: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Per vector of some tiles the linked vectors counted here, and the smallest class that links counted here lead to.

    A pair may meet in several buckets. It counts in that of its middle in the first block in which it is near.
    """
    rows = rows.sort_values(["d", "bucket", "i", "j"], ignore_index=True)
    cell, part, d = rows["cell"].to_numpy(), rows["part"].to_numpy(), rows["d"].to_numpy()
    ident, size = rows["id"].to_numpy(np.int64), rows["size"].to_numpy(np.int64)
    named = rows[["bucket", "i", "j"]].to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], (named[1:] != named[:-1]).any(axis=1)]))
    i, j = rows["i"].to_numpy(), rows["j"].to_numpy()
    count, root = np.zeros(len(rows), np.int64), np.arange(len(rows))
    for dimensions in np.unique(d):
        begin, end = np.searchsorted(d, [dimensions, dimensions + 1])
        x = np.stack([unpacked(v, dimensions) for v in rows["vector"].iloc[begin:end]])
        unit = unit_of(x)
        own = starts[(starts >= begin) & (starts < end)] - begin
        found: list[tuple[np.ndarray, np.ndarray]] = []
        pairs, step = 0, max(1, PAIRS * PART // max(PART, dimensions))
        for start, stop in zip(own, [*own[1:], end - begin], strict=True):
            at = begin + start
            first = np.arange(start, stop) if i[at] == j[at] else start + np.flatnonzero(part[at : begin + stop] == i[at])
            second = first if i[at] == j[at] else start + np.flatnonzero(part[at : begin + stop] == j[at])
            found.append(tile_pairs(x, unit, first, second, threshold))
            pairs += len(found[-1][0])
            if stop < end - begin and pairs < PAIRS:
                continue
            first, second = (np.concatenate(side) for side in zip(*found, strict=True))
            found, pairs = [], 0
            for at in range(0, len(first), step):
                a, b = first[at : at + step], second[at : at + step]
                counted = counted_here(unit, a, b, cell[begin + a], threshold)
                a, b = begin + a[counted], begin + b[counted]
                np.add.at(count, a, size[b])
                np.add.at(count, b, size[a])
                root = joined(root, a, b)
    low = ident.copy()
    np.minimum.at(low, root, ident)
    linked = count > 0
    return pd.DataFrame({"id": ident[linked], "links": count[linked], "low": low[root][linked]})


def near_copies(vectors: DataFrame, threshold: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: ``vec_id, n_links, component_id, kept``.

    Vectors with equal labels that are not null link at a cosine of ``threshold`` or more. A vector that is
    null, empty or all zero or holds null or non-finite components links with nothing, and so do vectors of
    different lengths. Ids are integers. Every row counts for its own vector: rows that repeat an id and a vector, or
    have none, are copies of each other, and different vectors under one id, or under none, are judged each by
    itself. ``component_id`` is the smallest id in the component, null where all are. An empty table gives an empty
    result. All links at the threshold or above are found, and none below it.

    Equal vectors are one class, weighted by their number. Members of a cell are cut into parts of about
    ``TILE_ROWS``, and each pair of parts is one task's tile, which returns a row per linked vector, not per pair.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "lattice")
    # Classes go by numbers of their own, as ids may be null or name several vectors.
    named = scratch.put("classes", classes_of(vectors, key, vector, label).withColumnRenamed("id", "least").withColumn("id", F.monotonically_increasing_id()))
    classes = named.drop("least")

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in (batch.slice(at, 1024) for at in range(0, batch.num_rows, 1024)):
                v = rows.column("v")
                lengths, flat = v.value_lengths().to_numpy(), v.flatten().to_numpy()
                starts = np.concatenate([[0], np.cumsum(lengths)])
                for d in np.unique(lengths):
                    own = np.flatnonzero(lengths == d)
                    x = scaled(np.stack([flat[starts[i] : starts[i] + d] for i in own]))
                    who, names = cells(unit_of(x), threshold)
                    order = np.argsort(who, kind="stable")
                    bounds = np.searchsorted(who[order], np.arange(len(own) + 1))
                    yield pa.RecordBatch.from_arrays(
                        [rows.column(c).take(pa.array(own)) for c in ("id", "label", "size")]
                        + [pa.array(np.full(len(own), d, np.int32)), pa.array([packed(v) for v in x], pa.binary()), pa.ListArray.from_arrays(bounds.astype(np.int32), names[order])],
                        ["id", "label", "size", "d", "vector", "asked"])

    kind = classes.schema["label"].dataType.simpleString()
    signed = scratch.put("signed", classes.select("id", "label", "size", "v").mapInArrow(index, f"id long, label {kind}, size long, d int, vector binary, asked array<long>"))
    asked = signed.select("id", "label", "d", F.explode("asked").alias("cell"))
    buckets = asked.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Buckets go by numbers too, as a label may be of any type.
    buckets = scratch.put("buckets", buckets.select("label", "d", "cell", "n", F.ceil(F.col("n") / TILE_ROWS).alias("parts"), F.monotonically_increasing_id().alias("bucket")))
    met = asked.join(buckets.drop("n"), ["label", "d", "cell"]).withColumn("part", F.pmod(F.xxhash64("id", "cell"), F.col("parts")).cast("int"))
    # A part meets every part of its bucket, itself included; the tile is named by the two.
    dealt = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)))
    dealt = dealt.select("bucket", "cell", "d", "id", "part", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"))
    dealt = dealt.join(signed.select("id", "size", "vector"), "id")
    # Tiles are mostly small; a task's group holds several, about so many rows in all.
    total = buckets.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    dealt = dealt.withColumn("group", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(total // TILE_ROWS + 1)))
    found = dealt.groupBy("group").applyInPandas(lambda rows: linked_rows(rows, threshold), "id long, links long, low long")
    found = scratch.put("found", found.groupBy("id").agg(F.sum("links").alias("links"), F.array_distinct(F.collect_list("low")).alias("low")))
    roots = components(found.select(F.col("id").alias("a"), F.explode("low").alias("b")))
    totals = named.join(found.select("id", "links"), "id", "left").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    lowest = totals.groupBy("root").agg(F.min("least").alias("component_id"))
    totals = totals.join(lowest, "root").select("label", "v", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), "component_id")
    rows = vectors.select(col(key).alias("vec_id"), col(label).alias("label"), F.transform(col(vector), lambda x: x.cast("double") + F.lit(0.0)).alias("v"))
    out = rows.join(totals, ["label", "v"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op1_lattice(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return near_copies(table(spark, folder, "embeddings"))


OP1_SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
r(vec_id, seen) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.seen = l.a),
c AS (SELECT vec_id, min(seen) AS component_id FROM r GROUP BY vec_id)
SELECT c.vec_id, (SELECT count(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, c.vec_id = component_id AS kept FROM c
"""
