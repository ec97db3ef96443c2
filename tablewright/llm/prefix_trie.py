"""Prefix trie of conversations from sorted sequences, their common prefixes and range minima.

Turns become digests, conversations sequences of digests. Sorted, all conversations that start alike stand
together, and how many turns neighbours share tells where a prefix ends: its members reach left and right as
far as every number between is at least its depth. A sparse table holds the minima of all stretches of 2^k
neighbours, and each candidate prefix finds its left and its right end by binary search in it. What a node
needs of its members and of its subtree are sums over that interval.

The sorted sequences lie in blocks, one per task. A block knows the last sequence before it and the first
after it; nodes that reach over an edge give one partial row per block, and only those rows are grouped.
Long conversations are cut into pieces: a later piece is sorted below the fingerprint of all turns before it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, col
from tablewright.operators.sort import number_rows
from tablewright.plans.tables import table

# Turns of one piece, sequences of one block, conversation ids that one row of ends can hold.
PIECE, BLOCK_ROWS, END_BITS = 512, 20_000, 16
NO_ROOT = "0" * 32
PLACE = ["piece", "root", "path"]
SUMS = ["n_convs", "n_children", "n_leaves", "saved"]
NODE = "key string, depth long, conv_id long, parent_key string, parent_conv long, n_convs long, n_children long, n_leaves long, saved long, ends string"
NEW = "conv_id long, piece long, new_bytes long, leaves long"


@dataclass
class Trie:
    """``nodes``: one row per distinct prefix; ``ends``: per node the conversations that are it, in sorted blocks of ids."""

    nodes: DataFrame
    ends: DataFrame


def digested(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv, turn, digest, bytes`` per turn: digest of role and text, bytes of the text; a null role or text is empty.

    Rows without a conversation id are left out: they belong to no conversation.
    """
    who, said = F.coalesce(col(role), F.lit("")), F.coalesce(col(text), F.lit(""))
    digest = F.md5(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who, said))
    return conversations.select(col(conv_id).cast("long").alias("conv"), col(turn).alias("turn"), digest.alias("digest"), F.octet_length(said).cast("long").alias("bytes")).where("conv IS NOT NULL")


def placed(turns: DataFrame) -> DataFrame:
    """``conv, pos, digest, bytes``: positions from 0 by turn, null first, equal turns by digest. Runs a job.

    Rows are numbered in the order of the whole table, so that a conversation of any length is spread over tasks.
    """
    ordered = turns.orderBy("conv", F.col("turn").asc_nulls_first(), "digest").select("conv", "digest", "bytes")
    rows = number_rows(ordered, "number")
    first = rows.groupBy(F.col("conv").alias("of")).agg(F.min("number").alias("first"))
    return rows.join(first, F.col("conv") == F.col("of")).select("conv", (F.col("number") - F.col("first")).alias("pos"), "digest", "bytes")


def bits(value: Column) -> Column:
    return F.lpad(F.hex(value), 16, "0")


def pieces_of(turns: DataFrame, ids: DataFrame, piece: int) -> DataFrame:
    """A row per conversation and piece: its place in the sorted order and what of the conversation comes later."""
    cut = turns.groupBy("conv", F.floor(F.col("pos") / piece).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "bytes"))).alias("t"))
    cut = cut.select("conv", "piece", F.unhex(F.array_join("t.digest", "")).alias("path"), F.col("t.bytes").alias("sizes"))
    silent = ids.join(turns.select("conv").distinct(), "conv", "left_anti")
    cut = cut.unionByName(silent.select("conv", F.lit(0).cast("long").alias("piece"), F.lit(b"").alias("path"), F.array().cast("array<bigint>").alias("sizes")))
    cut = cut.withColumn("digest", F.md5("path"))
    own = Window.partitionBy("conv").orderBy("piece")
    before, after = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(1, Window.unboundedFollowing)
    marks = [F.xxhash64("piece", "digest"), F.xxhash64("digest", "piece")]
    total = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)
    cut = cut.withColumns({"x": marks[0], "y": marks[1], "total": total})
    cut = cut.withColumns({"u": F.coalesce(F.bit_xor("x").over(before), F.lit(0)), "v": F.coalesce(F.bit_xor("y").over(before), F.lit(0)), "later_bytes": F.coalesce(F.sum("total").over(after), F.lit(0)), "last": F.lead("piece").over(own).isNull()})
    root, below = F.concat(bits("u"), bits("v")), F.concat(bits(F.col("u").bitwiseXOR(F.col("x"))), bits(F.col("v").bitwiseXOR(F.col("y"))))
    cut = cut.select("conv", "piece", root.alias("root"), below.alias("below"), "path", "sizes", "later_bytes", "last", F.md5(F.concat(F.col("piece").cast("string"), F.lit("/"), root, F.col("digest"))).alias("cls"))
    return cut


def in_blocks(scratch: Scratch, name: str, rows: DataFrame) -> DataFrame:
    """The rows in sorted blocks, each with the row before it and the row after it, marked -1 and 1. Runs jobs."""
    rows = scratch.put(f"{name}-in", rows)
    blocks = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    held = scratch.put(name, rows.repartitionByRange(blocks, *PLACE).withColumn("block", F.spark_partition_id()))
    scratch.drop(f"{name}-in")
    place = F.struct(*PLACE, "sizes")
    # One row per block goes through a window of its own.
    edges = held.groupBy("block").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    order = Window.orderBy("block")
    edges = edges.select("block", F.lag("high").over(order).alias("left"), F.lead("low").over(order).alias("right"))
    out = held.withColumn("side", F.lit(0))
    for side, name in ((-1, "left"), (1, "right")):
        out = out.unionByName(edges.where(f"{name} IS NOT NULL").select("block", f"{name}.*", F.lit(side).alias("side")), allowMissingColumns=True)
    return out


class Block:
    """Sorted sequences of one block between those next to it."""

    def __init__(self, rows: pa.Table):
        rows = rows.sort_by([(c, "ascending") for c in PLACE])
        self.rows = rows
        side = rows["side"].to_numpy()
        self.low, self.high = int((side < 0).sum()), len(side) - int((side > 0).sum()) - 1
        self.piece = rows["piece"].to_numpy()
        self.paths = rows["path"].to_pylist()
        self.lengths = np.array([len(p) // 16 for p in self.paths], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.concatenate([[0], np.cumsum(rows["sizes"].combine_chunks().flatten().to_numpy())]).astype(np.int64)
        self.shared = self.common(rows["root"].to_pylist())
        self.n, self.ended = self.numbers("n"), self.numbers("n_end")
        self.total = self.head(np.arange(len(side)), self.lengths)
        real = side == 0
        # What a sequence adds to the trie: turns that it does not share with the one before.
        self.new = np.where(real, self.total - self.head(np.arange(len(side)), np.maximum(self.shared, 0)), 0)
        extended = np.append(self.shared[1:] >= self.lengths[:-1], False)
        self.leaf = (real & (self.n == self.ended) & ~extended).astype(np.int64)

    def numbers(self, name: str) -> np.ndarray:
        return self.rows[name].combine_chunks().fill_null(0).to_numpy()

    def head(self, row: np.ndarray, turns: np.ndarray) -> np.ndarray:
        """Bytes of a row's first turns."""
        return self.bytes[self.starts[row] + turns] - self.bytes[self.starts[row]]

    def common(self, roots: list[str]) -> np.ndarray:
        """Turns that each sequence shares with the one before; -1 where that starts elsewhere."""
        turns = np.frombuffer(b"".join(self.paths), "<u8").reshape(-1, 2)
        alike = np.array([False] + [a == b for a, b in zip(roots[1:], roots, strict=False)]) & np.concatenate([[False], self.piece[1:] == self.piece[:-1]])
        most = np.where(alike, np.minimum(self.lengths, np.concatenate([[0], self.lengths[:-1]])), 0)
        edge = np.cumsum(most)
        own = np.arange(edge[-1]) - np.repeat(edge - most, most)
        here = np.repeat(self.starts, most) + own
        there = np.repeat(np.concatenate([[0], self.starts[:-1]]), most) + own
        differ = np.append(np.flatnonzero((turns[here] != turns[there]).any(axis=1)), edge[-1])
        first = differ[np.searchsorted(differ, edge - most)] - (edge - most)
        return np.where(alike, np.minimum(first, most), -1)


def minima(values: np.ndarray) -> list[np.ndarray]:
    """Sparse table: at level k the least of the 2^k values from each place on."""
    out, step = [values], 1
    while 2 * step <= len(values):
        out.append(np.minimum(out[-1][:-step], out[-1][step:]))
        step *= 2
    return out


def extents(sparse: list[np.ndarray], row: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last row around ``row`` that share ``depth`` turns with it; each end by binary search of its own."""
    size, left, right = len(sparse[0]), row.copy(), row.copy()
    for k in range(len(sparse) - 1, -1, -1):
        least, step = sparse[k], 1 << k
        go = right + step < size
        go[go] = least[right[go] + 1] >= depth[go]
        right[go] += step
    for k in range(len(sparse) - 1, -1, -1):
        least, step = sparse[k], 1 << k
        go = left - step >= 0
        go[go] = least[left[go] - step + 1] >= depth[go]
        left[go] -= step
    return left, right


def new_parts(rows: pa.Table) -> pa.Table:
    """What each class of a later piece adds to the trie, under the smallest conversation in it."""
    block = Block(rows)
    real = slice(block.low, block.high + 1)
    return pa.table({"conv_id": block.rows["conv_id"][real], "piece": block.piece[real], "new_bytes": block.new[real], "leaves": block.leaf[real]})


def nodes_of(piece: int):
    def nodes(rows: pa.Table) -> pa.Table:
        b = Block(rows)
        low, high = b.low, b.high
        shared = b.shared
        # A row is a candidate for the prefixes that start with it, the block's first row also for those from before.
        since = np.maximum(shared[low : high + 1], -1) + 1
        since[0] = 0
        many = b.lengths[low : high + 1] - since + 1
        row = np.repeat(np.arange(low, high + 1), many)
        depth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many) + np.repeat(since, many)
        own = depth > shared[row]
        sparse = minima(shared)
        left, right = extents(sparse, row, depth)
        up_left, up_right = extents(sparse, row, np.maximum(depth - 1, 0))
        open_, up_open = (left < low) | (right > high), (up_left < low) | (up_right > high)
        left, right, up_left, up_right = (np.clip(x, low, high) for x in (left, right, up_left, up_right))

        def total(values: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(values)])
            return sums[right + 1] - sums[left]

        ids = minima(b.numbers("conv_id"))

        def smallest(a: np.ndarray, z: np.ndarray) -> np.ndarray:
            k = np.frexp((z - a + 1).astype(float))[1] - 1
            out = np.empty(len(a), np.int64)
            for level in np.unique(k):
                at = k == level
                out[at] = np.minimum(ids[level][a[at]], ids[level][z[at] - (1 << int(level)) + 1])
            return out

        n = total(b.n)
        before = b.head(row, np.maximum(depth - 1, 0))
        said = total(b.n * b.total + b.numbers("later_bytes")) - before * n
        kept = total(b.new + b.numbers("later_new")) + np.where(own, b.total[row] - before - b.new[row], 0)
        # A neighbour that shares just this depth opens one more child.
        order = np.sort(shared * (len(shared) + 1) + np.arange(len(shared)))
        base = depth * (len(shared) + 1)
        children = np.searchsorted(order, base + right, "right") - np.searchsorted(order, base + np.where(own, row + 1, row)) + (own & (b.lengths[row] > depth))
        at_root = (depth == 0) & (b.piece[row] > 0)  # a later piece's root is the node that ends the piece before
        parted = open_ | (depth == piece) | at_root
        up_parted = (up_open & (depth > 0)) | ((depth == 1) & (b.piece[row] > 0))
        roots, below = b.rows["root"].to_pylist(), b.rows["below"].to_pylist()

        def key(r: int, d: int) -> str:
            if d == piece:
                return below[r]
            return roots[r] if d == 0 and b.piece[r] else hashlib.md5(roots[r].encode() + b.paths[r][: 16 * d]).hexdigest()

        keys = [key(r, d) if p else None for r, d, p in zip(row.tolist(), depth.tolist(), parted.tolist(), strict=True)]
        parents = [key(r, d - 1) if p else None for r, d, p in zip(row.tolist(), depth.tolist(), (up_parted & ~at_root).tolist(), strict=True)]
        ends = b.rows["ends"].combine_chunks().take(pa.array(row)).to_pylist()
        ends = [e if here else None for e, here in zip(ends, (own & (b.lengths[row] == depth) & ~at_root).tolist(), strict=True)]
        top = depth == 0
        return pa.table({
            "key": pa.array(keys, pa.string()), "depth": depth + piece * b.piece[row], "conv_id": pa.array(smallest(left, right), mask=at_root),
            "parent_key": pa.array(parents, pa.string()), "parent_conv": pa.array(smallest(up_left, up_right), mask=top | up_parted),
            "n_convs": np.where(at_root, 0, n), "n_children": children, "n_leaves": np.where(at_root, 0, total(b.leaf + b.numbers("later_leaves"))),
            "saved": np.where(at_root, 0, said - kept), "ends": pa.array(ends, pa.string()),
        })

    return nodes


def digest_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each class's ids, read block by block; a digest of one list is one task's, but never held whole."""
    cls, state = None, None
    for batch in batches:
        done = []
        for c, ids in zip(batch.column("cls").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            text = ",".join(map(str, ids)).encode()
            if c == cls:
                state.update(b"," + text)
                continue
            if cls is not None:
                done.append((cls, state.hexdigest()))
            cls, state = c, hashlib.sha256(text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done]), pa.array([s for _, s in done])], ["of", "ends"])
    if cls is not None:
        yield pa.RecordBatch.from_arrays([pa.array([cls]), pa.array([state.hexdigest()])], ["of", "ends"])


def trie(turns: DataFrame, ids: DataFrame, piece: int = PIECE) -> Trie:
    """The prefix trie of the conversations ``ids`` (``conv``) with the turns ``conv, pos, digest, bytes``, positions from 0.

    Per node: conv_id (smallest member), depth, parent_conv_id (null for the root), n_convs, n_children, n_leaves
    (childless nodes of its subtree, itself included), saved_tokens (over the subtree, the bytes of each node's last
    text times its members but one), ends_sha256 (of the ids of conversations that end there, ascending, joined by
    commas). Turns are told apart by 128-bit digests. A conversation without turns is a member of the root alone; no
    conversations give no nodes. Equal conversations are counted before they are sorted, so none is hot; a
    conversation longer than ``piece`` turns is spread over pieces. Runs jobs; writes to the shared folder.
    """
    scratch = Scratch(turns.sparkSession, "trie")
    pieces = scratch.put("pieces", pieces_of(turns, ids, piece))
    ends = pieces.where("last").groupBy("cls", F.shiftright("conv", END_BITS).alias("part")).agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    digests = scratch.put("ends", ends.repartition("cls").sortWithinPartitions("cls", "part").mapInArrow(digest_ends, "of string, ends string"))

    def classes(rows: DataFrame) -> DataFrame:
        first = [F.first(c).alias(c) for c in (*PLACE, "below", "sizes")]
        sums = [F.sum(c).alias(c) for c in ("later_bytes", "later_new", "later_leaves")]
        return rows.groupBy("cls").agg(*first, F.count(F.lit(1)).alias("n"), F.count_if("last").alias("n_end"), F.min("conv").alias("conv_id"), *sums)

    nothing = F.lit(0).cast("long")
    late = pieces.where("piece > 0").withColumns({"later_new": nothing, "later_leaves": nothing})
    late = in_blocks(scratch, "late", classes(late)).groupBy("block").applyInArrow(new_parts, NEW)
    # Turns that a later piece adds count for every piece before it of the conversation they are booked under.
    booked = late.select("conv_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("piece") - 1)).alias("at"), "new_bytes", "leaves")
    booked = booked.groupBy("conv_id", "at").agg(F.sum("new_bytes").alias("later_new"), F.sum("leaves").alias("later_leaves"))
    rows = pieces.join(booked, (F.col("conv") == F.col("conv_id")) & (F.col("piece") == F.col("at")), "left").drop("conv_id", "at").fillna(0, ["later_new", "later_leaves"])
    rows = classes(rows).join(digests, F.col("cls") == F.col("of"), "left").drop("of")
    found = scratch.put("nodes", in_blocks(scratch, "all", rows).groupBy("block").applyInArrow(nodes_of(piece), NODE))
    scratch.drop("late", "all")
    parted = found.where("key IS NOT NULL").groupBy("key", "depth").agg(
        *(F.min(c).alias(c) for c in ("conv_id", "parent_key", "parent_conv")), *(F.sum(c).alias(c) for c in SUMS), F.min("ends").alias("ends"))
    parted = scratch.put("parted", parted)
    nodes = found.where("key IS NULL").unionByName(parted)
    parents = parted.select(F.col("key").alias("up"), (F.col("depth") + 1).alias("below"), F.col("conv_id").alias("up_conv"))
    nodes = nodes.join(parents, (F.col("parent_key") == F.col("up")) & (F.col("depth") == F.col("below")), "left")
    empty = hashlib.sha256(b"").hexdigest()
    nodes = nodes.select(
        "conv_id", "depth", F.coalesce("parent_conv", "up_conv").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(empty)).alias("ends_sha256"))
    return Trie(nodes, ends)


def conversation_trie(conversations: DataFrame, piece: int = PIECE, **columns: str) -> Trie:
    """The prefix trie of a table of turns; ``columns`` name conv_id, turn, role and text where they differ."""
    turns = placed(digested(conversations, **columns))
    return trie(turns, turns.select("conv").distinct(), piece)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: the first h turns of conversation c - c % 5, then the own turns after the first h; and all ids."""
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    ids = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": F.col("conv") - F.col("conv") % 5})
    bases = ids.where("conv = base").select(F.col("conv").alias("of"), F.least("n", F.lit(8)).alias("most"))
    ids = ids.join(bases, F.col("base") == F.col("of"), "left").select("conv", "h", "base", F.least("h", F.coalesce("most", F.lit(0))).alias("head"))
    heads = turns.where("conv % 5 = 0 AND pos < 8").withColumnRenamed("conv", "of")
    heads = ids.join(heads, (F.col("base") == F.col("of")) & (F.col("pos") < F.col("h"))).select("conv", "pos", "digest", "bytes")
    own = ids.select(F.col("conv").alias("of"), "h", "head").join(turns, F.col("of") == F.col("conv")).where("pos >= h")
    return heads.unionByName(own.select("conv", (F.col("pos") - F.col("h") + F.col("head")).alias("pos"), "digest", "bytes")), ids.select("conv")


def op13_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    scratch = Scratch(spark, "conversations")
    turns = scratch.put("turns", placed(scratch.put("digests", digested(table(spark, folder, "conversations")))))
    scratch.drop("digests")
    return trie(*rebuilt(turns)).nodes


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', role, text))) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT conv_id, count(*) AS n, conv_id - conv_id % 5 AS b,
 xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda k: [ascii((conv_id::VARCHAR)[k])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) % 9 AS h FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, t.k, t.role, t.text FROM c JOIN t ON t.conv_id = c.b AND t.k < c.h
 UNION ALL SELECT c.conv_id, t.k - c.h + least(c.h, coalesce(m.n, 0)), t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.k >= c.h LEFT JOIN c m ON m.conv_id = c.b),
q AS MATERIALIZED (SELECT conv_id, k + 1 AS d, md5(string_agg(md5(concat(strlen(role), ':', role, text)), '') OVER (PARTITION BY conv_id ORDER BY k)) AS g, strlen(text) AS bytes FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM c),
n AS MATERIALIZED (SELECT d, g, min(conv_id) AS conv_id, count(*) AS n, min(bytes) AS bytes FROM q GROUP BY d, g),
p AS MATERIALIZED (SELECT n.d, n.g, n.n, n.bytes, n.conv_id, q.g AS up FROM n LEFT JOIN q ON q.conv_id = n.conv_id AND q.d = n.d - 1),
k AS MATERIALIZED (SELECT d - 1 AS d, up AS g, count(*) AS n FROM p WHERE d > 0 GROUP BY ALL),
s AS (SELECT q.d, q.g, sum((p.n - 1) * p.bytes) AS saved, count(*) FILTER (k.n IS NULL) AS leaves FROM p JOIN q ON q.conv_id = p.conv_id AND q.d <= p.d LEFT JOIN k ON k.d = p.d AND k.g = p.g GROUP BY q.d, q.g),
e AS (SELECT d, g, string_agg(conv_id, ',' ORDER BY conv_id) AS ids FROM (SELECT * FROM q QUALIFY d = max(d) OVER (PARTITION BY conv_id)) GROUP BY d, g)
SELECT p.conv_id, p.d AS depth, u.conv_id AS parent_conv_id, p.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM p LEFT JOIN n u ON u.d = p.d - 1 AND u.g = p.up LEFT JOIN k ON k.d = p.d AND k.g = p.g JOIN s ON s.d = p.d AND s.g = p.g LEFT JOIN e ON e.d = p.d AND e.g = p.g
"""
