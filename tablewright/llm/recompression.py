"""Periodic runs of words by recompression.

Many texts are one sequence of symbols with a mark of its own before each text. Rounds of block compression
(a symbol's repeats become one symbol) and pair compression (symbols fall into left and right ones, a left
one before a right one becomes one symbol) make a run-length grammar; equal stretches get equal symbols but
for a few at their edges. How far two places agree is found by climbing while symbols agree and descending
from the first that differ. Such queries, forwards and backwards, extend candidates exactly: a run of period
q and length l holds l - q words that equal the word q further on, so one of them lies on the grid of q.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tablewright.llm.common import WORD, col, whole_text
from tablewright.plans.tables import table

LEAST_WORDS, LEAST_PERIODS = 24, 3
# Words whose texts share one grammar, symbols of a text that need no further round, candidates tried at once.
SLICE_WORDS, SHORT, MOST_CANDIDATES = 250_000, 8, 1 << 20
MULTIPLIERS = np.random.default_rng(11).integers(1, 1 << 62, 512).astype(np.uint64) * np.uint64(2) + np.uint64(1)
RUNS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))
RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("runs", RUNS), T.StructField("collapsed", T.StringType())])


@dataclass
class Level:
    """One level of the grammar in one reading direction."""

    symbols: np.ndarray
    up: np.ndarray | None = None  # where a symbol of the next level begins, its place there, else -1
    first: np.ndarray | None = None  # of each symbol of the next level, the place of its first symbol here
    rest: np.ndarray | None = None  # after block compression: how many equal symbols are left from here on


def compressed(symbols: np.ndarray) -> list[tuple[np.ndarray, np.ndarray | None, bool]]:
    """Per level its symbols, the places of their symbols in the next level, and whether blocks make that level.

    Marks are negative and differ; no rule touches them.
    """
    out, fresh = [], int(symbols.max(initial=0)) + 1
    for turn in range(2 * len(MULTIPLIERS)):
        if np.diff(np.flatnonzero(symbols < 0)).max(initial=0) <= SHORT + 1:
            break
        if turn % 2 == 0:
            new = np.concatenate([[True], symbols[1:] != symbols[:-1]])
            starts = np.flatnonzero(new)
            counts = np.diff(np.append(starts, len(symbols)))
            blocks = np.flatnonzero(counts > 1)
            above = symbols[starts]
            codes = above[blocks] * (len(symbols) + 1) + counts[blocks]
        else:
            right = (symbols.astype(np.uint64) * MULTIPLIERS[turn // 2]) >> np.uint64(63) == 1
            words = symbols >= 0
            lefts = np.flatnonzero(~right[:-1] & words[:-1] & right[1:] & words[1:])
            new = np.ones(len(symbols), bool)
            new[lefts + 1] = False
            above = symbols[new]
            blocks = (np.cumsum(new) - 1)[lefts]
            codes = symbols[lefts] * fresh + symbols[lefts + 1]
        if not len(blocks):
            continue
        names, numbers = np.unique(codes, return_inverse=True)
        above[blocks] = fresh + numbers
        fresh += len(names)
        out.append((symbols, np.cumsum(new) - 1, turn % 2 == 0))
        symbols = above
    return [*out, (symbols, None, False)]


def read(grammar: list[tuple[np.ndarray, np.ndarray | None, bool]], backwards: bool) -> list[Level]:
    out = []
    for symbols, places, blocks in grammar:
        if places is None:
            out.append(Level(symbols[::-1] if backwards else symbols))
            continue
        if backwards:
            symbols, places = symbols[::-1], places[-1] - places[::-1]
        begins = np.concatenate([[True], places[1:] != places[:-1]])
        first = np.flatnonzero(begins)
        rest = np.append(first[1:], len(symbols))[places] - np.arange(len(symbols)) if blocks else None
        out.append(Level(symbols, np.where(begins, places, -1), first, rest))
    return out


def agreement(levels: list[Level], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How many words from ``i`` and ``j`` on are equal, for places i <> j in reading direction."""
    who, x, y = np.arange(len(i)), i, j
    differ: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for level in levels[:-1]:
        # Where not both begin a symbol of the next level, one step or one block settles it.
        off = np.flatnonzero((level.up[x] < 0) | (level.up[y] < 0))
        same = level.symbols[x[off]] == level.symbols[y[off]]
        stop, go = off[~same], off[same]
        if level.rest is None:
            step = 1
        else:
            a, b = level.rest[x[go]], level.rest[y[go]]
            step = np.minimum(a, b)
            stop = np.concatenate([stop, go[a != b]])
        x, y = x.copy(), y.copy()
        x[go] += step
        y[go] += step
        differ.append((who[stop], x[stop], y[stop]))
        left = np.ones(len(x), bool)
        left[stop] = False
        who, x, y = who[left], level.up[x[left]], level.up[y[left]]
    top = levels[-1].symbols
    x, y = x.copy(), y.copy()
    same = np.flatnonzero(top[x] == top[y])
    while len(same):
        x[same] += 1
        y[same] += 1
        same = same[top[x[same]] == top[y[same]]]
    for level, found in zip(levels[-2::-1], differ[::-1], strict=True):
        x, y = level.first[x], level.first[y]
        same = np.flatnonzero(level.symbols[x] == level.symbols[y])
        step = 1 if level.rest is None else np.minimum(level.rest[x[same]], level.rest[y[same]])
        x[same] += step
        y[same] += step
        who, x, y = (np.concatenate([a, b]) for a, b in zip((who, x, y), found, strict=True))
    out = np.zeros(len(i), np.int64)
    out[who] = x - i[who]
    return out


def candidates(symbols: np.ndarray, starts: np.ndarray, counts: np.ndarray, least: int, periods: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places on the grids of all periods whose word recurs one period on; texts begin at ``starts``.

    A run of period q is at least max(least, periods * q) words long, so the grid's step is that less q.
    """
    tries = np.where(counts >= least, counts // periods, 0)
    after = np.cumsum(tries)
    at = 0
    while at < after[-1]:
        # About 2 tries a period of a short text; a text is parted where its periods are many.
        some = np.arange(at, min(int(after[-1]), at + MOST_CANDIDATES // 8))
        at = int(some[-1]) + 1
        text = np.searchsorted(after, some, "right")
        period = some - (after[text] - tries[text]) + 1
        step = np.maximum(least, periods * period) - period
        many = -((period - counts[text]) // step)
        edge = np.cumsum(many)
        done = 0
        while done < len(some):
            until = max(done + 1, int(np.searchsorted(edge, (edge[done - 1] if done else 0) + MOST_CANDIDATES, "right")))
            n = many[done:until]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(starts[text[done:until]], n) + k * np.repeat(step[done:until], n)
            q = np.repeat(period[done:until], n)
            hit = symbols[place] == symbols[place + q]
            yield place[hit], q[hit]
            done = until


def runs_of(texts: list[np.ndarray], least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> list[list[tuple[int, int, int]]]:
    """Per text of word numbers its runs (start, length, smallest period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    counts = np.array([len(t) for t in texts], np.int64)
    if not len(texts) or counts.max() < least:
        return out
    starts = np.cumsum(counts + 1) - counts
    symbols = np.empty(int(starts[-1] + counts[-1]) + 1, np.int64)
    for a, t in zip(starts.tolist(), texts, strict=True):
        symbols[a : a + len(t)] = t
    marks = np.append(starts - 1, len(symbols) - 1)
    symbols[marks] = -1 - np.arange(len(marks))
    found = []
    grammar = compressed(symbols)
    ahead, back = read(grammar, False), read(grammar, True)
    for place, q in candidates(symbols, starts, counts, least, periods):
        start = place - agreement(back, len(symbols) - place, len(symbols) - place - q)
        stop = place + q + agreement(ahead, place, place + q)
        long = stop - start >= np.maximum(least, periods * q)
        found.append(np.unique(np.stack([start[long], stop[long], q[long]]), axis=1))
    rows = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.zeros((3, 0), np.int64)
    # Sorted by start, stop, period: of the periods of one stretch the first is the smallest.
    same = np.concatenate([[False], (rows[:2, 1:] == rows[:2, :-1]).all(axis=0)])[: rows.shape[1]]
    rows = rows[:, ~same]
    text = np.searchsorted(starts, rows[0], "right") - 1
    for d, a, b, q in zip(text.tolist(), (rows[0] - starts[text]).tolist(), (rows[1] - rows[0]).tolist(), rows[2].tolist(), strict=True):
        out[d].append((a, b, q))
    for row in out:
        row.sort(key=lambda r: (r[0], r[2]))
    return out


def judge(texts: list[list[bytes]], least: int, periods: int) -> list[tuple[int, list[tuple[int, int, int]], bytes]]:
    """Per text of words their number, its runs, and the text without repeats."""
    counts = [len(w) for w in texts]
    numbers = pa.array(list(chain.from_iterable(texts)), pa.binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
    runs = runs_of(np.split(numbers, np.cumsum(counts)[:-1]), least, periods) if texts else []
    out = []
    for n, words, found in zip(counts, texts, runs, strict=True):
        if found:
            edge = np.zeros(n + 1, np.int64)
            for start, length, period in found:
                edge[start + period] += 1
                edge[start + length] -= 1
            words = compress(words, (np.cumsum(edge[:-1]) == 0).tolist())
        out.append((n, found, b" ".join(words)))
    return out


def finder(least: int, periods: int):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, some, size = [], [], 0
            for t in batch.column("text").cast(pa.binary()).to_pylist():
                some.append(t.split())  # of bytes: at blanks, tabs, line breaks, vertical tabs and form feeds
                size += len(some[-1])
                if size >= SLICE_WORDS:
                    out += judge(some, least, periods)
                    some, size = [], 0
            out += judge(some, least, periods)
            runs = pa.array([[{"start": a, "length": b, "period": q} for a, b, q in r] for _, r, _ in out], to_arrow_type(RUNS))
            columns = [batch.column("doc_id"), pa.array([n for n, _, _ in out], pa.int64()), runs, pa.array([t for _, _, t in out], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *RESULT.names])

    return found


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str | Column = "text", least: int = LEAST_WORDS, periods: int = LEAST_PERIODS) -> DataFrame:
    """Per row of ``docs`` its id, number of words, periodic runs, and its words without the runs' repeats.

    Words are parted by blanks, tabs, line breaks, vertical tabs and form feeds, and compared as they are. A run is a
    stretch of consecutive words with smallest period q, at least ``least`` words and ``periods`` times q long, that
    no neighbouring word extends in that period. ``runs`` have start (word number from 0), length and period, by start,
    then period. ``collapsed`` joins by one blank the words that no run holds after its first q words.

    Null and empty texts have no words and no runs. Every row is judged for itself, null and repeated ids like
    others; other columns are ignored. Whole texts are read; texts of one task share grammars of about
    ``SLICE_WORDS`` words, and a longer text takes some hundred bytes a word. A text's symbols and candidates are
    handled in bounded portions. ``text`` may be a column's name or an expression.
    """
    words = whole_text(text) if isinstance(text, str) else F.coalesce(text, F.lit(""))
    rows = docs.select(col(doc_id).alias("doc_id"), words.alias("text"))
    return rows.mapInArrow(finder(least, periods), T.StructType([rows.schema["doc_id"], *RESULT]))


def rewritten(doc_id: str, text: str) -> Column:
    """The contract's texts: where h = crc32(id) is divisible by 10, words from a on repeat p words, as given by h and their number."""
    h = F.crc32(F.col(doc_id).cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.array_join(F.transform(words, lambda w, i: F.when(i >= a, F.get(words, (a + (i - a) % p).cast("int"))).otherwise(w)), " ")

    # An array of one array: its words are made once, not once per word.
    words = F.array(F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), 1))
    return F.when((h % 10 == 0) & F.col(text).rlike(WORD), F.get(F.transform(words, repeated), 0)).otherwise(F.col(text))


def op11_recompression(spark: SparkSession, folder: str) -> DataFrame:
    found = find_runs(table(spark, folder, "documents"), text=rewritten("doc_id", "text"))
    # Runs come by start, then period, so the first of equal exponents stays.
    best = F.reduce(F.slice("runs", 2, 1 << 30), F.get("runs", 0), lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


OP11_SQL = r"""
WITH b AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS o,
 xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, length(doc_id::VARCHAR) + 1), lambda k: [ascii((doc_id::VARCHAR)[k])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END), 4294967295) AS h FROM documents),
g AS (SELECT r, doc_id, o, len(o) AS n, h // 10 AS g, CASE WHEN h % 10 = 0 AND len(o) > 0 THEN (h // 10) % len(o) END AS a FROM b),
d AS (SELECT r, doc_id, n, CASE WHEN a IS NULL THEN o ELSE list_transform(range(n), lambda i: o[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) END AS w FROM g),
x AS MATERIALIZED (SELECT r, n, unnest(w) AS v, unnest(range(n)) AS i FROM d),
e AS (SELECT x.r, x.i, y.i - x.i AS q FROM x JOIN x y ON x.r = y.r AND x.v = y.v AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
t AS (SELECT r, q, min(i) AS s, count(*) + q AS l FROM (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS k FROM e) GROUP BY r, q, k),
u AS MATERIALIZED (SELECT r, s, l, min(q) AS q FROM t WHERE l >= 24 AND l >= 3 * q GROUP BY r, s, l),
m AS (SELECT r, count(*) AS n_runs, string_agg(concat(s, ',', l, ',', q, chr(10)), '' ORDER BY s, q) AS lines FROM u GROUP BY r),
f AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY r ORDER BY l::DOUBLE / q DESC, s, q) = 1),
z AS (SELECT DISTINCT r, unnest(range(s + q, s + l)) AS i FROM u),
c AS (SELECT r, string_agg(v, ' ' ORDER BY i) AS kept FROM x ANTI JOIN z USING (r, i) GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM d LEFT JOIN m USING (r) LEFT JOIN f USING (r) LEFT JOIN c USING (r)
"""
