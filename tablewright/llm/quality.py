"""Quality scores by regularised quadratic discriminant analysis over document statistics.

Each class has a mean and a covariance of the transformed statistics; covariances are shrunk towards the
pooled one and then towards a multiple of the identity. A score compares the two Gaussian log densities,
whose Mahalanobis terms come from Cholesky factors computed once per model.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import col, whole_text

WORDS = re.compile(r"[^\x20\t-\r]+")
STATISTICS = ["words", "word_length", "letters", "upper", "digits", "symbols", "symbol_runs", "sentence_ends", "distinct_words", "top_word", "distinct_lines", "line_words", "packed"]
LETTER_LOW, LETTER_UP, DIGIT, BLANK, STOP, SYMBOL = range(6)
MOST_LABELLED = 20_000


@lru_cache(1)
def character_classes() -> np.ndarray:
    out = np.full(65536, SYMBOL, np.uint8)
    for code in range(65536):
        c = chr(code)
        if c.isalpha():
            out[code] = LETTER_UP if c.isupper() else LETTER_LOW
        elif c.isdigit():
            out[code] = DIGIT
        elif c.isspace():
            out[code] = BLANK
        elif c in ".,;:?!'\"()-":
            out[code] = STOP
    return out


def statistics(text: str) -> list[float]:
    """Transformed statistics of a whole text; an empty text has the value of a share of nothing, 0, throughout."""
    if not text:
        return [0.0] * len(STATISTICS)
    codes = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    kinds = character_classes()[np.minimum(codes, 65535)]
    low, up, digit, blank, stop, symbol = np.bincount(kinds, minlength=6).tolist()
    words = WORDS.findall(text)
    n, chars = max(1, len(words)), max(1, len(codes) - blank)
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = text.split("\n")
    # A sign directly after the same sign; letters and blanks repeat in ordinary text.
    runs = int(((codes[1:] == codes[:-1]) & (kinds[1:] >= STOP)).sum())
    ends = sum(1 for w in words if w[-1] in ".?!")
    raw = text.encode("utf-8", "replace")
    share = lambda a, b: float(np.log((a + 0.5) / (b - a + 0.5))) if b >= a else float(np.log(a + 0.5))
    return [
        float(np.log1p(len(words))), chars / n if chars < 40 * n else 40.0, share(low + up, chars), share(up, max(1, low + up)), share(digit, chars), share(symbol, chars),
        share(runs, chars), share(ends, n), share(len(counts), n), share(max(counts.values(), default=0), n), share(len(set(lines)), len(lines)),
        float(np.log1p(n / len(lines))), float(np.log(len(zlib.compress(raw, 1)) / (len(raw) + 20))),
    ]


@dataclass(frozen=True)
class Model:
    """Centre and scale of the statistics, and per class the mean, the Cholesky factor and the constant."""

    centre: np.ndarray
    scale: np.ndarray
    means: tuple[np.ndarray, ...]
    factors: tuple[np.ndarray, ...]
    constants: tuple[float, ...]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.constants[0])
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, constant in zip(self.means, self.factors, self.constants, strict=True):
            y = np.linalg.solve(factor, (z - mean).T)
            logs.append(constant - 0.5 * (y * y).sum(axis=0))
        # Divided by the number of statistics: they are not independent, and scores keep their order at the ends.
        return 1 / (1 + np.exp(-np.clip((logs[1] - logs[0]) / np.sqrt(len(self.centre)), -500, 500)))


def fit_moments(moments: dict[int, tuple[float, np.ndarray, np.ndarray]], to_pooled: float, to_identity: float) -> Model:
    """A model from each class's row count, sum and sum of outer products.

    With one class only, every score is that class; with no labelled row every score is one half.
    """
    moments = {k: m for k, m in moments.items() if m[0] > 0}
    if len(moments) < 2:
        return Model(np.zeros(0), np.ones(0), (), (), (0.5 if not moments else float(next(iter(moments))),))
    total = sum(m[0] for m in moments.values())
    centre = sum(m[1] for m in moments.values()) / total
    spread = np.diag(sum(m[2] for m in moments.values())) / total - centre**2
    scale = np.sqrt(np.maximum(spread, 1e-6))
    d = len(centre)
    means, covariances = [], []
    for k in (0, 1):
        n, s, o = moments[k]
        mean = s / n
        covariances.append((o / n - np.outer(mean, mean)) / np.outer(scale, scale))
        means.append((mean - centre) / scale)
    pooled = sum(moments[k][0] * covariances[k] for k in (0, 1)) / total
    factors, constants = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * covariances[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * max(np.trace(c) / d, 1e-3) * np.eye(d)
        factor = np.linalg.cholesky(c)
        factors.append(factor)
        constants.append(float(np.log(moments[k][0] / total) - np.log(np.diag(factor)).sum()))
    return Model(centre, scale, tuple(means), tuple(factors), tuple(constants))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", to_pooled: float = 0.1, to_identity: float = 0.05, most: int = MOST_LABELLED,
        key: str = "doc_id", text: str = "text") -> Model:
    """Fit on at most ``most`` labelled rows (those with the smallest id hashes; a broadcast of that bound).

    Labels other than 0 and 1 and null ids or labels are not used; a row labelled twice counts twice. Each
    task returns per class a count, a sum and a matrix, so the driver gets a few kilobytes.
    """
    chosen = labels.select(col(key).alias("id"), col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "label").limit(most)
    rows = docs.select(col(key).alias("id"), whole_text(text).alias("text")).join(F.broadcast(chosen), "id").select("text", "label")

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(STATISTICS)
        out = {k: [0.0, np.zeros(d), np.zeros((d, d))] for k in (0, 1)}
        for batch in batches:
            x, y = np.array([statistics(t) for t in batch["text"]]).reshape(-1, d), batch["label"].to_numpy()
            for k in (0, 1):
                own = x[y == k]
                out[k][0] += len(own)
                out[k][1] += own.sum(axis=0)
                out[k][2] += own.T @ own
        yield pd.DataFrame({"label": [0, 1], "n": [out[k][0] for k in (0, 1)], "s": [out[k][1].tolist() for k in (0, 1)], "o": [out[k][2].ravel().tolist() for k in (0, 1)]})

    partial = rows.mapInPandas(sums, "label int, n double, s array<double>, o array<double>")
    cells = partial.select("label", "n", F.posexplode(F.concat("s", "o")).alias("at", "v")).groupBy("label", "at").agg(F.sum("v").alias("v"))
    counts = {r["label"]: r["n"] for r in partial.groupBy("label").agg(F.sum("n").alias("n")).collect()}
    d = len(STATISTICS)
    flat = {k: np.zeros(d + d * d) for k in counts}
    for k, at, v in cells.collect():
        flat[k][at] = v
    return fit_moments({k: (counts[k], f[:d], f[d:].reshape(d, d)) for k, f in flat.items()}, to_pooled, to_identity)


def score(model: Model):
    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS))))

    return scored


def held_out(key: str, parts: int, rest: int):
    """Whether the CRC-32 of an id's text has the given remainder; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(col(key).cast("string").cast("binary")), F.lit(parts)) == rest, F.lit(False))


def judge_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, key: str = "doc_id", text: str = "text", parts: int = 5, rest: int = 0) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Labels are learned only where the id is not held out. A null text scores as an empty one, repeated rows
    repeat their score, whole texts of any length are read one at a time, an empty table gives none.
    """
    model = fit(docs, labels.where(~held_out(key, parts, rest)), key=key, text=text)
    out = docs.select(col(key).alias("doc_id"), held_out(key, parts, rest).alias("held_out"), score(model)(whole_text(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op4_quality(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return judge_quality(table(spark, folder, "documents"), table(spark, folder, "labels"))
