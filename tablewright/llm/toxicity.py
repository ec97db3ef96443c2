"""Toxicity scores: a learned lexicon in a trie, met with Levenshtein automata, read in context.

The lexicon is learned from labelled documents: words and word stems that toxic documents hold and others
don't, each with its log odds. Words are run through the product of the trie and the automaton that allows
one edit; its deterministic states are made as they are met. A window around each hit tells quotation and
report, which weigh less, from direct address, which weighs more.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.common import Scratch, col, whole_text
from tablewright.llm.quality import MOST_LABELLED, WORDS, held_out

END = "\x00"  # follows a term that is a whole word; other terms are stems
STEM, FUZZY_WORD, FUZZY_STEM, MOST_TERMS, MOST_CACHED = 4, 5, 6, 20_000, 300_000
WINDOW = 8
# Context cues in the corpus's languages.
OPENING, CLOSING = "\"'“‘«„‹", "\"'”’»“›"
REPORTING = frozenset("said says wrote called quote quoted word term dit écrit appelé mot terme sagte schrieb nannte wort dijo escribió llamó palabra".split())
ADDRESS = frozenset("you your you're yourself du dich dein ihr euch tu toi vous votre tú usted tus vosotros".split())
EDGE = re.compile(r"^[\W_]+|[\W_]+$")
INNER = re.compile(r"[\W_]+")


def forms(word: str) -> list[str]:
    """The word in lower case without signs around it; if signs stand within, also its parts."""
    whole = word.lower().strip(string.punctuation)
    if whole.isalnum():
        return [whole]
    whole = EDGE.sub("", whole)
    if not whole or whole.isalnum():
        return [whole] if whole else []
    return [whole, *(p for p in INNER.split(whole) if p)]


@dataclass
class Automaton:
    """Trie of terms times the automaton of at most one edit, determinised as words need it."""

    terms: list[str]
    children: list[dict[str, int]] = field(default_factory=lambda: [{}])
    ends: list[int] = field(default_factory=lambda: [-1])

    def __post_init__(self) -> None:
        for i, term in enumerate(self.terms):
            node = 0
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = self.children[node][c]
            self.ends[node] = i
        self.reset()

    def reset(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.found: list[tuple[tuple[int, int], ...]] = []
        self.steps: list[dict[str, int]] = []
        self.start, self.dead = self.state({0: 0}), self.state({})

    def state(self, nodes: dict[int, int]) -> int:
        """The number of a set of (node, edits so far); leaving out a letter of the term is an edit."""
        todo = [n for n, e in nodes.items() if e == 0]
        for n in todo:
            for c, child in self.children[n].items():
                if c != END:
                    nodes.setdefault(child, 1)
        key = frozenset(nodes.items())
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            hits = ((self.ends[n], e) for n, e in key if self.ends[n] >= 0)
            self.found.append(tuple((t, e) for t, e in hits if not e or len(self.terms[t]) >= (FUZZY_WORD + 1 if self.terms[t].endswith(END) else FUZZY_STEM)))
        return self.states[key]

    def step(self, state: int, c: str) -> int:
        """The state after one more letter, worked out and kept."""
        nodes: dict[int, int] = {}

        def put(node: int, edits: int) -> None:
            if edits <= 1 and nodes.get(node, 2) > edits:
                nodes[node] = edits

        for node, edits in self.sets[state]:
            for d, child in self.children[node].items():
                if d == c:
                    put(child, edits)
                elif c != END and d != END:
                    put(child, edits + 1)
            if c != END:
                put(node, edits + 1)
        self.steps[state][c] = after = self.state(nodes)
        return after

    def match(self, word: str) -> dict[int, int]:
        """Terms that the word, or for stems its beginning, is within one edit of: term to edits."""
        if len(self.sets) > MOST_CACHED:
            self.reset()
        state, dead, out = self.start, self.dead, {}
        steps, found = self.steps, self.found
        for c in word + END:
            after = steps[state].get(c)
            state = self.step(state, c) if after is None else after
            if state == dead:
                break
            for term, edits in found[state]:
                out[term] = min(edits, out.get(term, 2))
        return out


@dataclass
class Lexicon:
    terms: list[str]
    weights: list[float]
    fuzzy: list[float]
    ordinary: frozenset[str]
    slope: float
    prior: float

    def __post_init__(self) -> None:
        self.automaton = Automaton(self.terms)
        self.cache: dict[str, tuple[tuple[int, float], ...]] = {}
        self.clean: set[str] = set()

    def __getstate__(self) -> dict:
        return {k: getattr(self, k) for k in ("terms", "weights", "fuzzy", "ordinary", "slope", "prior")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.__post_init__()

    def hits(self, word: str) -> tuple[tuple[int, float], ...]:
        """Terms and weights of a word as it stands in the text."""
        found = self.cache.get(word)
        if found is None:
            best: dict[int, float] = {}
            for form in forms(word):
                for term, edits in self.automaton.match(form).items():
                    if not edits or form not in self.ordinary:
                        best[term] = max(best.get(term, 0.0), self.fuzzy[term] if edits else self.weights[term])
            found = tuple((t, w) for t, w in best.items() if w > 0) if best else ()
            if found:
                if len(self.cache) > MOST_CACHED:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def telling(self, words: list[str]) -> set[str]:
        """The distinct words with a hit; words known to have none are ruled out as sets, not one by one."""
        if len(self.clean) > MOST_CACHED:
            self.clean.clear()
        new = set(words).difference(self.clean)
        out = {w for w in new if self.hits(w)}
        self.clean |= new - out
        return out

    def weight(self, text: str) -> float:
        """Of each distinct word with a hit the best weight in its most abusive context, added up."""
        words = WORDS.findall(text)
        odds: dict[str, float] = {}
        telling = self.telling(words)
        for i, word in enumerate(words) if telling else ():
            if word in telling:
                # A word is one piece of evidence, however many terms it comes near.
                odds[word] = max(odds.get(word, 0.0), max(w for _, w in self.hits(word)) * context(words, i))
        return sum(odds.values())

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.prior + self.slope * self.weight(text)))))


def context(words: list[str], at: int) -> float:
    """0.35 inside quotation marks, 0.7 in reported speech, 1.2 when somebody is addressed, else 1."""
    before, after = words[max(0, at - WINDOW) : at], words[at + 1 : at + 1 + WINDOW]
    opened = False
    for w in before:
        if w[0] in OPENING:
            opened = True
        if w.rstrip(".,;:?!")[-1:] in CLOSING and len(w) > 1:
            opened = False
    word = words[at]
    opened = opened or word[0] in OPENING
    closed = word.rstrip(".,;:?!")[-1:] in CLOSING or any(w.rstrip(".,;:?!")[-1:] in CLOSING for w in after)
    if opened and closed:
        return 0.35
    near = {w.lower().strip(".,;:?!") for w in before + after}
    return 0.7 if near & REPORTING else 1.2 if near & ADDRESS else 1.0


def log_odds(a: float, b: float, n1: float, n0: float) -> float:
    return math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))


def evidence(a: float, b: float, base: float) -> float:
    """Minus the log chance, by the Chernoff bound, that so many of a term's documents are toxic."""
    n = a + b
    p = a / n
    if p <= base:
        return 0.0
    return n * (p * math.log(p / base) + ((1 - p) * math.log((1 - p) / (1 - base)) if p < 1 else 0.0))


def choose_terms(counts: list[tuple[str, int, int]], n1: int, n0: int, tried: int) -> dict[str, float]:
    """Weights of terms, none a beginning of another: of a stem and its forms the one with most evidence, the longer on a tie.

    A term short of what chance would give among ``tried`` terms keeps part of its weight, so that it takes
    two of them to condemn a document.
    """
    base, needed = n1 / (n1 + n0), math.log(max(2, tried) / 0.05)
    strong = [(evidence(a, b, base), len(t), t, log_odds(a, b, n1, n0)) for t, a, b in counts]
    out: dict[str, float] = {}
    closed: set[str] = set()
    for found, _, t, odds in sorted(strong, reverse=True):
        if found < 0.6 * needed or odds < 2 or t in closed or any(t[:k] in out for k in range(STEM, len(t))):
            continue
        out[t] = odds * min(1.0, found / needed)
        closed.update(t[:k] for k in range(STEM, len(t)))
    return out


def first_copies(rows: DataFrame) -> DataFrame:
    """Ids of ``rows`` (``id, text``) that share none of three min-hashes of five-word shingles with a smaller id.

    Near copies of one toxic document would otherwise make each of its words look like a toxic one.
    """

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                w = WORDS.findall(t)
                h = np.array([xxhash.xxh64_intdigest(" ".join(w[k : k + 5])) for k in range(max(1, len(w) - 4))], np.uint64)
                out += [(i, j, int((h * np.uint64(m)).min() >> np.uint64(1))) for j, m in enumerate((1, 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))]
            yield pd.DataFrame(out, columns=["id", "j", "key"])

    hashed = rows.mapInPandas(keys, "id long, j int, key long")
    first = hashed.withColumn("first", F.min("id").over(Window.partitionBy("j", "key")))
    return first.groupBy("id").agg(F.min("first").alias("first")).where("id = first").select("id")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_LABELLED, key: str = "doc_id", text: str = "text") -> Lexicon:
    """The lexicon of at most ``most`` labelled documents (those with the smallest id hashes).

    Tasks count stems and words per document, Spark adds the counts up and keeps terms with enough
    evidence, at most ``MOST_TERMS``. Three quarters of the documents, near copies left out, give the terms;
    the last quarter turns a document's sum of weights into a probability. Ids must be integers. Without toxic or
    without other documents the lexicon is empty and the score is the share of toxic documents, one half
    if there are none at all.
    """
    chosen = labels.select(col(key).alias("id"), col(label).cast("int").alias("label")).where("id IS NOT NULL AND label IN (0, 1)")
    chosen = chosen.orderBy(F.xxhash64("id"), "label").limit(most)
    rows = Scratch(docs.sparkSession, "toxicity").put("rows", docs.select(col(key).alias("id"), whole_text(text).alias("text")).join(F.broadcast(chosen), "id"))
    aside = F.pmod(F.xxhash64("id", F.lit("calibration")), F.lit(4)) == 0
    taught = rows.where(~aside).join(F.broadcast(first_copies(rows)), "id").select("text", "label")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = (Counter(), Counter())
            for t, y in zip(batch["text"], batch["label"], strict=True):
                own = {""}
                for w in set(WORDS.findall(t.lower())):
                    for f in forms(w):
                        own.update(f[:k] for k in range(STEM, min(len(f), 24) + 1))
                        own.add(f + END)
                seen[y].update(own)
            for y in (0, 1):
                if seen[y]:
                    yield pd.DataFrame({"term": pd.Series(list(seen[y]), dtype=object), "label": y, "n": list(seen[y].values())})

    counted = taught.mapInPandas(count, "term string, label int, n long").groupBy("term").agg(F.sum(F.col("n") * F.col("label")).alias("a"), F.sum(F.col("n") * (1 - F.col("label"))).alias("b"))
    # The empty term stands in every document; terms of one document alone say nothing.
    counted = counted.where("term = '' OR (a + b >= 2)")
    total = counted.agg(F.sum(F.when(F.col("term") == "", F.col("a"))), F.sum(F.when(F.col("term") == "", F.col("b"))), F.count(F.lit(1))).first()
    n1, n0, tried = int(total[0] or 0), int(total[1] or 0), int(total[2])
    if not n1 or not n0:
        share = (n1 + 0.5) / (n1 + n0 + 1)
        return Lexicon([], [], [], frozenset(), 1.0, math.log(share / (1 - share)))
    often = (F.col("a") >= 3) & (F.col("a") * n0 >= F.col("b") * (5 * n1)) & (F.col("term") != "")
    best = counted.where(often).orderBy(F.desc("a"), "term").limit(MOST_TERMS).collect()
    weights = choose_terms([tuple(r) for r in best], n1, n0, tried)
    terms = sorted(weights)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton, known = Automaton(terms), {}
        for batch in batches:
            out = []
            for t, y in zip(batch["text"], batch["label"], strict=True):
                own = set()
                for w in set(WORDS.findall(t)):
                    for f in forms(w):
                        if f not in known:
                            known[f] = [k for k, e in automaton.match(f).items() if e]
                        own.update((f, k) for k in known[f])
                out += [(f, k, y) for f, k in own]
            if out:
                form, term, label = zip(*out, strict=True)
                yield pd.DataFrame({"form": pd.Series(form, dtype=object), "term": term, "label": label})

    fuzzy = taught.mapInPandas(near, "form string, term int, label int").groupBy("form", "term").agg(F.sum("label").alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    ordinary, sums = set(), {}
    for form, term, a, b in fuzzy.where("b > 0 OR a > 1").orderBy(F.desc("b"), "form", "term").limit(10 * MOST_TERMS).collect():
        if b * n1 * 4 >= a * n0:
            ordinary.add(form)
        old = sums.get(term, (0, 0))
        sums[term] = (old[0] + a, old[1] + b)
    loose = []
    for i, t in enumerate(terms):
        a, b = sums.get(i, (0, 0))
        # How often ordinary words come close to a term says how little a word close to it means.
        loose.append(max(0.0, min(0.8 * weights[t], log_odds(a + 1, b, n1, n0))) if b else 0.8 * weights[t])
    lexicon = Lexicon(terms, [weights[t] for t in terms], loose, frozenset(ordinary), 1.0, math.log(n1 / n0))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    weigh = F.pandas_udf(lambda texts: pd.Series(np.fromiter((shared.value.weight(t) for t in texts), float, len(texts))), "double")
    sums = rows.where(aside).select(weigh("text").alias("s"), "label").collect()
    lexicon.slope, lexicon.prior = calibrate(np.array([r[0] for r in sums]), np.array([r[1] for r in sums], float), lexicon.prior)
    return lexicon


def calibrate(s: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, float]:
    """Slope and offset of the logistic curve from weight to probability, by Newton steps from (1, prior).

    A weak pull towards the start keeps few or separable documents from running away.
    """
    start = at = np.array([1.0, prior])
    pull = np.diag([2.0, 1.0])
    x = np.stack([s, np.ones(len(s))], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (y - p) - pull @ (at - start))
        at = at + step / max(1.0, float(np.abs(step).max()))
    return float(np.clip(at[0], 0.2, 2.0)), float(np.clip(at[1], -6.0, 0.0))


def judge_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, key: str = "doc_id", text: str = "text", parts: int = 3, rest: int = 1) -> DataFrame:
    """One row per document: ``doc_id``, ``held_out``, ``score``, ``predicted``.

    Labels are learned only where the id is not held out. A null text scores as an empty one, which has the
    prior's score; repeated rows repeat their score, and an empty table gives none.
    """
    lexicon = learn(docs, labels.where(~held_out(key, parts, rest)), key=key, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        own = shared.value
        return pd.Series(np.fromiter((own.score(t) for t in texts), float, len(texts)))

    out = docs.select(col(key).alias("doc_id"), held_out(key, parts, rest).alias("held_out"), scored(whole_text(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark, folder: str) -> DataFrame:
    from tablewright.plans.tables import table

    return judge_toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))
