"""Passages of test items against brute force, in one and several tables, and on awkward rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tablewright.llm import wu_manber
from tablewright.llm.wu_manber import Part, find_passages

WORDS = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORDS.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))


def brute(text, items, window):
    words, hit, names = words_of(text), set(), set()
    for name, item in items:
        own = words_of(item)
        n = min(window, len(own))
        passages = {tuple(own[i : i + n]) for i in range(len(own) - n + 1)} if n else set()
        for i in range(len(words) - n + 1):
            if tuple(words[i : i + n]) in passages:
                hit.update(range(i, i + n))
                names |= {str(name)} - {"None"}
    return len(words), hit, sorted(names)


def texts(rng, n, kinds, longest):
    vocabulary = ["a", "b", "the", "é", "日本", "longerword", "I", "x1", "of", "Zz"][:kinds]
    return ["".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(rng.randint(0, longest))) for _ in range(n)]


@pytest.mark.parametrize(("window", "kinds", "stretch"), [(10, 3, 2048), (3, 10, 16), (1, 10, 5), (10, 1, 64), (5, 2, 1)])
def test_search_equals_brute_force(window, kinds, stretch, monkeypatch):
    monkeypatch.setattr(wu_manber, "STRETCH", stretch)
    monkeypatch.setattr(wu_manber, "MOST_PAIRS", 50)
    rng, hits = random.Random(window * kinds), 0
    for _ in range(30):
        items = [(rng.choice(["i1", "i2", "i10", None]), t) for t in texts(rng, rng.randint(1, 6), kinds, 14)]
        docs = texts(rng, 8, kinds, 80) + [""]
        part = Part([(name, w) for name, t in items if (w := [x.encode() for x in words_of(t)])], window)
        for text, (n, spans, names) in zip(docs, part.judge([d.encode() for d in docs]), strict=True):
            want = brute(text, items, window)
            assert (n, {i for a, b in spans for i in range(a, b)}, names) == want
            assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))
            hits += len(spans)
    assert hits


ITEMS = [
    (1, "The quick brown fox jumps over the lazy dog and then sleeps in the sun"), (2, "short item"), (2, "another short"), (3, None), (4, " .. "),
    (None, "nameless passage of four"), (10, "THE QUICK, brown fox jumps over the lazy dog and then wakes"),
]
DOCS = [
    (1, "so The quick brown fox -- jumps over the lazy dog and then sleeps, in the sun."), (1, "so The quick brown fox -- jumps over the lazy dog and then sleeps, in the sun."),
    (1, "nothing"), (2, None), (3, ""), (4, "a short item and another short"), (None, "nameless passage of four!"), (5, "shortitem short itemized quick brown fox"),
    (6, "w " * 30000 + "short item" + " w" * 30000), (7, "naïve Übung"), (8, "the quick brown fox jumps over the lazy dog and"),
]


@pytest.mark.parametrize("part_bytes", [1 << 20, 60, 1])
def test_find_passages_on_awkward_rows(spark, part_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("spans", "items", "digest", "key", "id", "n_words")}).repartition(3)
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("name", F.lit("taken"))
    out = find_passages(docs, items, part_bytes=part_bytes)
    assert out.columns == ["doc_id", "n_words", "spans", "items"]
    got = sorted(((r["doc_id"], r["n_words"], [tuple(s) for s in r["spans"]], r["items"]) for r in out.collect()), key=str)
    want = []
    for name, text in DOCS:
        n, hit, names = brute(text, ITEMS, 10)
        edges = sorted(hit)
        starts = [i for i in edges if i - 1 not in hit]
        stops = [i + 1 for i in edges if i + 1 not in hit]
        want.append((name, n, list(zip(starts, stops, strict=True)), names))
    assert got == sorted(want, key=str)
    assert [tuple(s) for r in got if r[0] == 6 for s in r[2]] == [(30000, 30002)]


def test_find_passages_without_items_or_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([(1, None), (2, "--")], "item_id long, text string")
    assert find_passages(docs, none).where(F.size("spans") > 0).count() == 0
    assert find_passages(docs, none.limit(0)).count() == len(DOCS)
    assert find_passages(docs.limit(0), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0
