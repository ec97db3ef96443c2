"""Periodic runs against brute force and on awkward rows."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import recompression
from tablewright.llm.recompression import agreement, compressed, find_runs, read, runs_of


def brute(words, least, periods):
    found = {}
    for q in range(1, len(words) // periods + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i > start and i + q - start >= max(least, periods * q):
                found.setdefault((start, i + q - start), q)
            i += i == start
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def mixed_texts(rng):
    texts = []
    for _ in range(rng.randint(1, 6)):
        kinds = rng.choice([1, 2, 3, 5, 50])
        words = [rng.randrange(kinds) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.6:
            unit, at = [rng.randrange(kinds) for _ in range(rng.randint(1, 12))], rng.randint(0, len(words))
            words[at:at] = (unit * 20)[: rng.randint(1, 8 * len(unit))]
        texts.append(np.array(words, np.int64))
    return texts


@pytest.mark.parametrize(("least", "periods"), [(24, 3), (2, 2), (6, 3)])
def test_runs_equal_brute_force(least, periods):
    rng = random.Random(least)
    seen = 0
    for _ in range(150):
        texts = mixed_texts(rng)
        for text, got in zip(texts, runs_of(texts, least, periods), strict=True):
            assert got == brute(text.tolist(), least, periods)
            seen += len(got)
    assert seen > 20


def test_grammar_agreement_equals_direct_comparison():
    rng = random.Random(5)
    for _ in range(40):
        symbols = np.array([-1, *[rng.randrange(3) for _ in range(80)], -2, *([4, 5, 4] * 30), -3], np.int64)
        grammar, n = compressed(symbols), len(symbols)
        i, j = np.array([(i, j) for i in range(n) for j in range(i + 1, n)]).T

        def direct(row, a, b):
            k = 0
            while b + k < n and row[a + k] == row[b + k]:
                k += 1
            return k

        want = [direct(symbols, a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
        assert agreement(read(grammar, False), i, j).tolist() == want
        assert agreement(read(grammar, True), n - 1 - j, n - 1 - i).tolist() == [direct(symbols[::-1], n - 1 - b, n - 1 - a) for a, b in zip(i.tolist(), j.tolist(), strict=True)]


def test_candidates_come_in_bounded_portions(monkeypatch):
    texts = mixed_texts(random.Random(9)) + [np.zeros(300, np.int64)]
    want = runs_of(texts, 6, 3)
    monkeypatch.setattr(recompression, "MOST_CANDIDATES", 16)
    assert runs_of(texts, 6, 3) == want


ROWS = [
    (1, "a b c " * 10), (1, "a b c " * 10), (None, "x\ty\n" * 20 + "tail"), (3, None), (4, ""), (5, " \n"), (6, "one"),
    (7, "start " + "z " * 5000 + "end"), (8, "a b " * 12 + "c d " * 12), (9, "a\x1cb " * 24), (10, "é ê " * 11),
]


def test_find_runs_on_awkward_rows(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").withColumns({c: F.lit("taken") for c in ("runs", "r", "n_words", "collapsed")})
    out = find_runs(docs.repartition(3)).collect()
    assert len(out) == len(ROWS)
    of = {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out}
    assert of[1] == (30, [(0, 30, 3)], "a b c") and sum(r["doc_id"] == 1 for r in out) == 2
    assert of[None] == (41, [(0, 40, 2)], "x y tail")
    assert of[3] == of[4] == of[5] == (0, [], "") and of[6] == (1, [], "one")
    assert of[7] == (5002, [(1, 5000, 1)], "start z end")
    assert of[8] == (48, [(0, 24, 2), (24, 24, 2)], "a b c d")
    assert of[9] == (24, [(0, 24, 1)], "a\x1cb")  # no white space of the contract
    assert of[10] == (22, [], " ".join(["é ê"] * 11))  # too short
    assert find_runs(docs.limit(0)).count() == 0


def test_contract_digests_of_few_rows(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = recompression.op11_recompression(spark, str(tmp_path))
    from compare import compare, connect

    assert compare(out.where("doc_id IS NOT NULL"), connect_one(connect, tmp_path), recompression.OP11_SQL.replace("FROM documents)", "FROM documents WHERE doc_id IS NOT NULL)")) is None
    assert out.where("doc_id IS NULL").first()["n_runs"] == 1


def connect_one(connect, folder):
    database = connect(str(folder / "none"))
    database.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return database
