"""The prefix trie against SQL on random conversations, in small blocks and pieces, and on awkward rows."""

import random

import pytest
from compare import compare, connect
from pyspark.sql import functions as F

from tablewright.llm import prefix_trie
from tablewright.llm.prefix_trie import OP13_SQL, conversation_trie, digested, placed, rebuilt, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def database(folder, rows):
    held = connect(str(folder / "none"))
    held.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    held.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    return held


def some_rows(seed):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-7, 60), 40):
        text = [(k % 2, rng.choice("aab")) for k in range(rng.choice([0, 1, 2, 3, 5, 12]))]
        rows += [(c, k + 3, "ua"[side], said) for k, (side, said) in enumerate(text)]
    rows += [(c, k, "u", "same") for c in range(100, 130) for k in range(9)]  # equal conversations
    rows += [(200, None, None, None), (200, 1, "u", "é" * 9), (200, 1, "u", "a"), (None, 0, "u", "lost"), (1 << 40, 0, "u", "far"), (7, 99, "a", "x" * 5000)]
    return rows


@pytest.mark.parametrize(("seed", "block", "piece", "bits"), [(1, 20_000, 512, 16), (2, 5, 512, 16), (3, 4, 2, 3), (4, 1, 1, 0), (5, 9, 3, 2)])
def test_trie_equals_sql(spark, tmp_path, monkeypatch, seed, block, piece, bits):
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block)
    monkeypatch.setattr(prefix_trie, "END_BITS", bits)
    rows = some_rows(seed)
    turns = placed(digested(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert compare(trie(*rebuilt(turns), piece=piece).nodes, database(tmp_path, rows), OP13_SQL) is None


def test_members_are_kept_whole(spark):
    rows = [(c, 0, "u", "hi") for c in range(5)] + [(9, 0, "u", "hi"), (9, 1, "a", "yo")]
    held = conversation_trie(spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("taken") for c in ("conv", "digest", "pos", "n", "key")}))
    assert sorted(r["ids"] for r in held.ends.collect()) == [[0, 1, 2, 3, 4], [9]]
    nodes = {(r["conv_id"], r["depth"]): r for r in held.nodes.collect()}
    assert set(nodes) == {(0, 0), (0, 1), (9, 2)}
    assert nodes[(0, 1)]["saved_tokens"] == 10 and nodes[(0, 0)]["n_leaves"] == 1 and nodes[(9, 2)]["parent_conv_id"] == 0


def test_empty_and_silent_tables(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).nodes.count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "u", "x")], SCHEMA)).nodes.count() == 0
    # Conversation 3 keeps none of its own turns and has no base.
    turns = placed(digested(spark.createDataFrame([(3, 0, "u", "x")], SCHEMA)))
    row = trie(*rebuilt(turns)).nodes.collect()
    assert len(row) == 1 and (row[0]["depth"], row[0]["n_convs"], row[0]["n_leaves"], row[0]["parent_conv_id"]) == (0, 1, 1, None)
