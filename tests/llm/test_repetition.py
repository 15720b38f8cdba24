import random

import pytest

from tsumugi.functions.letters import letters
from tsumugi.llm import repetition


def brute(text, lengths):
    t = letters(text, digits=False)
    covered = [False] * len(t)
    for n in lengths:
        seen = set()
        for i in range(len(t) - n + 1):
            g = t[i : i + n]
            if g in seen:
                covered[i : i + n] = [True] * n
            seen.add(g)
    return sum(covered) / max(1, len(t))


def test_grams_by_brute_force():
    rng = random.Random(3)
    texts = ["".join(rng.choice("あいう、1 ") for _ in range(rng.randint(0, 120))) for _ in range(60)] + [None, "", "。。。"]
    got = repetition.shares(texts)
    for t, share in zip(texts, got["gram_share"]):
        assert share == pytest.approx(brute(t, repetition.LENGTHS))


def test_lines_and_numbering():
    got = repetition.shares(["1. 水を飲む\n2. 水を飲む\n3. 水を飲む\n", "はい。はい。はい。はい。", "水を飲む。火を消す。"])
    assert got["repeated_share"].round(3).tolist() == [0.667, 0.75, 0.0]


def test_table(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "猫が好きな人の話です。" * 30_000, "k"), (4, "短い", "k"), (4, "短い", "k")], "row_id long, response string, n_chars string")
    got = {r.row_id: r for r in repetition.repetition(df, "row_id", "response").collect()}
    assert got[1].n_chars is None and got[2].n_chars == 0 and got[3].repeated_share > 0.99 and got[4].repeated_share == 0
    assert repetition.repetition(df.limit(0), "row_id", "response").count() == 0
