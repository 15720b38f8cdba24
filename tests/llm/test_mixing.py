import random

import pytest

from tsumugi.llm import mixing


def docs(spark, rng, sizes):
    rows = [(k, s, rng.randint(1, 60)) for k, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    return rows, spark.createDataFrame(rows + [(-1, None, 5), (-2, "other", 5), (None, "a", 5), (-3, "a", None)], "doc_id long, source string, tokens int")


def test_shares_and_caps(spark):
    rng = random.Random(1)
    rows, df = docs(spark, rng, {"a": 3000, "b": 900, "c": 60})
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.3, 2), ("m", "c", 0.2, 4), ("n", "a", 1.0, 1), ("m", "gone", 0.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets).toPandas()
    m = got[got.mix_id == "m"]
    share = m.groupby("source").tokens.sum() / m.tokens.sum()
    assert share["a"] == pytest.approx(0.5, abs=0.005) and share["b"] == pytest.approx(0.3, abs=0.005) and share["c"] == pytest.approx(0.2, abs=0.005)
    assert m[m.source == "c"].groupby("doc_id").size().eq(4).all()  # the source that runs out first is used up
    assert not m.duplicated(["doc_id", "pass"]).any() and m["pass"].max() == 4
    assert m.virtual_finish.is_monotonic_increasing
    assert len(got[got.mix_id == "n"]) == 3000
    report = mixing.shares(mixing.mix(df, targets), targets).toPandas().set_index(["mix_id", "source"])
    assert report.loc[("m", "gone"), "uses"] == 0 and report.loc[("m", "c"), "repeats"] == 4


def test_budget_and_fair_order(spark):
    rows, df = docs(spark, random.Random(2), {"a": 2000, "b": 2000})
    targets = spark.createDataFrame([("m", "a", 0.75, 1), ("m", "b", 0.25, 1)], "mix_id string, source string, target_share double, max_repeats int")
    got = mixing.mix(df, targets, budget=8000).toPandas()
    assert got.tokens.sum() == pytest.approx(8000, abs=60)
    half = got.iloc[: len(got) // 2]
    assert half[half.source == "a"].tokens.sum() / half.tokens.sum() == pytest.approx(0.75, abs=0.05)


def test_order_does_not_depend_on_size(spark):
    sizes = [(k, "a", 10 if k % 10 else 900) for k in range(400)] + [(k, "b", 20) for k in range(400, 2400)]
    df = spark.createDataFrame(sizes, "doc_id long, source string, tokens int")
    even = spark.createDataFrame([(k, s, 1) for k, s, _ in sizes], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 1)], "mix_id string, source string, target_share double, max_repeats int")
    first = [r.doc_id for r in mixing.mix(df, targets).collect() if r.source == "a"]
    assert first == [r.doc_id for r in mixing.mix(even, targets).collect() if r.source == "a"][: len(first)]
    assert any(k % 10 == 0 for k in first)


def test_caps_bind_and_shortfalls_show(spark):
    rows, df = docs(spark, random.Random(3), {"a": 2000, "b": 100})
    targets = spark.createDataFrame([("m", "a", 0.5, 1), ("m", "b", 0.5, 3)], "mix_id string, source string, target_share double, max_repeats int")
    every = sum(r[2] for r in rows if r[1] == "a"), sum(r[2] for r in rows if r[1] == "b")
    mixed = mixing.mix(df, targets, budget=40_000)
    report = mixing.shares(mixed, targets).toPandas().set_index("source")
    assert report.tokens["b"] == 3 * every[1] and report.repeats["b"] == 3
    assert report.shortfall["b"] == pytest.approx(0.5 - 3 * every[1] / 40_000, abs=0.002) and report.shortfall["a"] == 0
    assert 40_000 - 60 <= report.tokens.sum() <= 40_000
    assert mixing.mix(df, targets, budget=10 * sum(every)).groupBy().sum("tokens").first()[0] == every[0] + 3 * every[1]


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, tokens int")
    targets = spark.createDataFrame([("m", "a", 1.0, 1)], "mix_id string, source string, target_share double, max_repeats int")
    assert mixing.mix(empty, targets).count() == 0
    assert mixing.shares(mixing.mix(empty, targets), targets).collect()[0].uses == 0
