import random

import numpy as np
import pytest

from tsumugi.llm import packing


@pytest.mark.parametrize("capacity", [1, 7, 100, 2048, 5000])
def test_round_trip(spark, capacity):
    rng = random.Random(capacity)
    sizes = [(k, rng.choice([1, 3, 50, 700, capacity, capacity + 1, 3 * capacity, rng.randint(1, 2 * capacity)])) for k in range(500)] + [(501, None), (None, 5), (502, 0), (503, -1)]
    df = spark.createDataFrame(sizes, "doc_id long, tokens int").selectExpr("*", "1 as bin", "2 as key")
    got = packing.pack(df, capacity).toPandas()
    assert list(got.columns) == ["container_id", "doc_id", "part", "tokens"]
    assert (got.groupby("container_id").tokens.sum() <= capacity).all() and (got.tokens > 0).all()
    real = {k: s for k, s in sizes if k is not None and s and s > 0}
    assert got.groupby("doc_id").tokens.sum().to_dict() == real
    pieces = got.groupby("doc_id").size()
    assert all(n == -(-real[k] // capacity) for k, n in pieces.items())
    assert not got.duplicated(["doc_id", "part"]).any()


def test_little_space_is_left(spark):
    rng = random.Random(4)
    sizes = [(k, int(rng.lognormvariate(6.2, 0.8)) + 1) for k in range(4000)]
    got = packing.pack(spark.createDataFrame(sizes, "doc_id long, tokens int"), 4096).toPandas()
    assert got.tokens.sum() / (got.container_id.nunique() * 4096) > 0.985


def test_one_size_has_all_rows(spark):
    got = packing.pack(spark.range(3000).selectExpr("id as doc_id", "100 as tokens"), 1000).toPandas()
    assert got.container_id.nunique() == 300
    same = packing.pack(spark.createDataFrame([(1, 5)] * 4, "doc_id long, tokens int"), 10).toPandas()
    assert same.container_id.nunique() == 2 and len(same) == 4


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), 10).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, tokens int"), 0)


def test_nnls():
    bins, times = np.array([[1, 2, 0], [3, 0, 0], [1, 3, 0]]), np.array([[1, 1, 0], [2, 0, 0], [1, 1, 0]])
    x = packing.nnls(bins, times, np.array([0.0, 5, 3, 6]), steps=3000)
    assert (x >= 0).all() and np.allclose(x, [3, 2, 2], atol=0.05)
