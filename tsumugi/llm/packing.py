"""Filling fixed-capacity containers with items.

Lengths are binned to ``BINS`` bins of the capacity (rounded up, so no container overflows) and
counted: a histogram of bounded size. Shallow combinations of up to three bins that fill a
window below the capacity are enumerated; non-negative least squares finds how often to use
each so that together they use up the histogram; the counts are rounded down and the residual
is packed greedily, largest first, best fit, many equal containers at a time. The plan has a
bounded number of rows; every item finds its container from its rank within its bin.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.session import cut

BINS = 1024
WINDOW = 3
MOST_PATTERNS = 40_000
STEPS = 400
#: A bin may hold a third of all rows: its ranks are counted in so many parts.
PARTS = 256


def patterns(have: np.ndarray, width: int, window: int = WINDOW, most: int = MOST_PATTERNS) -> tuple[np.ndarray, np.ndarray]:
    """(bins, times), three columns each: combinations of bins in ``have`` of total within
    ``window`` of ``width``; thinned evenly to ``most``, the fullest first."""
    found: list[np.ndarray] = []
    exists = np.zeros(width + 1, bool)
    exists[have] = True
    for times in range(1, width + 1):
        one = have[have * times <= width]
        if not len(one):
            break
        rest = width - one * times
        full = rest <= window
        found.append(np.stack([one[full], 0 * one[full], 0 * one[full], 0 * one[full] + times, 0 * one[full], 0 * one[full], rest[full]], 1))
        for again in range(1, 9):
            for gap in range(window + 1):
                two = (rest - gap) // again
                ok = (two >= 1) & ((rest - gap) % again == 0) & exists[np.maximum(two, 0)] & (two != one)
                n = ok.sum()
                found.append(np.stack([one[ok], two[ok], np.zeros(n, int), np.full(n, times), np.full(n, again), np.zeros(n, int), np.full(n, gap)], 1))
        if times <= 4:
            for j in have[:: max(1, len(have) // 128)]:
                for k in (1, 2, 3):
                    three = rest - k * j
                    ok = (three >= 1) & exists[np.maximum(three, 0)] & (three != one) & (three != j) & (one != j)
                    n = ok.sum()
                    found.append(np.stack([one[ok], np.full(n, j), three[ok], np.full(n, times), np.full(n, k), np.ones(n, int), np.zeros(n, int)], 1))
    p = np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 7), int)
    p = p[np.argsort(p[:, 6], kind="stable")]
    if len(p) > most:
        p = p[np.linspace(0, len(p) - 1, most).astype(int)]
    return p[:, :3], p[:, 3:6]


def nnls(bins: np.ndarray, times: np.ndarray, goal: np.ndarray, steps: int = STEPS) -> np.ndarray:
    """x >= 0 that minimises ||A x - goal||, A's columns the patterns; by accelerated projected
    gradient with a bound on the largest singular value."""
    if not len(bins):
        return np.empty(0)
    n, size = len(bins), len(goal)
    at = bins.ravel()
    t = times.astype(float)
    scale = 1 / np.sqrt((t * t).sum(1))
    forward = lambda x: np.bincount(at, (t * (x * scale)[:, None]).ravel(), size)
    back = lambda r: (t * r[bins]).sum(1) * scale
    v = np.random.default_rng(1).random(n)
    for _ in range(20):
        v = back(forward(v))
        norm = np.linalg.norm(v)
        v /= norm
    x = y = np.zeros(n)
    k = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - back(forward(y) - goal) / (1.05 * norm))
        k2 = (1 + np.sqrt(1 + 4 * k * k)) / 2
        y = new + (k - 1) / k2 * (new - x)
        x, k = new, k2
    return x * scale


def make_plan(counts: np.ndarray, width: int) -> pd.DataFrame:
    """Rows (bin, low, times, base): the items of a bin from rank ``low`` on, up to the next row
    of that bin, go to container base + (rank - low) // times. ``counts[b]``: items of bin b."""
    left = counts.astype(np.int64).copy()
    done = np.zeros_like(left)
    rows: list[tuple[int, int, int, int]] = []
    base = 0

    def use(which: list[tuple[int, int]], times: int) -> None:
        nonlocal base
        for b, m in which:
            rows.append((b, int(done[b]), m, base))
            done[b] += m * times
            left[b] -= m * times
        base += times

    have = np.flatnonzero(left)
    have = have[have > 0]
    bins, times = patterns(have, width)
    x = nnls(bins, times, left.astype(float))
    for i in np.argsort(-x, kind="stable"):
        n = int(x[i] + 1e-9)
        if n < 1:
            break
        which = [(int(b), int(m)) for b, m in zip(bins[i], times[i]) if m]
        n = min([n, *(int(left[b] // m) for b, m in which)])
        if n:
            use(which, n)
    while len(have := np.flatnonzero(left)):
        which, space = [], width
        while space > 0:
            k = np.searchsorted(have, space, "right") - 1
            if k < 0:
                break
            b = int(have[k])
            m = int(min(left[b], space // b))
            which.append((b, m))
            space -= m * b
            have = have[:k]
        use(which, max(1, min(int(left[b] // m) for b, m in which)))
    return pd.DataFrame(rows, columns=["bin", "low", "times", "base"], dtype=np.int64).sort_values(["bin", "low"], ignore_index=True)


def pack(items: DataFrame, capacity: int, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """(container_id, key, part, tokens): every item in containers of ``capacity``.

    An item larger than the capacity fills containers of its own and its rest is packed like an
    item, as the last part; no other item is divided. Items of null size or key are left out,
    as are sizes below 1. Repeated rows are items of their own. Two shuffles, of keys and sizes.
    """
    if capacity < 1:
        raise ValueError("capacity must be at least 1")
    unit = max(1, capacity // BINS)
    width = capacity // unit
    rows = items.select(F.col(f"`{key}`").alias("key"), F.col(f"`{size}`").cast("bigint").alias("s")).where("key is not null and s >= 1")
    kind = rows.schema["key"].dataType.simpleString()
    whole = rows.where(F.col("s") > capacity).select("key", F.posexplode(F.sequence(F.lit(1), F.expr(f"s div {capacity}"))).alias("p", "_"))
    full = whole.select(F.format_string("whole-%s-%d", F.col("key").cast("string"), F.col("p")).alias("container_id"), "key", F.col("p").cast("int").alias("part"), F.lit(capacity).cast("bigint").alias("tokens"))
    rest = rows.select("key", F.expr(f"cast(case when s > {capacity} then s div {capacity} else 0 end as int)").alias("part"), F.expr(f"case when s > {capacity} then s % {capacity} else s end").alias("tokens")).where("tokens > 0")
    # a capacity that is no multiple of the unit leaves less than one unit unused
    binned = rest.withColumn("bin", F.least(F.lit(width), F.expr(f"cast((tokens + {unit - 1}) div {unit} as int)"))).withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.lit(PARTS)).cast("int"))
    sizes = binned.groupBy("bin", "salt").agg(F.count("*").alias("n"))
    # at most BINS * PARTS rows; the histogram on the driver has at most BINS
    before = sizes.withColumn("before", F.sum("n").over(Window.partitionBy("bin").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).select("bin", "salt", F.coalesce("before", F.lit(0)).alias("before"))
    counts = np.zeros(width + 1, np.int64)
    for b, n in sizes.groupBy("bin").agg(F.sum("n")).collect():
        counts[b] = n
    plan = items.sparkSession.sparkContext.broadcast(make_plan(counts, width))
    ranked = binned.withColumn("rank", F.row_number().over(Window.partitionBy("bin", "salt").orderBy("key", "part")) - 1).join(before, ["bin", "salt"]).select("key", "part", "tokens", "bin", (F.col("rank") + F.col("before")).alias("rank"))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = plan.value
        far = np.int64(1) << 40
        starts = p["bin"].to_numpy() * far + p["low"].to_numpy()
        for pdf in batches:
            i = np.searchsorted(starts, pdf["bin"].to_numpy() * far + pdf["rank"].to_numpy(), "right") - 1
            c = p["base"].to_numpy()[i] + (pdf["rank"].to_numpy() - p["low"].to_numpy()[i]) // p["times"].to_numpy()[i]
            yield pd.DataFrame({"container_id": "mixed-" + pd.Series(c, index=pdf.index).astype(str), "key": pdf["key"], "part": pdf["part"], "tokens": pdf["tokens"]})

    placed = ranked.mapInPandas(place, f"container_id string, key {kind}, part int, tokens bigint")
    return full.withColumn("part", F.col("part") - 1).unionByName(placed).withColumnRenamed("key", key)


def pack_all(items: DataFrame, specs: DataFrame, key: str = "doc_id", size: str = "tokens") -> DataFrame:
    """:func:`pack` for every (spec_id, capacity_tokens); few rows, a plan each."""
    items = cut(items.select(key, size))  # the documents are read once, for all capacities
    parts = [pack(items, r.capacity_tokens, key, size).select(F.lit(r.spec_id).alias("spec_id"), "container_id", key, "part", "tokens") for r in specs.distinct().orderBy("spec_id").collect()]
    return reduce(DataFrame.unionByName, parts)
