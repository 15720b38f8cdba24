"""Share of an item's character n-grams that stand in a corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.letters import code_points, ngram_hashes
from tsumugi.functions.text import ngram_set
from tsumugi.session import cut

#: Distinct grams of the items up to which their hashes are collected and broadcast: 8 MB.
MOST_GRAMS = 1 << 20


def _hits_by_join(grams: DataFrame, corpus: DataFrame, text: str, n: int) -> DataFrame:
    found = corpus.select(F.explode(ngram_set(text, n)).alias("g")).join(grams.select("g").distinct(), "g", "left_semi")
    return found.distinct()


def leak_ratios(items: DataFrame, corpus: DataFrame, text: str = "text", n: int = 8, most: int = MOST_GRAMS) -> DataFrame:
    """(id, n_grams, n_hits, ratio) of items (id, text): distinct grams, those in the corpus.

    An item shorter than ``n``, empty or null has no grams and a null ratio. The corpus is
    scanned once: where the items' grams are few (counted first) their hashes are broadcast and
    each task keeps those it meets, exact grams deciding in the end; else grams are joined.
    """
    grams = items.select("id", F.explode(ngram_set(F.coalesce(F.col("text"), F.lit("")), n)).alias("g"))
    sizes = items.select("id", F.size(ngram_set(F.coalesce(F.col("text"), F.lit("")), n)).alias("n_grams"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            own = [ngram_hashes(code_points(g), n) for g in pdf["g"]]
            yield pd.DataFrame({"h": np.unique(np.concatenate(own or [np.empty(0, np.uint64)])).view(np.int64)})

    known = cut(grams.select("g").mapInPandas(hashed, "h bigint").distinct())
    if known.count() > most:
        seen = _hits_by_join(grams, corpus, text, n)
    else:
        hashes = np.sort(known.toPandas()["h"].to_numpy(np.int64).view(np.uint64))  # counted: at most ``most``
        shared = corpus.sparkSession.sparkContext.broadcast(hashes)

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            met: set[str] = set()
            for pdf in batches:
                new = set()
                for t in pdf["t"]:
                    if t and len(t) >= n and len(shared.value):
                        h = ngram_hashes(code_points(t), n)
                        at = np.searchsorted(shared.value, h)
                        hit = np.flatnonzero(shared.value[np.minimum(at, len(shared.value) - 1)] == h)
                        new.update(t[i : i + n] for i in hit.tolist())
                yield pd.DataFrame({"g": sorted(new - met)}, dtype=str)
                met |= new

        seen = corpus.select(F.col(text).alias("t")).mapInPandas(scan, "g string").distinct()
    hits = grams.join(seen, "g", "left_semi").groupBy("id").agg(F.count("*").alias("n_hits"))
    out = sizes.join(hits, "id", "left").na.fill({"n_hits": 0})
    return out.select("id", "n_grams", "n_hits", F.when(F.col("n_grams") > 0, F.bround(F.col("n_hits") / F.col("n_grams"), 6)).alias("ratio"))
