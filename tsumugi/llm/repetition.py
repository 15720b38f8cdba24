"""Repetition inside a single document.

Rolling hashes of several n-gram lengths, in numpy over whole batches, find the n-grams and
lines that were said before in the same text; the share is the letters inside them over all
letters. Digits, punctuation, spacing, width and case do not matter. The first saying does not
count. N-grams may overlap, so a loop of any period of up to the shortest length counts too.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.letters import letter_codes, ngram_hashes

LENGTHS = (6, 9, 14, 24)
MIN_CHARS = 30
MIN_SHARE = 0.4
LINES = re.compile(r"(?<=[。．.！？!?\n])")


def _mark(where: np.ndarray, key: np.ndarray, doc: np.ndarray, length: np.ndarray, total: int, covered: np.ndarray) -> None:
    """Cover ``length`` letters from each place whose key stood before in its document."""
    if not len(where):
        return
    order = np.lexsort((where, key, doc))
    k, d = key[order], doc[order]
    again = np.zeros(len(order), bool)
    again[1:] = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    at = order[again]
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, where[at], 1)
    np.add.at(edge, where[at] + length[at], -1)
    covered |= np.cumsum(edge[:-1]) > 0


def shares(texts: list[str | None], lengths: tuple[int, ...] = LENGTHS) -> pd.DataFrame:
    """One row a text: letters, share of letters in repeated n-grams or lines, and each alone."""
    parts, line_at, line_len = [], [], []
    starts = np.zeros(len(texts) + 1, np.int64)
    line_doc = []
    at = 0
    for i, t in enumerate(texts):
        # a text's letters are those of its lines, so both kinds of evidence share their places
        pieces = [letter_codes(x, digits=False) for x in LINES.split(t or "")]
        here = at
        for p in pieces:
            if len(p) > 1:
                line_at.append(here)
                line_len.append(len(p))
                line_doc.append(i)
            here += len(p)
        codes = np.concatenate(pieces)
        parts.append(codes)
        at += len(codes)
        starts[i + 1] = at
    codes = np.concatenate(parts) if parts else np.empty(0, np.uint32)
    doc = np.repeat(np.arange(len(texts)), np.diff(starts))
    grams = np.zeros(at, bool)
    for n in lengths:
        h = ngram_hashes(codes, n)
        where = np.flatnonzero(doc[: len(h)] == doc[n - 1 :]) if len(h) else np.empty(0, np.int64)
        _mark(where, h[where], doc[where], np.full(len(where), n), at, grams)
    lines = np.zeros(at, bool)
    if line_at:
        la, ll = np.array(line_at), np.array(line_len)
        flat = np.repeat(la - np.concatenate(([0], np.cumsum(ll)[:-1])), ll) + np.arange(ll.sum())
        keys = codes[flat].tobytes()
        cut = np.concatenate(([0], np.cumsum(ll))) * 4
        h = np.array([hash(keys[cut[j] : cut[j + 1]]) for j in range(len(ll))], np.int64)
        _mark(la, h, np.array(line_doc), ll, at, lines)
    n = np.diff(starts)
    inside = lambda m: np.diff(np.concatenate(([0], np.cumsum(m)))[starts])
    safe = np.maximum(n, 1)
    return pd.DataFrame({"n_letters": n, "repeated_share": inside(grams | lines) / safe, "gram_share": inside(grams) / safe, "line_share": inside(lines) / safe})


def repetition(df: DataFrame, key: str, text: str, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """(key, n_chars, n_letters, repeated_share, gram_share, line_share), one row a row of ``df``.

    A null text has null n_chars, no letters and shares of 0; an empty text the same with
    n_chars 0. Whole texts count, however long. No shuffle.
    """
    src = df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    kind = src.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = shares(list(pdf["text"]), lengths)
            out.insert(0, "n_chars", pdf["text"].map(len, na_action="ignore").astype("Int64"))
            out.insert(0, "key", pdf["key"])
            yield out

    out = src.mapInPandas(run, f"key {kind}, n_chars bigint, n_letters bigint, repeated_share double, gram_share double, line_share double")
    return out.withColumnRenamed("key", key)
