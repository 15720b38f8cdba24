"""Evaluation texts leaking into training text.

Latent semantic retrieval. Documents and test items are cut into overlapping passages of
letters; a passage is a TF-IDF vector of hashed letter 4-grams, with document counts from the
whole corpus. A distributed randomised SVD of the test passages gives a latent space; corpus
passages are folded into it and searched by cosine against every test passage. A low-rank space
loses short stretches between other test letters, whatever the cosine, so every place of the corpus
is also looked up among the items' stretches: a shared unbroken stretch of letters is a leak at any
cosine. Other candidates are paraphrases if the longest common subsequence and the answer check
bear out the cosine: how many of the item's own words, its rarest 4-grams in the corpus, the
passage holds.

What makes it scale: columns are the hash buckets of the test items' 4-grams (at most
``BUCKETS``, and what a block of items holds), so what is sent to the executors has a proven bound and does not grow with the
corpus; the corpus is read twice (counts, search) and never shuffled. A passage with fewer test
4-grams than a stretch holds cannot hold one and is not searched. Test sets
larger than a block are searched block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.letters import keep_table, letter_codes, letters, ngram_hashes

GRAM = 4
BUCKETS = 1 << 20
#: Letters of a shared stretch that make a leak.
STRETCH = 16
#: Letters and step of passages; any stretch lies whole in a passage of either side.
DOC_WINDOW, DOC_STEP = 48, 32
ITEM_WINDOW, ITEM_STEP = 32, 16
RANK, OVERSAMPLE, POWER = 96, 16, 2
#: A paraphrase: the least cosine and common subsequence, and the least sum of both and the share
#: of the item's own words (each from 0 to 1). Set on planted paraphrases: 70 of 74 lie above.
PARAPHRASE_COSINE, PARAPHRASE_LCS, PARAPHRASE_SUM = 0.65, 0.5, 1.6
#: Test 4-grams from which a passage is searched for paraphrases: one with fewer shares no wording.
LEAST = 4
#: Test passages searched at once: a block has at most BLOCK * ITEM_STEP different 4-grams, so its
#: basis takes at most 58 MB; cosines of CHUNK corpus passages with all of a block take 65 MB.
BLOCK, CHUNK = 8_000, 2_048
SEED = 20240229


def windows(n: int, size: int, step: int) -> np.ndarray:
    """Starts of the passages of a text of ``n`` letters; each stretch of size - step lies in one."""
    return np.arange(0, max(1, n - size + step), step)


def buckets(codes: np.ndarray) -> np.ndarray:
    return (ngram_hashes(codes, GRAM) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Space:
    """What the executors get: bounded by BUCKETS, BLOCK and RANK."""

    column: np.ndarray  # bucket -> column, -1 for none
    idf: np.ndarray  # by column
    basis: np.ndarray  # column x rank
    item: np.ndarray  # by test passage: number of its item
    latent: np.ndarray  # test passage x rank, unit rows
    stretch: np.ndarray  # sorted hashes of the items' stretches
    stretch_item: np.ndarray
    ids: list[str]
    texts: list[str]  # letters of each item's fields
    passages: np.ndarray  # test passage x letters, -1 for none
    own: np.ndarray  # test passage x buckets of the rarer half of its 4-grams


def _matrix(passages: list[np.ndarray], column: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF of the passages (arrays of buckets) as (row, column, value)."""
    sizes = np.array([len(p) for p in passages])
    row = np.repeat(np.arange(len(passages)), sizes)
    col = column[np.concatenate(passages)] if len(passages) else np.empty(0, np.int64)
    seen = col >= 0
    key, n = np.unique(row[seen] * len(idf) + col[seen], return_counts=True)
    r, c = np.divmod(key, max(len(idf), 1))
    v = (1 + np.log(n)) * idf[c]
    norm = np.sqrt(np.bincount(r, v * v, len(passages)))
    return r, c, v / np.maximum(norm[r], 1e-12)


def _times(r: np.ndarray, c: np.ndarray, v: np.ndarray, dense: np.ndarray, rows: int) -> np.ndarray:
    """Sparse (sorted by row) x dense."""
    out = np.zeros((rows, dense.shape[1]), np.float32)
    if len(r):
        starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
        out[r[starts]] = np.add.reduceat(dense[c] * v[:, None].astype(np.float32), starts, axis=0)
    return out


def _item_passages(text: str) -> list[np.ndarray]:
    """Letters of the passages of an item's field."""
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return [codes[s : s + ITEM_WINDOW] for s in windows(len(codes), ITEM_WINDOW, ITEM_STEP)]


def corpus_counts(docs: DataFrame, text: str, column: np.ndarray) -> tuple[np.ndarray, int]:
    """In how many passages of the whole corpus each column's bucket stands, and all passages."""
    shared = docs.sparkSession.sparkContext.broadcast(column)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        col = shared.value
        total, n = np.zeros(int(col.max(initial=-1)) + 1, np.int64), 0
        for pdf in batches:
            for codes, doc in _stacked(pdf["t"]):
                b = col[buckets(codes)]
                at = np.flatnonzero(b >= 0)
                at = at[doc[at] == doc[at + GRAM - 1]]
                # passages of DOC_STEP letters that do not overlap: each place counts once
                part = at // DOC_STEP
                total += np.bincount(np.unique(part * len(total) + b[at]) % max(len(total), 1), minlength=len(total)) if len(total) else 0
                n += len(codes) // DOC_STEP + 1
        k = np.flatnonzero(total)
        yield pd.DataFrame({"k": np.append(k, -1), "n": np.append(total[k], n)})

    found = docs.select(F.col(text).cast("string").alias("t")).mapInPandas(run, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # a row a column
    out = np.zeros(int(column.max(initial=-1)) + 1, np.int64)
    own = found[found["k"] >= 0]
    out[own["k"].to_numpy()] = own["n"].to_numpy()
    return out, int(found.loc[found["k"] == -1, "n"].sum())


def _stacked(texts: pd.Series, most: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Letters of many texts in one array, with the number of the text of each letter."""
    parts: list[np.ndarray] = []
    who: list[int] = []
    size = 0
    for i, t in enumerate(texts):
        c = letter_codes(t)
        parts.append(c)
        who.append(i)
        size += len(c)
        if size >= most:
            yield np.concatenate(parts), np.repeat(who, [len(p) for p in parts])
            parts, who, size = [], [], 0
    if parts:
        yield np.concatenate(parts), np.repeat(who, [len(p) for p in parts])


def latent_space(spark, passages: list[np.ndarray], column: np.ndarray, idf: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the passages' TF-IDF matrix, by a distributed randomised SVD.

    Rows are spread over the cluster; each task multiplies its rows with the small random matrix
    and back, and the partial products, one a task and all of one bounded size, are added.
    """
    k = min(rank + OVERSAMPLE, len(passages), len(idf))
    rng = np.random.default_rng(SEED)
    q = rng.standard_normal((len(idf), k)).astype(np.float32)
    sc = spark.sparkContext
    per = max(512, -(-len(passages) // 16))
    blocks = [passages[i : i + per] for i in range(0, len(passages), per)]
    rows = sc.parallelize([_matrix(b, column, idf) + (len(b),) for b in blocks], len(blocks))
    for _ in range(POWER):
        shared = sc.broadcast(np.linalg.qr(q)[0].astype(np.float32))

        def part(x, shared=shared):
            r, c, v, n = x
            y = _times(r, c, v, shared.value, n)
            order = np.argsort(c, kind="stable")
            return _times(c[order], r[order], v[order], y, shared.value.shape[0])

        q = rows.map(part).treeReduce(lambda a, b: a + b)
    q = np.linalg.qr(q)[0].astype(np.float32)
    shared = sc.broadcast(q)

    def gram(x, shared=shared):
        y = _times(x[0], x[1], x[2], shared.value, x[3]).astype(np.float64)
        return y.T @ y

    values, turn = np.linalg.eigh(rows.map(gram).treeReduce(lambda a, b: a + b))
    return (q @ turn[:, ::-1][:, : min(rank, k)]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def _padded(rows: list[np.ndarray], width: int) -> np.ndarray:
    out = np.full((len(rows), width), -1, np.int64)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def build_space(docs: DataFrame, text: str, items: pd.DataFrame, rank: int = RANK) -> Space:
    """The latent space of one block of items (item_id, text), with counts over all documents."""
    ids = list(dict.fromkeys(items["item_id"]))
    number = {x: i for i, x in enumerate(ids)}
    parts, owner, hashes, whose, texts = [], [], [], [], []
    for item_id, t in zip(items["item_id"], items["text"]):
        t = letters(t)
        texts.append((number[item_id], t))
        if len(t) < STRETCH:
            continue
        own = _item_passages(t)
        parts += own
        owner += [number[item_id]] * len(own)
        h = np.unique(ngram_hashes(np.frombuffer(t.encode("utf-32-le"), np.uint32), STRETCH))
        hashes.append(h)
        whose.append(np.full(len(h), number[item_id]))
    passages = [buckets(p) for p in parts]
    column = np.full(BUCKETS, -1, np.int32)
    used = np.unique(np.concatenate(passages)) if passages else np.empty(0, np.int64)
    column[used] = np.arange(len(used))
    df, n = corpus_counts(docs, text, column)
    idf = np.log((1 + n) / (1 + df)).astype(np.float32) + 0.1
    basis = latent_space(docs.sparkSession, passages, column, idf, rank) if passages else np.zeros((0, 1), np.float32)
    latent = _unit(_times(*_matrix(passages, column, idf), basis, len(passages))) if passages else np.zeros((0, 1), np.float32)
    h, w = (np.concatenate(hashes), np.concatenate(whose)) if hashes else (np.empty(0, np.uint64), np.empty(0, np.int64))
    order = np.argsort(h, kind="stable")
    joined = [""] * len(ids)
    for i, t in texts:
        joined[i] += t + "\n"
    rare = []
    for p in passages:
        grams = np.unique(p)
        rare.append(grams[idf[column[grams]] >= np.median(idf[column[grams]])] if len(grams) else grams)
    return Space(column, idf, basis, np.array(owner, np.int64), latent, h[order], w[order], ids, joined, _padded(parts, ITEM_WINDOW), _padded(rare, ITEM_WINDOW))


def search(space: Space, codes: np.ndarray, doc: np.ndarray, min_cosine: float = PARAPHRASE_COSINE, least: int = STRETCH - GRAM + 1) -> tuple[np.ndarray, ...]:
    """Candidates of stacked documents: passage start, its length, its document, item, cosine, and
    whether they share a stretch, and the item's nearest passage; those that share one come at
    any cosine, others from ``min_cosine``. ``least``: test 4-grams from which a passage is searched; a stretch has the default."""
    none = (np.empty(0, np.int64),) * 4 + (np.empty(0, np.float32), np.empty(0, bool), np.empty(0, np.int64))
    if not len(codes) or not len(space.item):
        return none
    edges = np.flatnonzero(np.diff(doc)) + 1
    begins, ends = np.concatenate(([0], edges)), np.concatenate((edges, [len(doc)]))
    count = np.maximum(1, -(-(ends - begins - DOC_WINDOW + DOC_STEP) // DOC_STEP))
    before = np.cumsum(count) - count
    starts = np.repeat(begins, count) + DOC_STEP * (np.arange(count.sum()) - np.repeat(before, count))
    stops = np.minimum(starts + DOC_WINDOW, np.repeat(ends, count))
    col = space.column[buckets(codes)]
    if not len(col):
        return none
    hits = np.concatenate(([0], np.cumsum(col >= 0)))
    last = np.maximum(np.minimum(stops - GRAM + 1, len(col)), starts)
    worth = np.flatnonzero(hits[last] - hits[starts] >= least)
    if not len(worth):
        return none
    place, leaked = _stretches(space, codes, doc, hits)
    own = np.searchsorted(begins, place, "right") - 1
    holder = np.searchsorted(worth, before[own] + np.minimum((place - begins[own]) // DOC_STEP, count[own] - 1))
    starts, last, stops = starts[worth], last[worth], stops[worth]
    order = np.argsort(space.item, kind="stable")
    latent = space.latent[order].T
    known, bounds = np.unique(space.item[order], return_index=True)
    out = []
    for a in range(0, len(starts), CHUNK):
        s, e = starts[a : a + CHUNK], last[a : a + CHUNK]
        size = e - s
        at = np.repeat(s - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        row, c = np.repeat(np.arange(len(s)), size), col[at]
        seen = c >= 0
        key, n = np.unique(row[seen] * len(space.idf) + c[seen], return_counts=True)
        r, c = np.divmod(key, len(space.idf))
        z = _unit(_times(r, c, (1 + np.log(n)) * space.idf[c], space.basis, len(s)))
        every = z @ latent
        cos = np.maximum.reduceat(every, bounds, axis=1)  # the best passage of each item
        held = (holder >= a) & (holder < a + len(s))
        leak = np.zeros(cos.shape, bool)
        leak[holder[held] - a, np.searchsorted(known, leaked[held])] = True
        p, q = np.nonzero((cos >= min_cosine) | leak)
        ends_ = np.append(bounds, len(order))
        best, top = ends_[q], every[p, ends_[q]]
        for k in range(1, int((ends_[1:] - ends_[:-1]).max())):  # the passages of an item, one after the other
            at = np.minimum(ends_[q] + k, ends_[q + 1] - 1)
            better = every[p, at] > top
            best, top = np.where(better, at, best), np.where(better, every[p, at], top)
        best = order[best]
        out.append((s[p], stops[a : a + CHUNK][p] - s[p], doc[s[p]], known[q], cos[p, q], leak[p, q], best))
    return tuple(np.concatenate(x) for x in zip(*out))


def _stretches(space: Space, codes: np.ndarray, doc: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every place of a stretch of an item, with the item: hash lookup, then letter by letter.

    ``hits``: running number of places with a test 4-gram; a stretch has one at each."""
    grams = STRETCH - GRAM + 1
    at = np.flatnonzero(hits[grams:] - hits[:-grams] == grams)
    at = at[doc[at] == doc[at + STRETCH - 1]]
    if not len(at) or not len(space.stretch):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = ngram_hashes(codes, STRETCH)[at]
    lo = np.searchsorted(space.stretch, h, "left")
    m = np.searchsorted(space.stretch, h, "right") - lo
    each = np.repeat(lo - (np.cumsum(m) - m), m) + np.arange(m.sum())
    place, item = np.repeat(at, m), space.stretch_item[each]
    true = np.array([codes[w : w + STRETCH].tobytes().decode("utf-32-le") in space.texts[k] for w, k in zip(place.tolist(), item.tolist())], bool)
    return place[true], item[true]


def _blocks(items: DataFrame) -> Iterator[pd.DataFrame]:
    """The test items, block by block, each of bounded size, in order of item."""
    sized = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and length(text) > 0").distinct()
    letters_all = sized.agg(F.sum(F.length("text"))).first()[0] or 0
    n = int(letters_all // (BLOCK * ITEM_STEP)) + 1
    for i in range(n):
        part = sized if n == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        yield part.toPandas().sort_values(["item_id", "text"])


def find_leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", paraphrases: bool = False) -> DataFrame:
    """(key, item_id) of the documents that hold a stretch of ``STRETCH`` letters of an item.

    ``items``: item_id, text (one row a field). With ``paraphrases``: (key, item_id, kind,
    cosine, lcs, answer), also of passages without a stretch near an item in the latent space;
    ``lcs`` is the share of the item passage's letters in order, ``answer`` that of its own words
    in the passage, both 1 of a leak; the three together decide.
    Null keys, null and empty texts give nothing; a text or item shorter than a stretch cannot
    leak. Whole texts are searched; rows repeated give one row.
    """
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t")).where("key is not null and t is not null")
    kind = src.schema["key"].dataType.simpleString()
    out = None
    for block in _blocks(items):
        space = docs.sparkSession.sparkContext.broadcast(build_space(src, "t", block))

        def run(batches: Iterator[pd.DataFrame], space=space) -> Iterator[pd.DataFrame]:
            keep_table()
            s = space.value
            for pdf in batches:
                for codes, doc in _stacked(pdf["t"]):
                    start, size, d, item, cos, leak, best = search(s, codes, doc, PARAPHRASE_COSINE, LEAST if paraphrases else STRETCH - GRAM + 1)
                    found = pd.DataFrame({"d": d, "item": item, "kind": "verbatim", "cosine": cos, "lcs": 1.0, "answer": 1.0})[leak]
                    if paraphrases:
                        near = np.flatnonzero(~leak)
                        lcs, answer = _likeness(s, codes, start[near], size[near], best[near])
                        good = (lcs >= PARAPHRASE_LCS) & (cos[near] + lcs + answer >= PARAPHRASE_SUM)
                        near = near[good]
                        found = pd.concat([found, pd.DataFrame({"d": d[near], "item": item[near], "kind": "paraphrase", "cosine": cos[near], "lcs": lcs[good], "answer": answer[good]})])
                    found = found.sort_values(["kind", "cosine"], ascending=[False, False]).drop_duplicates(["d", "item"])
                    yield pd.DataFrame({"key": pdf["key"].to_numpy()[found["d"].to_numpy(np.int64)], "item_id": pd.Series([s.ids[i] for i in found["item"]], dtype=object), "kind": pd.Series(list(found["kind"]), dtype=object), "cosine": found["cosine"].to_numpy(float), "lcs": found["lcs"].to_numpy(float), "answer": found["answer"].to_numpy(float)})

        part = src.mapInPandas(run, f"key {kind}, item_id string, kind string, cosine double, lcs double, answer double")
        out = part if out is None else out.unionByName(part)
    pairs = out.groupBy("key", "item_id").agg(F.max("kind").alias("kind"), F.max("cosine").alias("cosine"), F.max("lcs").alias("lcs"), F.max("answer").alias("answer")).withColumnRenamed("key", key)
    return pairs if paraphrases else pairs.select(key, "item_id")


def _likeness(space: Space, codes: np.ndarray, start: np.ndarray, size: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By pair of a corpus passage and an item passage: the share of the item passage's letters
    that stand in order in the corpus passage, and the share of its own words, the rarer half of
    its 4-grams, that stand in it."""
    lcs, answer = np.zeros(len(best)), np.zeros(len(best))
    for a in range(0, len(best), CHUNK):
        at, n, b = start[a : a + CHUNK], size[a : a + CHUNK], best[a : a + CHUNK]
        where = at[:, None] + np.arange(DOC_WINDOW)
        inside = np.arange(DOC_WINDOW) < n[:, None]
        text = np.where(inside, codes[np.minimum(where, len(codes) - 1)].astype(np.int64), -1)
        wanted, own = space.passages[b], space.own[b]
        lcs[a : a + CHUNK] = _in_order(wanted, text) / np.maximum(1, (wanted >= 0).sum(1))
        grams = buckets(text.astype(np.uint32).ravel())  # those over the edge of a passage are left out
        grams = np.append(grams, [-1] * (GRAM - 1)).reshape(text.shape)[:, : DOC_WINDOW - GRAM + 1]
        grams = np.where(inside[:, GRAM - 1 :], grams, -1)
        held = ((own[:, :, None] == grams[:, None, :]).any(2) & (own >= 0)).sum(1)
        answer[a : a + CHUNK] = held / np.maximum(1, (own >= 0).sum(1))
    return lcs, answer


def _in_order(wanted: np.ndarray, text: np.ndarray) -> np.ndarray:
    """By row, the length of the longest common subsequence of two arrays of codes, -1 being no
    code; the first has at most 63 columns. Bit-parallel, all rows at once."""
    bits = np.uint64(1) << np.arange(wanted.shape[1], dtype=np.uint64)
    full = np.where(wanted >= 0, bits, np.uint64(0)).sum(1, dtype=np.uint64)
    v = full.copy()
    for j in range(text.shape[1]):
        m = np.where((wanted == text[:, j : j + 1]) & (wanted >= 0), bits, np.uint64(0)).sum(1, dtype=np.uint64)
        u = v & m
        v = ((v + u) | (v - u)) & full
    return np.bitwise_count(full).astype(np.int64) - np.bitwise_count(v)
