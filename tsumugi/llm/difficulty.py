"""Reading level of each document.

Every sentence of the main text gets a level by two regularised linear models, one over letter
pairs and one over words (runs of one script) and sentence length; the sentences' level
distributions, weighted by their letters, give the document's distribution, which is calibrated
on labelled documents held out of the fit. Quotes are set apart: they are not main text.

The fit uses a bounded sample of labelled documents (``SAMPLE_DOCS``, ``SAMPLE_SENTENCES`` a
document) on the driver; the model is two arrays of fixed size. All documents are scored, whole,
in numpy over Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = 5
BUCKETS = 1 << 17
SAMPLE_DOCS, SAMPLE_SENTENCES = 1200, 24
GRAMS = (2,)
EPOCHS, RATE, PENALTY = 40, 0.5, 1e-5
SCALE = 12.0
#: Share of kana among letters from which a text is Japanese.
KANA_SHARE = 0.1
#: Quotes in brackets, also over lines; an opening 【引用】 that is never closed quotes its line.
BRACKETS = r"「[^「」]*」|『[^『』]*』|“[^“”]*”|\"[^\"\n]*\"|【引用】(?:(?!【引用】).)*?【/引用】"
QUOTES = re.compile(BRACKETS + r"|^[>＞|｜][^\n]*", re.M | re.S)
NESTED, UNCLOSED = re.compile(BRACKETS, re.S), re.compile(r"【引用】[^\n]*")
MARKUP = re.compile(r"<[^<>]{0,200}>|https?://\S+")
SENTENCE_END = np.array([ord(x) for x in "。!?\n"], np.uint32)


def main_text(text: str | None) -> str:
    """The text without quotes and markup, in compatibility form; where quotes are nearly all
    of it, the quotes are the text."""
    if not text:
        return ""
    t = unicodedata.normalize("NFKC", text)
    if "<" in t or "://" in t:
        t = MARKUP.sub("", t)
    body = QUOTES.sub("", t) if any(x in t for x in "「『“\"|>") or "【引用】" in t else t
    while body != t and (inner := NESTED.sub("", body)) != body:  # quotes inside quotes, from the inside out
        body = inner
    body = UNCLOSED.sub("", body)
    return body if len(body) >= 0.1 * len(t) else t


def _script() -> np.ndarray:
    s = np.zeros(0x110000, np.uint8)
    s[0x30:0x3A], s[0x41:0x5B], s[0x61:0x7B] = 1, 2, 2
    s[0xC0:0x250] = 2
    s[0x3041:0x309F] = 3
    s[0x30A1:0x30FF] = 4
    s[0x4E00:0xA000] = s[0x3400:0x4DC0] = s[0x3005:0x3008] = 5
    return s


SCRIPT = _script()


def _stack(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, sentence numbers, and the document of each sentence."""
    cp = np.frombuffer("".join(f"{t}\n" for t in texts).encode("utf-32-le", "replace"), np.uint32)
    stop = np.isin(cp, SENTENCE_END)
    sentence = np.concatenate(([0], np.cumsum(stop)[:-1])) if len(cp) else np.empty(0, np.int64)
    doc = np.repeat(np.arange(len(texts)), [len(t) + 1 for t in texts])
    keep = ~stop & (cp != 32) & (cp != 0x3000)
    return cp[keep], sentence[keep], doc[keep]


def _features(cp: np.ndarray, sentence: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(bucket, sentence) of the letter n-grams and of the words."""
    kind = SCRIPT[cp]
    # names and numbers tell nothing: katakana and digits count by kind
    c = np.where(kind == 4, 0x30A2, np.where(kind == 1, 48, cp)).astype(np.uint32)
    mask = np.uint32(BUCKETS - 1)
    grams, where = [], []
    for n in GRAMS:
        size = max(0, len(c) - n + 1)
        h = np.zeros(size, np.uint32)
        for i in range(n):
            h = (h + c[i : i + size] + np.uint32(n)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        ok = sentence[:size] == sentence[n - 1 :]
        grams.append((h[ok] & mask).astype(np.int64))
        where.append(sentence[:size][ok])
    letters = (np.concatenate(grams), np.concatenate(where)) if grams else (np.empty(0, np.int64), np.empty(0, np.int64))
    if not len(c):
        return letters, letters
    start = np.flatnonzero(np.concatenate(([True], (kind[1:] != kind[:-1]) | (sentence[1:] != sentence[:-1]))))
    at = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c))))
    mixed = (c + at.astype(np.uint32) * np.uint32(0x85EBCA6B)) * np.uint32(0xC2B2AE35)
    word = np.add.reduceat(mixed ^ (mixed >> np.uint32(13)), start)
    own = sentence[start]
    pair = (word[:-1] * np.uint32(31) + word[1:])[own[1:] == own[:-1]]
    first = np.flatnonzero(np.concatenate(([True], sentence[1:] != sentence[:-1])))
    size = np.log2(np.diff(np.append(first, len(c))) + 1).astype(np.uint32) * np.uint32(7919) + np.uint32(11)
    words = np.concatenate((word, pair, np.repeat(size, 4))) & mask
    words = words.astype(np.int64)
    return letters, (words, np.concatenate((own, own[1:][own[1:] == own[:-1]], np.repeat(sentence[first], 4))))


def _means(buckets: np.ndarray, row: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """Mean weight of each row's buckets, by level."""
    out = np.stack([np.bincount(row, weights[k][buckets], rows) for k in range(len(weights))], 1)
    return SCALE * out / np.maximum(np.bincount(row, minlength=rows), 1)[:, None]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def _fit(buckets: np.ndarray, row: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """L2-regularised multinomial regression by full-batch AdaGrad; deterministic."""
    used, b = np.unique(buckets, return_inverse=True)
    per = SCALE / np.maximum(np.bincount(row, minlength=len(y)), 1)
    w, bias = np.zeros((len(used), LEVELS)), np.zeros(LEVELS)
    past = np.full((len(used), LEVELS), 1e-8)
    goal = np.eye(LEVELS)[y]
    total = weight.sum()
    for _ in range(EPOCHS):
        p = _softmax(np.stack([np.bincount(row, w[b, k], len(y)) for k in range(LEVELS)], 1) * per[:, None] + bias)
        error = (p - goal) * weight[:, None] / total
        g = np.stack([np.bincount(b, (error[:, k] * per)[row], len(used)) for k in range(LEVELS)], 1) + PENALTY * w
        past += g * g
        w -= RATE * g / np.sqrt(past)
        bias -= RATE * error.sum(0)
    full = np.zeros((LEVELS, BUCKETS))
    full[:, used] = w.T
    return full, bias


@dataclass
class Model:
    letters: np.ndarray
    letters_bias: np.ndarray
    words: np.ndarray
    words_bias: np.ndarray
    turn: np.ndarray  # calibration: features of a document -> logits of its levels


def distributions(texts: list[str], m: Model) -> tuple[np.ndarray, np.ndarray]:
    """Level distribution of each text (rows of zeros for no letters) and its sentences."""
    cp, sentence, doc = _stack(texts)
    out, n = np.zeros((len(texts), LEVELS)), np.zeros(len(texts), np.int64)
    if not len(cp):
        return out, n
    ids, s = np.unique(sentence, return_inverse=True)
    (a, ra), (b, rb) = _features(cp, s)
    p = _softmax(_means(a, ra, m.letters, len(ids)) + m.letters_bias) + _softmax(_means(b, rb, m.words, len(ids)) + m.words_bias)
    first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
    size = np.diff(np.append(first, len(s)))
    owner = doc[first]
    for k in range(LEVELS):
        out[:, k] = np.bincount(owner, p[:, k] * size, len(texts))
    return out / np.maximum(out.sum(1, keepdims=True), 1e-12), np.bincount(owner, minlength=len(texts))


def _inputs(d: np.ndarray) -> np.ndarray:
    """What the calibration sees of a distribution: shares, and shares at or above each level."""
    above = d[:, ::-1].cumsum(1)[:, ::-1]
    return np.concatenate((d, above[:, 1:], np.ones((len(d), 1))), 1)


def _calibrate(d: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, goal = _inputs(d), np.eye(LEVELS)[y]
    w = np.zeros((x.shape[1], LEVELS))
    past = np.full(w.shape, 1e-8)
    for _ in range(800):
        g = x.T @ (_softmax(x @ w) - goal) / len(y) + 1e-4 * w
        past += g * g
        w -= 0.5 * g / np.sqrt(past)
    return w


def fit(texts: list[str], levels: list[int]) -> Model:
    """A model from labelled texts; a fifth of them is held out of the sentence models for the
    calibration."""
    y = np.array(levels) - 1
    bodies = [main_text(t) for t in texts]
    held = np.zeros(len(y), bool)
    for k in range(LEVELS):  # a fifth of each level, whatever the order of the texts
        held[np.flatnonzero(y == k)[2::5]] = True

    def train(which: np.ndarray) -> Model:
        cp, sentence, doc = _stack([bodies[i] for i in np.flatnonzero(which)])
        ids, s = np.unique(sentence, return_inverse=True)
        first = np.concatenate(([0], np.flatnonzero(np.diff(s)) + 1))
        owner = doc[first]
        rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
        many = np.bincount(owner)[owner]
        pick = rank * SAMPLE_SENTENCES // np.maximum(many, SAMPLE_SENTENCES) != (rank - 1) * SAMPLE_SENTENCES // np.maximum(many, SAMPLE_SENTENCES)
        keep = pick[s]
        _, s2 = np.unique(s[keep], return_inverse=True)
        target = y[which][owner[pick]]
        weight = 1 / np.bincount(target, minlength=LEVELS)[target] ** 0.5
        (a, ra), (b, rb) = _features(cp[keep], s2)
        return Model(*_fit(a, ra, target, weight), *_fit(b, rb, target, weight), np.zeros((2 * LEVELS, LEVELS)))

    m = train(~held)
    d, n = distributions([bodies[i] for i in np.flatnonzero(held)], m)
    m.turn = _calibrate(d[n > 0], y[held][n > 0])
    return m


def is_japanese(text: str) -> bool:
    cp = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    kind = SCRIPT[cp]
    kana = np.count_nonzero((kind == 3) | (kind == 4))
    return kana > 0 and kana >= KANA_SHARE * np.count_nonzero(kind >= 2)


def train_model(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level") -> Model | None:
    """The model (None without labelled Japanese documents) of a bounded sample of labelled Japanese documents: the ``SAMPLE_DOCS`` with
    the smallest hash of their key, the same at every run."""
    rows = labels.select(key, label).where(F.col(label).between(1, LEVELS)).groupBy(key).agg(F.round(F.avg(label)).cast("int").alias("level"))
    few = rows.orderBy(F.xxhash64(key), key).limit(SAMPLE_DOCS)
    sample = docs.select(key, F.col(text).alias("t")).where("t is not null").join(F.broadcast(few), key).orderBy(F.xxhash64(key), key).toPandas()
    sample = sample[np.array([is_japanese(main_text(t)) for t in sample["t"]], bool)]
    return fit(list(sample["t"]), list(sample["level"])) if len(sample) else None


def reading_levels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "reading_level") -> DataFrame:
    """(key, level, expected_level, p1..p5, sentences) of every Japanese document.

    level: the likeliest calibrated level of the main text; expected_level: its mean. Documents
    in other languages, null and empty ones have no row; repeated rows have one each. Without
    labels there is nothing to fit and no row.
    """
    src = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").cast("string").alias("t")).where("t is not null and t <> ''")
    kind = src.schema["key"].dataType.simpleString()
    schema = f"key {kind}, level int, expected_level double, {', '.join(f'p{k + 1} double' for k in range(LEVELS))}, sentences bigint"
    fitted = train_model(docs, labels, key, text, label)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], schema).withColumnRenamed("key", key)
    model = docs.sparkSession.sparkContext.broadcast(fitted)  # 10 MB, fixed

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in np.array_split(np.arange(len(pdf)), max(1, len(pdf) // 2000)):
                some = pdf.iloc[part]
                bodies = [main_text(t) for t in some["t"]]
                ok = np.array([is_japanese(b) for b in bodies], bool)
                d, n = distributions([b for b, k in zip(bodies, ok) if k], model.value)
                p = _softmax(_inputs(d) @ model.value.turn)
                out = pd.DataFrame(p, columns=[f"p{k + 1}" for k in range(LEVELS)])
                out.insert(0, "expected_level", p @ np.arange(1, LEVELS + 1))
                out.insert(0, "level", p.argmax(1).astype(np.int32) + 1)
                out.insert(0, "key", some["key"].to_numpy()[ok])
                yield out.assign(sentences=n)[n > 0]

    return src.mapInPandas(run, schema).withColumnRenamed("key", key)
