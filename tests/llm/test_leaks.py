import random

import numpy as np

from tsumugi.functions.letters import lcs_length, letters
from tsumugi.llm import leaks

KANA = "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわん水木火土金山川空"


def make(rng, n):
    return "".join(rng.choice(KANA) for _ in range(n))


def brute(docs, items):
    out = set()
    for d, t in docs:
        t = letters(t)
        grams = {t[i : i + 16] for i in range(len(t) - 15)}
        for i, x in items:
            x = letters(x)
            if any(x[k : k + 16] in grams for k in range(len(x) - 15)):
                out.add((d, i))
    return out


def test_finds_all_stretches(spark):
    rng = random.Random(1)
    items = [(f"i{k:02d}", make(rng, rng.randint(10, 90))) for k in range(40)]
    docs = [(k, make(rng, rng.randint(0, 400))) for k in range(200)]
    for k in range(0, 200, 3):
        x = rng.choice(items)[1]
        n = rng.choice([14, 15, 16, 17, 30])
        a = rng.randint(0, max(0, len(x) - n))
        part = "、\n　​".join([x[a : a + 5], x[a + 5 : a + n]])
        docs[k] = (docs[k][0], docs[k][1][:50] + part + docs[k][1][50:])
    docs += [(900, None), (901, ""), (None, items[0][1]), (902, items[1][1] * 400), (902, items[1][1] * 400)]
    items += [("null", None), ("empty", ""), ("short", "あいう"), (None, make(rng, 40))]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert got.columns == ["doc_id", "item_id"]
    rows = [tuple(r) for r in got.collect()]
    known = [(d, t) for d, t in docs if d is not None and t]
    want = brute(known, [(i, t) for i, t in items if i and t])
    assert len(rows) == len(set(rows))
    assert set(rows) == want and len(want) > 20


def test_stretches_beside_other_items(spark):
    rng = random.Random(7)
    items = [(f"i{k:03d}", make(rng, 90)) for k in range(300)]
    docs = []
    for k in range(400):
        (_, x), (_, y) = rng.sample(items, 2)
        a, b, n = rng.randint(0, 74), rng.randint(0, 58), rng.choice([0, 16, 32])
        docs.append((k, y[b : b + n] + x[a : a + 16] + y[b + n : b + 32]))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(docs, items)


def test_width_case_and_several_fields(spark):
    docs = spark.createDataFrame([(1, "prefix ＡＢＣＤ-efgh ijkl, mnop tail", "x"), (2, "abcd efgh ijkl mno", "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([("a", "zz"), ("a", "abcdEFGHijklMNOP")], "item_id string, text string")
    assert [tuple(r) for r in leaks.find_leaks(docs, items).collect()] == [(1, "a")]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([("a", "あいうえおかきくけこさしすせそた")], "item_id string, text string")
    assert leaks.find_leaks(docs, items).count() == 0
    some = spark.createDataFrame([(1, "あいうえおかきくけこさしすせそた")], "doc_id long, text string")
    assert leaks.find_leaks(some, items.limit(0)).count() == 0


def test_paraphrase(spark):
    item = "母が入院した夜に隣の人が味噌汁を届けてくれたことを今も忘れない"
    other = "母が入院した夜は、隣の人が味噌汁も届けてくれたことは今も忘れない"
    docs = spark.createDataFrame([(1, other), (2, "まったく別の文章がここに続いていて関係のない話をしている")], "doc_id long, text string")
    got = leaks.find_leaks(docs, spark.createDataFrame([("p", item)], "item_id string, text string"), paraphrases=True).collect()
    assert [(r.doc_id, r.kind) for r in got] == [(1, "paraphrase")] and 0.6 < got[0].lcs < 1


def test_paraphrase_reports_the_answers_own_words(spark):
    item = "母が入院した夜に隣の人が味噌汁を届けてくれたことを今も忘れない"
    other = "母が入院した夜は、隣の人が味噌汁も届けてくれたことは今も忘れない"
    docs = spark.createDataFrame([(1, other), (2, item)], "doc_id long, text string")
    got = {r.doc_id: r.answer for r in leaks.find_leaks(docs, spark.createDataFrame([("p", item)], "item_id string, text string"), paraphrases=True).collect()}
    assert got[2] == 1 and 0.2 < got[1] < 1


def test_planted_paraphrases(spark):
    rng = random.Random(11)
    names = ["叔母", "店長", "隣の子", "祖父", "先輩", "看護師", "大家さん", "弟", "班長", "部下"]
    acts = ["庭の柿を分けてくれて", "古い時計を直しながら", "雨の駅で泣いていて", "味噌汁を温め直して", "返事を書けないまま", "仕事を休みたいと言って", "写真を一枚だけ残して", "夜中に電話をかけてきて"]
    ends = ["私は何も言えずにいた", "昔のことを少し話した", "窓の外ばかり見ていた", "明日また来ると約束した", "眠れない夜が続いている", "手紙を机にしまい込んだ"]
    sentence = lambda: "、".join([rng.choice(names) + "が" + rng.choice(acts), rng.choice(names) + "も" + rng.choice(acts), rng.choice(ends) + make(rng, 3)])
    items = [(f"i{k:03d}", sentence()) for k in range(120)]
    docs, planted = [(1000 + k, sentence() + "。" + sentence()) for k in range(300)], set()
    for k, (name, x) in enumerate(items[:80]):
        a, b, c = x.split("、")
        out = list("、".join([a, b, c] if k % 4 else [b, a, c]))
        for i in range(rng.randrange(7), len(out), 11):
            out[i] = rng.choice(["", out[i] + "も", rng.choice("はにを人日")])
        docs.append((k, sentence() + "。" + "".join(out) + "。" + sentence()))
        planted.add((k, name))
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), paraphrases=True)
    found = {(r.doc_id, r.item_id) for r in got.collect()}
    assert len(found & planted) >= 0.9 * len(planted)


def test_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(leaks, "BLOCK", 2)
    rng = random.Random(2)
    items = [(f"i{k}", make(rng, 60)) for k in range(9)]
    docs = [(k, make(rng, 20) + items[k][1][10:40]) for k in range(9)]
    got = leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"))
    assert {tuple(r) for r in got.collect()} == {(k, f"i{k}") for k in range(9)}


def test_svd_matches_numpy(spark):
    rng = np.random.default_rng(0)
    passages = [rng.integers(0, 60, 30) for _ in range(80)]
    column = np.full(leaks.BUCKETS, -1, np.int32)
    column[:60] = np.arange(60)
    idf = np.ones(60, np.float32)
    basis = leaks.latent_space(spark, passages, column, idf, rank=60)
    r, c, v = leaks._matrix(passages, column, idf)
    full = np.zeros((80, 60))
    full[r, c] = v
    assert np.allclose(full @ basis @ basis.T, full, atol=1e-3)


def test_in_order_like_one_pair_at_a_time():
    rng = random.Random(5)
    a = [make(rng, rng.randint(0, 32)).translate({ord(k): "あ" for k in KANA[::3]}) for _ in range(300)]
    b = [make(rng, rng.randint(0, 48)).translate({ord(k): "あ" for k in KANA[::3]}) for _ in range(300)]
    pad = lambda ts, n: leaks._padded([np.array([ord(c) for c in t], np.int64) for t in ts], n)
    assert leaks._in_order(pad(a, 32), pad(b, 48)).tolist() == [lcs_length(x, y) for x, y in zip(a, b)]
