import random

from tsumugi.llm import difficulty as df_

PARTS = {
    1: ["くまは もりへ いきました。", "「だいじょうぶだよ」と いいました。", "おはなが さいて います。", "うさぎと みずを のみました。", "そらは とても あおいです。"],
    2: ["教室で友だちと遊びました。", "母といっしょにご飯を食べました。", "先生に手紙を見せました。", "明日は祭りの日です。", "公園で弟を待ちました。"],
    3: ["父の返事は短かったけれど、気持ちはこもっていた。", "久しぶりに町へ戻ると、店はもうなくなっていた。", "何と声をかければよいのか、まだ考えている。", "写真を見返しながら昔のことを話した。"],
    4: ["担当部局は実施体制の整備を段階的に進める方針を示した。", "相談支援に係る経費は事務局の予算から支出する。", "情報共有の徹底が不十分な場合、質的低下を招くおそれがある。", "関係機関相互の連絡経路を一元化した。"],
    5: ["前項の撤回権は、相手方の善意を問わず対抗することができないものと解される。", "賃借人に課される義務の範囲は但書の趣旨に照らし限定的に画定されるべきである。", "当該期間の経過を要件とする法律効果については明文の規定を欠く。"],
}


def text(rng, level, n=6):
    return "".join(rng.choice(PARTS[level]) for _ in range(n))


def labelled(rng, n):
    return [(k, text(rng, k % 5 + 1), k % 5 + 1) for k in range(n)]


def test_held_out_accuracy_and_quotes():
    rng = random.Random(1)
    rows = labelled(rng, 200)
    m = df_.fit([t for _, t, _ in rows], [y for _, _, y in rows])
    new = labelled(rng, 100)
    quoted = [(0, "「" + text(rng, 5, 3) + "」と言った。" + text(rng, 2, 8), 2), (1, text(rng, 5, 4) + "「" + text(rng, 1, 9) + "」", 5)]
    for rows in (new, quoted):
        d, n = df_.distributions([df_.main_text(t) for _, t, _ in rows], m)
        level = (df_._inputs(d) @ m.turn).argmax(1) + 1
        assert (level == [y for _, _, y in rows]).mean() >= 0.95


def test_main_text_after_quotes():
    assert df_.main_text("A\n> quote\nB\nC") == "A\n\nB\nC"
    assert df_.main_text("＞引用\n｜引用\n本文です。\n続き") == "\n\n本文です。\n続き"
    assert df_.main_text("前\n【引用】一行\n二行【/引用】\n後") == "前\n\n後"
    assert df_.main_text("前\n【引用】閉じない\n後の本文") == "前\n\n後の本文"
    assert df_.main_text("前【引用】外【引用】内【/引用】\n外【/引用】後の本文") == "前後の本文"
    assert df_.main_text("「外『内』「中」」と言った。") == "と言った。"


def test_table(spark):
    rng = random.Random(2)
    rows = labelled(rng, 60)
    extra = [(100, None), (101, ""), (102, "This is an English text about rules."), (103, text(rng, 4, 4000)), (None, text(rng, 4)), (104, "。。。"), (105, "这里没有日语的假名只有汉字")]
    docs = spark.createDataFrame([(k, t) for k, t, _ in rows] + extra + [(0, rows[0][1])], "doc_id long, text string").selectExpr("*", "7 as level")
    labels = spark.createDataFrame([(k, y) for k, _, y in rows[:50]] + [(0, 1), (None, 3), (7, None), (8, 99)], "doc_id long, reading_level int")
    got = df_.reading_levels(docs, labels).toPandas()
    assert not set(got.doc_id.dropna()) & {100, 101, 102, 104, 105} and len(got[got.doc_id == 0]) == 2
    assert got[got.doc_id == 103].level.iloc[0] == 4 and got.doc_id.isna().sum() == 1
    by = {k: y for k, _, y in rows}
    assert (got.dropna(subset=["doc_id"]).query("doc_id < 60").apply(lambda r: r.level == by[r.doc_id], axis=1)).mean() > 0.9
    assert (got[["p1", "p2", "p3", "p4", "p5"]].sum(axis=1) - 1).abs().max() < 1e-6
    assert df_.reading_levels(docs.limit(0), labels).count() == 0
    assert df_.reading_levels(docs, labels.limit(0)).count() == 0
