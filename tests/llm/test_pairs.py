import pytest

from tsumugi.llm import pairs

PROMPT = "昨日、母の手袋をまた駅で落としてしまいました。探す気にもなれません。"
GOOD = ["それはつらかったですね。", "ゆっくりで大丈夫です。", "手袋のこと、聞かせてください。", "一緒に駅まで行きましょうか。", "お茶を用意しておきますね。"]


def run(spark, rows, prompts=None):
    r = spark.createDataFrame(rows, "row_id long, id string, response string")
    p = spark.createDataFrame(prompts or [("a", PROMPT)], "id string, prompt string")
    got = pairs.broken_pairs(r, p)
    assert got.columns == ["row_id", "defect"]
    return {x.row_id: x.defect for x in got.collect()}


def test_defects(spark):
    rows = [(i, "a", g) for i, g in enumerate(GOOD * 4)]
    cases = {
        100: (None, "empty"), 101: ("", "empty"), 102: (" ​\n", "empty"), 103: ("「」", "empty"), 104: ("…", None), 105: ("……。", None),
        110: ("ご質問：" + PROMPT, "copied"), 111: (PROMPT.replace("。", ""), "copied"), 112: ("「昨日、母の…」ですか。つらいですね。", None),
        120: ("申し訳ありませんが、その件にはお答えできません。", "refusal"), 121: ("回答は控えさせていただきます。ご了承ください。", "refusal"), 122: ("うまくお答えできませんが、一緒に考えます。", None), 123: ("申し訳ありませんが、お答えできません。でも手袋は一緒に探しましょう。", None),
        130: ("I am so sorry to hear about your gloves.", "wrong_language"), 131: ("这不是你的错，慢慢来吧。", "wrong_language"), 132: ("はい、You did nothing wrong at all.", "wrong_language"), 133: ("OKです。Wi-Fiも直りますよ。", None), 134: ("괜찮아요, 천천히 하세요.", "wrong_language"),
        140: ("お茶を用意しておきますね", None), 141: ("一緒に駅ま", "truncated"), 142: ("手袋のこと、", "truncated"), 143: ("お茶を用意して「", "truncated"),
        150: ("お茶を用意しておきますね。" * 8, None), 151: ("404 Not Found", None),
    }
    rows += [(k, "a", t) for k, (t, _) in cases.items()]
    got = run(spark, [*rows, (100, "a", None), (120, "a", cases[120][0]), (200, "unknown", None), (201, None, ""), (None, "a", "")])
    assert not {k: (t, d, got.get(k)) for k, (t, d) in cases.items() if got.get(k) != d}
    assert set(got) <= set(cases)


def test_hot_id_and_clashing_columns(spark):
    r = spark.range(3000).selectExpr("id as row_id", "'a' as id", "case when id % 3 = 0 then '' else 'それはつらかったですね。' end as response", "1 as prompt", "2 as defect")
    p = spark.createDataFrame([("a", PROMPT), ("a", PROMPT)], "id string, prompt string")
    got = pairs.broken_pairs(r, p)
    assert got.count() == 1000 and {x.defect for x in got.select("defect").distinct().collect()} == {"empty"}


def test_null_prompt_long_text_and_empty(spark):
    assert run(spark, [(1, "a", "あ" * 200_000 + "。")], [("a", None)]) == {}
    assert run(spark, [(1, "a", "")], [("a", None)]) == {1: "empty"}
    empty = spark.createDataFrame([], "row_id long, id string, response string")
    assert pairs.broken_pairs(empty, spark.createDataFrame([], "id string, prompt string")).count() == 0


def test_endings_counts_by_brute_force():
    texts = ["あいう。えお", "いう", None, "う♪"]
    got = {(r.suffix): (r.n, r.closing) for r in pairs.endings(texts).itertuples()}
    assert got["いう"] == (2, 2) and got["\nいう"] == (1, 1) and got["う"] == (3, 3) and got["え"] == (1, 0) and got["あいう"] == (1, 1)


def test_copied_pairs(spark):
    r = spark.createDataFrame([(1, "a", PROMPT), (2, "a", "はい。"), (3, "a", None)], "row_id long, id string, response string")
    assert [x.row_id for x in pairs.copied_pairs(r, spark.createDataFrame([("a", PROMPT)], "id string, prompt string")).collect()] == [1]


@pytest.mark.parametrize("text", ["その件には触れられません", "それは話したくありません", "ノーコメントでお願いします", "その質問はちょっと無理です", "お返しできる言葉がありません", "私の口からは言えません", "この内容は規約違反のため出力をブロックしました", "恐れ入ります。そのご質問にはお答えいたしかねます。"])
def test_refusals_in_other_words(text):
    assert pairs.is_refusal(text)


@pytest.mark.parametrize("text", ["無理しなくていいですよ。", "うまく言えませんが、そばにいます。", "そのお気持ち、すぐには消せませんよね。", "それは無理もないことです。", "話せませんか？", "何も言えませんね。", "言葉にできないほどですね。"])
def test_answers_that_are_no_refusal(text):
    assert not pairs.is_refusal(text)


def test_language_of_kanji():
    assert not any(map(pairs.is_foreign, ["明日会議", "会場変更", "対応完了", "大丈夫", "OK", "了解", "一期一会"]))
    assert all(map(pairs.is_foreign, ["今日天气很好。", "我很喜欢吃苹果", "請你保重身體", "没关系，慢慢来", "I am so sorry to hear that."]))
