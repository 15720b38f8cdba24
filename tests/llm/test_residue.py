import pytest

from tsumugi.llm import residue

YES = ["{{name}}さん、お元気ですか。", "次回は%sに伺います。", "次回は%USER_NAME%に", "［名前を入力］", "【続柄】さまへ", "（日付を記入）", "<your text here>", "__SITUATION__", "${answer}", "<%= x %>", "[[宛名]]", "@@a.b@@", "Lorem ipsum dolor", "ダミーテキストです。", "ここに本文が入ります。", "TODO: 回答を書く", "404 Not Found", "Internal Server Error (code 12)", "お探しのページは見つかりませんでした。", "エラーが発生しました（エラー番号：3）。", "JavaScriptを有効にしてください。", "Please enable JavaScript to continue.", "お使いのブラウザではスクリプトが無効になっています。", "Java​Scriptを有効に", "<html><body>x</body></html>", "Traceback (most recent call last): KeyError 4", "[FIRST_NAME]さん、こんにちは", "<<NAME>>さん", "（相手の名前）さんへ", "＿＿＿さん", "XXX様", "Please turn JavaScript on.", "Cookies are blocked", "□□様のご意見"]
NO = [None, "", "ページが見つからないの？しおりは本の下だよ。", "エラーの出た時計は兄が直すね。", "404号室の林さんにも届けようか。", "宿題のスクリプト、机に置いたよ。", "名前を書く欄は一緒に埋めようね。", "林の【大事】な帽子、見つけたよ。", "返事はいつでも大丈夫（笑）", "ページは破らずに残しておきましょう。", "入力エラーの件は確認しております。", "100%大丈夫です", "I < 3 you", "エラーが発生しました、と言われて困ったね。", "スクリプトが必要な舞台だね", "「ページが見つかりません」って出たら焦るよね。", "サーバーが混んでいるのかな", "[大事]な話", "(笑)さん"]


@pytest.mark.parametrize("text", YES)
def test_residue(text):
    assert residue.has_residue(text)


@pytest.mark.parametrize("text", NO)
def test_no_residue(text):
    assert not residue.has_residue(text)


def test_notices_need_evidence(spark):
    notice = "このシステムは現在ご利用できません。"
    rows = [("response", str(i), f"item{i % 5}", f"v{i % 3}", notice) for i in range(20)]
    rows += [("response", "99", "one", "v0", "このリンクは今は開けません。使用できません。"), ("response", "98", "one", "v0", "{0}"), ("response", "98", "one", "v0", "{0}"), ("compassion", "97", None, None, "{0}"), ("response", None, "x", "v", "{0}"), ("response", "96", "x", "v", None), ("response", "95", "x", "v", "長" * 200_000)]
    df = spark.createDataFrame(rows, "src string, record_key string, item string, variant string, text string")
    prompts = spark.createDataFrame([(f"item{i}", "庭の話") for i in range(5)] + [(None, None)], "item string, prompt string")
    got = {tuple(r) for r in residue.find_residue(df, prompts).collect()}
    assert got == {("response", str(i)) for i in range(20)} | {("response", "98"), ("compassion", "97")}
    near = spark.createDataFrame([(f"item{i}", "システムの話") for i in range(5)], "item string, prompt string")
    assert {r.record_key for r in residue.find_residue(df, near).collect()} == {"98", "97"}
    assert residue.find_residue(df.limit(0), prompts).count() == 0


def test_common_words_do_not_clear_a_notice(spark):
    notice, answer = "この画面は現在ご利用できません。", "通信はお店の人に相談してください。"
    prompts = [(f"i{k}", "画面の話" if k % 8 == 0 else "通信の話" if k < 12 else "庭の話") for k in range(80)]
    rows = [("response", f"n{k}", f"i{k}", f"v{k % 3}", notice) for k in range(60)]
    rows += [("response", f"a{k}", f"i{k}", f"v{k % 3}", answer) for k in range(15)]
    df = spark.createDataFrame(rows, "src string, record_key string, item string, variant string, text string")
    got = {r.record_key for r in residue.find_residue(df, spark.createDataFrame(prompts, "item string, prompt string")).collect()}
    assert got == {f"n{k}" for k in range(60)}
