"""Template residue and error-page text.

Two kinds of evidence. Detectors find what no real answer holds: unfilled placeholders, filler
text, error pages and notices that scripts are needed. A weaker sign, a sentence that puts a
system noun to a system verb in the tone of a notice, counts only with evidence from its
surroundings: the same low-information sentence (numbers aside) stands under several items,
comes from several variants and shares no content term with the prompts of those items. The
item's prompt takes the part of title and address, and the variant that of the host.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.session import cut

# What a slot of a template stands for.
SLOTS = "名前 お名前 氏名 姓 名 宛名 宛先 地名 住所 場所 日付 日時 時刻 年月日 場面 状況 感情 気持ち 続柄 関係 肩書き 役職 敬称 相手の名前 相手 会社名 社名 部署名 電話番号 件名 題名 タイトル 本文 内容 商品名 金額 担当者名 行事名 祭りの名前 回答 返答 質問 理由".split()
# Phrases of filler text.
FILLERS = [
    r"lorem\s+ipsum|dolor\s+sit\s+amet",
    r"\b(?:your|sample|placeholder|dummy|insert)\s+(?:text|content|answer|response)\b(?:\s+(?:goes\s+)?here)?",
    r"(?:ダミー|サンプル|テスト|仮)の?(?:テキスト|文章|本文|投稿|データ|原稿)",
    r"(?:この|以下の)?(?:文章|テキスト|本文|内容)は(?:仮|ダミー|サンプル)",
    r"(?:文章|テキスト|本文|説明|回答|内容)が(?:ここに)?入ります",
    r"ここに.{0,10}(?:入ります|(?:入力|記入|記載|挿入)(?:し|す|$|[)\]】>}]))",
    r"(?:テキスト){3,}|(?:文章){3,}",
    r"(?:ほげ|ふが|ぴよ){2,}|hoge\s*hoge|foo\s*bar\s*baz",
    r"あいうえおかきくけこ|アイウエオカキクケコ|いろはにほへとちりぬるを",
    r"(?:^|[\s(\[【※])(?:todo|fixme|tbd)(?:\s*[::]|\s*$|[)\]】])",
    r"(?:後|あと)で差し替え|差し替え(?:予定|待ち|てください)|※.{0,12}差し替え",
    r"asdf\w*|qwerty\w*",
]
# Phrases of error pages.
ERRORS = [
    r"\b[45]\d\d\s*[-:]?\s*(?:not\s+found|forbidden|unauthorized|bad\s+(?:gateway|request)|service\s+(?:temporarily\s+)?unavailable|internal\s+server\s+error|gateway\s+time-?out|too\s+many\s+requests)",
    r"(?:internal\s+server\s+error|bad\s+gateway|gateway\s+time-?out|service\s+(?:temporarily\s+)?unavailable|page\s+not\s+found|too\s+many\s+requests|access\s+denied|permission\s+denied|traceback\s+\(most\s+recent|upstream\s+timed\s+out|connection\s+(?:refused|reset|timed\s+out)|(?:key|value|type|runtime|attribute|index)error\b)",
    r"\bhttp\s*(?:error\s*)?\d{3,}\b|\berror\s*(?:code)?\s*[:#]\s*\S",
    r"ページ(?:は|が)(?:見つかりません|見つかりませんでした|存在しません|表示できません|移動|削除|ありません)",
    r"\d{3,}\s*-\s*ページ",
    r"(?:アクセス|接続|リクエスト|要求)(?:が|は|を)(?:拒否|制限|中断|処理できません|タイムアウト|失敗|切断)",
    r"(?:要求|リクエスト|処理)を(?:処理|実行|完了)できません",
    r"(?:エラー|障害|例外)が発生し(?:ました|ています)|エラー(?:番号|コード)\s*[::]?\s*\w",
    r"サーバー?(?:が|は|に|で)(?:混み|混雑|応答|接続|ダウン|停止|エラー|見つかり)",
    r"(?:ただいま|現在|只今).{0,12}メンテナンス|メンテナンス(?:中です|のため)",
    r"セッション(?:が|の).{0,8}(?:切れ|期限|無効|タイムアウト)|再度ログイン|ログイン(?:し直して|が必要|してください)",
    r"タイムアウトしました|再度アクセスして|時間をおいて.{0,8}(?:アクセス|お試し)",
    r"管理者に(?:お問い合わせ|ご連絡|連絡)",
    r"url(?:を|が).{0,6}(?:ご?確認|間違|正し)",
]
# Phrases of notices that scripts or cookies are needed.
SCRIPTS = [
    r"turn\s+(?:java\s*scripts?|cookies?)\s+(?:back\s+)?on|(?:java\s*scripts?|cookies?)\s+(?:(?:is|are)\s+)?(?:not\s+(?:enabled|supported|available)|turned\s+off|blocked)",
    r"(?:enable|turn\s+on|activate|allow|requires?|needs?)\s+(?:java\s*scripts?|scripts?|cookies?)|java\s*scripts?\s+(?:is\s+)?(?:disabled|required|enabled|must)",
    r"(?:java\s*script|ジャバスクリプト|スクリプト|cookie|クッキー)(?:s|など|等)?(?:を|が|は|の設定を?)(?:有効|無効|オン|オフ|許可|使用でき|必要|設定)",
    r"(?:java\s*script|ジャバスクリプト|スクリプト)の設定が必要",
    r"(?:cookie|クッキー)と(?:java\s*script|ジャバスクリプト)",
]
WRAPPERS = [r"<\s*/?\s*(?:html|body|head|h1|title)\s*>", r"<!doctype\b"]
#: A notice: a system noun, then a verb of systems in polite form. Weak alone.
NOTICE = re.compile(r"(?:ページ|サイト|サーバー?|ブラウザ|アカウント|パスワード|セッション|画面|通信|ネットワーク|データベース|ファイル|フォーム|システム|リンク|アプリ)(?:が|は|を|の|に|で).{0,24}(?:できません|ませんでした|されました|されています|失敗しました|してください|必要です|中です|できない状態です)")
#: How a sentence goes on that reports a message or speaks of one: no message itself.
SPOKEN = re.compile(r"[^。!?\n]{0,12}?(?:[」』]?[、,]?\s*(?:と|って)(?:言|いう|いわ|いっ|聞|書|思|怒|困|出[てたる]|なっ|表示され[てた]|の表示)|[なの](?:舞台|話|場面|とき|時|人)[^。!?\n]{0,12}|(?:だ|だよ|よ|の|か)?(?:ね|かな|なあ|かも)(?=[。!?\n、]|$))")
#: Of the detectors, those of messages.
MESSAGES = (2, 3)
WORDS = re.compile(r"[一-鿿]{2,}|[゠-ヿ]{2,}|[a-z]{3,}")
HIDDEN = re.compile("[\u00ad\u061c\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\ufe00-\ufe0f\ufeff\U000e0000-\U000e01ef]+")
SENTENCES = re.compile(r"(?<=[。!?\n])")


@functools.cache
def strong() -> list[tuple[tuple[str, ...], re.Pattern]]:
    """All detectors of what no real answer holds, each with strings one of which any match
    must hold: a plain search for these spares most texts the patterns."""
    slot = "(?:" + "|".join(sorted(map(re.escape, SLOTS), key=len, reverse=True)) + ")"
    fill = "(?:を|に|の)?(?:ここに)?(?:入力|記入|記載|挿入|指定)(?:してください|のこと)?"
    name = r"[a-z_][\w.]*"
    placeholders = [
        r"\{\{[^{}]{0,80}\}\}",
        r"\$\{[^{}]{1,80}\}",
        r"<%.{0,80}?%>",
        r"\[\[[^\[\]]{1,40}\]\]",
        rf"@@{name}@@|__{name}__|(?<![a-z0-9%])%{name}%",
        r"(?<![a-z0-9%])%[sd](?![a-z0-9])",
        rf"\{{(?:\d{{0,2}}|{name}|{slot})\}}",
        rf"[<\[【(《〈](?:ここに)?{slot}(?:{fill})?[>\]】》〉]",
        rf"[<\[【(《〈{{][^<>\[\]【】()《》〈〉{{}}]{{0,20}}{fill}[>\]】)》〉}}]",
        rf"\((?:ここに)?{slot}\)(?=さん|さま|様|氏|殿|くん|ちゃん)",
        r"<ここに[^<>]{1,20}>|<<\s*[^<>\s][^<>]{0,30}>>",
        r"\[[a-z]+(?:_[a-z0-9]+)+\]",
        r"(?<![a-z0-9_])(?:_{3,}|x{3,}|\*{3,}|△{2,}|□{2,}|●{2,})(?=さん|様|氏|殿|くん|ちゃん)",
        r"<\s*(?:your|insert|enter)\s[^<>]{1,40}>|\[\s*(?:your|insert|enter)\s[^\[\]]{1,40}\]",
        r"[○〇◯]{2,}(?=さん|様|氏|市|町|村|県|の|に|を|$)",
    ]
    one = lambda xs: re.compile("|".join(f"(?:{x})" for x in xs), re.M | re.S)
    return [
        (("{", "<", "[", "【", "《", "〈", "(", "%", "___", "xxx", "***", "△△", "□□", "●●", "@@", "__", "○○", "〇〇", "◯◯", "入力", "記入", "記載", "挿入", "指定"), one(placeholders)),
        (("ipsum", "dolor", "text", "content", "answer", "response", "ダミー", "サンプル", "テスト", "仮", "入ります", "ここに", "テキストテ", "文章文", "ほげ", "ふが", "ぴよ", "hoge", "foo", "あいうえお", "アイウエオ", "いろはに", "todo", "fixme", "tbd", "差し替え", "asdf", "qwerty"), one(FILLERS)),
        (("ページ", "アクセス", "接続", "リクエスト", "要求", "処理", "エラー", "障害", "例外", "サーバ", "メンテナンス", "セッション", "ログイン", "タイムアウト", "時間をおいて", "管理者", "url", "error", "found", "gateway", "unavailable", "denied", "traceback", "timed out", "connection", "http", "too many", "forbidden", "unauthorized", "bad request"), one(ERRORS)),
        (("script", "スクリプト", "cookie", "クッキー"), one(SCRIPTS)),
        (("<",), one(WRAPPERS)),
    ]


def plain(text: str) -> str:
    """Compatibility form without invisible characters, in lower case."""
    text = unicodedata.normalize("NFKC", text)
    if not text.isascii():
        text = HIDDEN.sub("", text)
    return text.lower()


def _spoken(text: str, end: int) -> bool:
    """Whether what ends at ``end`` is spoken of: reported, or said in a casual tone."""
    return SPOKEN.match(text, end) is not None


def has_residue(text: str | None) -> bool:
    """Whether a detector fires; null and empty texts hold no residue."""
    if not text:
        return False
    text = plain(text)
    for k, (signs, pattern) in enumerate(strong()):
        if any(x in text for x in signs):
            told = k in MESSAGES
            if any(not told or not _spoken(text, m.end()) for m in pattern.finditer(text)):
                return True
    return False


def notices(text: str | None) -> list[str]:
    """The sentences of ``text`` that read like a notice, numbers masked."""
    if not text:
        return []
    return [re.sub(r"\d+", "0", s.strip()) for s in SENTENCES.split(plain(text)) if NOTICE.search(s)]


@F.pandas_udf(T.StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(plain)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _words(notice: pd.Series) -> pd.Series:
    return notice.map(WORDS.findall)


@F.pandas_udf(T.BooleanType())
def residue_flag(text: pd.Series) -> pd.Series:
    return text.map(has_residue)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        hit = pdf["text"].map(has_residue)
        weak = [[] if h else notices(t) for h, t in zip(hit, pdf["text"])]
        keep = hit | pd.Series([bool(w) for w in weak], index=pdf.index)
        out = pdf[["src", "record_key", "item", "variant"]].assign(strong=hit, weak=weak)
        yield out[keep]


def find_residue(records: DataFrame, prompts: DataFrame, least_items: int = 3, least_variants: int = 2) -> DataFrame:
    """(src, record_key): the records that hold residue anywhere.

    ``records``: src, record_key, item, variant, text; ``prompts``: item, prompt. Null or empty
    texts hold none. Repeated rows give one row. A record without an item or variant is judged
    by the detectors alone. ``least_items`` and ``least_variants``: under how many items and
    from how many variants a notice must stand, unrelated to the items' prompts, to count as
    residue. One whose words stand in its items' prompts more often than in all prompts, beyond
    chance, answers them and is no residue.
    """
    src = records.select(*(F.col(c).cast("string") for c in ("src", "record_key", "item", "variant", "text"))).where("record_key is not null and text is not null")
    found = cut(src.mapInPandas(_scan, "src string, record_key string, item string, variant string, strong boolean, weak array<string>"))  # few rows, used three times
    sure = found.where("strong").select("src", "record_key")
    weak = found.where("not strong and item is not null").select("src", "record_key", "item", "variant", F.explode("weak").alias("notice"))
    # one row a notice and item before the join with prompts, however many records repeat it
    uses = weak.groupBy("notice", "item").agg(F.collect_set("variant").alias("variants"))
    known = prompts.where("item is not null and prompt is not null").select(F.col("item").cast("string").alias("item"), _plain(F.col("prompt").cast("string")).alias("prompt")).distinct()
    held = F.coalesce(F.exists("words", lambda w: F.col("prompt").contains(w)), F.lit(False))
    judged = uses.withColumn("words", _words("notice")).join(known, "item", "left").groupBy("notice", "words", "item").agg(F.max(held).alias("related"), F.first("variants").alias("variants"))
    spread = judged.groupBy("notice", "words").agg(F.count("*").alias("n"), F.count_if("related").alias("near"), F.size(F.array_distinct(F.flatten(F.collect_set(F.when(~F.col("related"), F.col("variants")))))).alias("hosts"))
    likely = cut(spread.where((F.col("n") - F.col("near") >= least_items) & (F.col("hosts") >= least_variants)))
    # a notice with a common word meets it in some prompts by chance: in how many, all prompts tell
    by_item = likely.where("near > 0").crossJoin(known).groupBy("notice", "item").agg(F.max(held).alias("held"))
    base = by_item.groupBy("notice").agg(F.avg(F.col("held").cast("double")).alias("base"))
    shared = likely.join(base, "notice", "left").where("near = 0 or near <= base * n + 2 * sqrt(base * (1 - base) * n)").select("notice")
    more = weak.join(shared, "notice", "left_semi").select("src", "record_key")
    return sure.unionByName(more).distinct()
