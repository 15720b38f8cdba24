"""Broken prompt and response pairs.

Copies: prompt and response are aligned by the containment of letter shingles and, where that
is high, by their longest common subsequence. Refusals: every sentence is aligned with refusal
templates (longest common subsequence) and refusal forms; a refusal declines and gives nothing
else. Truncation: a response that ends without a closing mark is cut off where its last letters
do not end sentences elsewhere, by counts over all responses. One defect a row.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.letters import code_points, keep_table, lcs_length, letters
from tsumugi.llm.repetition import MIN_CHARS, MIN_SHARE, shares
from tsumugi.llm.residue import HIDDEN, has_residue
from tsumugi.operators.joins import spread_join
from tsumugi.session import cut

SHINGLE = 5
#: A copy holds this share of the prompt's letters in order, and this share of its own letters is the prompt's.
COPY_OF_PROMPT, COPY_OF_RESPONSE = 0.85, 0.72
ALIGNED = 0.8
#: A suffix that closes a sentence or text less often than this is a cut.
CLOSES = 0.1
# Refusal templates.
REFUSALS = tuple("申し訳ありませんが、そのご質問にはお答えできません。 回答を控えさせていただきます。 この件についてのコメントは差し控えます。 その内容はお手伝いできません。 この話題には応じられません。 ご相談はお受けしておりません。 お返事は辞退いたします。 ご要望に沿った回答を作ることはできかねます。 何も申し上げられません。 答える立場にありません。 対応範囲外です。 お話の内容は取り扱いの範囲を超えています。 安全上の方針により返答を省略します。 個別の事情への言及は遠慮させていただきます。 これ以上の返答は行えないことになっています。 力になれない内容ですので、ここで終わります。 そのような相談は受け付けない設定です。 お役に立てません。 お力になれません。 回答いたしかねます。 その質問には回答できません。 お答えいたしかねます。".split())
# Sentences that go with a refusal and give nothing.
COURTESIES = tuple("すみません。 ごめんなさい。 申し訳ありません。 申し訳ございません。 恐れ入ります。 恐縮です。 ご了承ください。 ご理解ください。 ご容赦ください。 悪しからずご了承ください。 規約をご確認ください。 専門機関をご利用ください。 専門家にご相談ください。 別の話題をお願いします。 別のご質問をお願いします。 私はAIです。 AIアシスタントです。 よろしくお願いします。 ご理解のほどお願いいたします。".split())
# What is declined, and how.
DECLINED = re.compile(r"答え|回答|返答|返事|コメント|言及|助言|アドバイス|手伝い|対応|応じ|相談|要望|依頼|提供|質問|内容|話題|申し上げ|力になれ|役に立て|取り扱")
DECLINING = re.compile(r"(?:答え|応じ|応え|提供|対応|回答|返答|手伝い|説明|助言)(?:することは|ることは|は)?(?:でき(?:ません|ない|かねます)|られません|られない|いたしかねます|しかねます|致しかねます)|できかねます|(?:いた|致)?しかねます|(?:差し)?控え(?:ます|させて|て(?:いただ|おり))|辞退|遠慮(?:させて|いたし|します|して(?:いただ|おり))|受け(?:付け)?(?:ておりません|しておりません|していません|ない|られません)|お受けできません|立場に(?:は)?(?:ありません|ない)|範囲(?:外|を超え)|対象外|行えない|省略(?:します|させて|いたします)|力になれ(?:ません|ない)|役に立て(?:ません|ない)|申し上げられません|ここで終わります|お断り")
# Words that open an answer in another language without making it Japanese.
# Acts of speaking, and endings that say one cannot or will not.
SPEAKING = re.compile(r"言[えうわい]|話[しせさす題]|語[れりる]|触れ|述べ|伝え|教え|説明|お返し|返せ|口から|ノーコメント|出力|生成|質問|内容|その件|この件|要望|依頼")
UNABLE = re.compile(r"(?:[えけせてねべめげれ]ません|(?:し|話し|言い|答え)たくありません|(?:し|話し|言い|答え)たくない(?:です)?|無理です|ノーコメント(?:です|でお願いします|とさせてください)|(?:ブロック|遮断|制限|拒否)(?:しました|されました|されています|いたしました)|許可されて(?:い|お)りません|許可されていません|言葉が(?:ありません|ございません)|違反(?:します|となります|に当たります))$")
#: A sentence longer than this says more than that it declines.
SHORT_REFUSAL = 36
TERMINAL, OPENING = "。.!?！？", re.compile(r"^[^。.!?、,\n]{0,12}[。.!?、,:\s]+")
DECORATION = re.compile(r"(?:\((?:笑|泣|汗|涙)\)|[^\w「『(（\[【、,]|_)+$")
JAPANESE, LETTER = re.compile(r"[ぁ-ゖァ-ヺ]"), re.compile(r"[^\W\d_]")
SENTENCES, CLAUSE = re.compile(r"(?<=[。!?\n])"), re.compile(r"(?:が|けれど|けれども|けど)[、,]")
OPENS = {"「": "」", "『": "』", "(": ")", "【": "】", "[": "]"}


def tidy(text: str) -> str:
    return HIDDEN.sub("", unicodedata.normalize("NFKC", text)).strip()


@functools.cache
def _templates(which: tuple[str, ...]) -> tuple[list[str], frozenset[str]]:
    """Letters of the templates, and all their pairs of letters."""
    ts = [letters(t) for t in which]
    return ts, frozenset(t[i : i + 2] for t in ts for i in range(len(t) - 1))


def _aligned(s: str, which: tuple[str, ...], least: float = ALIGNED) -> bool:
    """Whether the sentence and a template share ``least`` of their letters in order; only a
    sentence that is half made of the templates' letter pairs is aligned."""
    ts, pairs = _templates(which)
    if 2 * sum(s[i : i + 2] in pairs for i in range(len(s) - 1)) < len(s) - 1:
        return False
    return any(2 * lcs_length(s, t) >= least * (len(s) + len(t)) for t in ts if abs(len(s) - len(t)) <= (1 - least) * (len(s) + len(t)))


def is_refusal(text: str) -> bool:
    """Whether every sentence of ``text`` declines or goes with declining, and one declines."""
    declines = False
    for part in SENTENCES.split(text):
        s = letters(part)
        if not s:
            continue
        last = CLAUSE.split(part)[-1]  # a sentence that declines and goes on gives something
        short = len(s) <= SHORT_REFUSAL and "?" not in part
        if _aligned(s, REFUSALS) or (DECLINING.search(last) and DECLINED.search(part)) or (short and UNABLE.search(letters(last)) and SPEAKING.search(last)):
            declines = True
        elif not _aligned(s, COURTESIES):
            return False
    return declines


def is_copy(response: str, prompt: str | None) -> bool:
    """Whether ``response`` is the prompt and little else."""
    a, b = letters(response), letters(prompt)
    if len(b) < 2 or len(a) < COPY_OF_PROMPT * len(b) or len(b) < 0.5 * len(a):
        return False
    n = min(SHINGLE, len(b))
    grams = Counter(b[i : i + n] for i in range(len(b) - n + 1))
    shared = sum((grams & Counter(a[i : i + n] for i in range(len(a) - n + 1))).values())
    if shared < 0.4 * (len(b) - n + 1):  # a letter changed costs up to n shingles
        return False
    k = lcs_length(a, b)
    return k >= COPY_OF_PROMPT * len(b) and k >= COPY_OF_RESPONSE * len(a)


# Chinese function words that Japanese does not write.
CHINESE = re.compile("[你您妳她它们們这這吗嗎呢吧啊很么麼没说說让讓给请請谢]")


@functools.cache
def _japanese_kanji(ch: str) -> bool:
    """Whether the common character set of Japanese holds it: simplified forms are not in it."""
    try:
        ch.encode("shift_jis")
    except UnicodeEncodeError:
        return False
    return True


def is_foreign(text: str) -> bool:
    """Whether no Japanese stands in ``text`` beyond an opening word.

    Japanese shows by kana, or by kanji alone, all of the Japanese character set and without
    function words of Chinese. A few letters in Latin (a loanword such as OK) make no foreign text.
    """
    for body in (text, OPENING.sub("", text, count=1)):
        found = LETTER.findall(body)
        if not found:
            continue
        if JAPANESE.search(body):
            if len(JAPANESE.findall(body)) > 0.04 * len(found):
                continue
        han = [x for x in found if "一" <= x <= "鿿"]
        if len(han) >= 0.5 * len(found):
            if len(han) >= 4 and (CHINESE.search(body) or not all(map(_japanese_kanji, han))):
                return True
        elif len(found) >= 8 and (len(body.split()) >= 2 or not body.isascii()):
            return True
    return False


def cut_suffix(text: str) -> str | None:
    """None: the text is closed; '': it ends in a comma or an opening bracket, or a bracket
    stays open; else its last three letters, for the counts to decide."""
    if not text or text[-1] in "」』)】]":
        return None
    if text[-1] in "、,「『(【[":
        return ""
    for a, b in OPENS.items():
        if text.count(a) > text.count(b) and text.rfind(a) > text.rfind(b):
            return ""
    if text[-1] in TERMINAL and not text.endswith("..."):
        return None
    body = DECORATION.sub("", text)
    return _padded(body, len(body))[-3:] if body else None


def _padded(text: str, end: int) -> str:
    """The three characters before ``end``; line breaks stand for what is no letter."""
    keep = keep_table()
    out = ""
    for x in reversed(text[max(0, end - 3) : end]):
        if not keep[ord(x)]:
            break
        out = x + out
    return out.rjust(3, "\n")


def endings(texts: list[str | None]) -> pd.DataFrame:
    """(suffix, n, closing): how often up to three letters stand, and how often they close a
    sentence or text; in numpy over all texts at once."""
    bodies = [DECORATION.sub("", tidy(t)) for t in texts if t]
    cp = code_points("".join(f"{b}\n\n\n" for b in bodies)).astype(np.int64)
    if not len(cp):
        return pd.DataFrame({"suffix": pd.Series([], dtype=object), "n": np.empty(0, np.int64), "closing": np.empty(0, np.int64)})
    letter = keep_table()[cp]
    after = np.append(cp[1:], 10)
    last = np.zeros(len(cp), bool)
    ends = np.cumsum([len(b) + 3 for b in bodies]) - 4
    last[ends[[bool(b) for b in bodies]]] = True
    closes = last | np.isin(after, [ord(x) for x in "。!?"])
    c = np.where(letter, cp, 10)
    b = np.concatenate(([10], c[:-1]))
    a = np.where(b == 10, 10, np.concatenate(([10, 10], c[:-2])))
    at = np.flatnonzero(letter)
    keys = np.concatenate([((a << 42) | (b << 21) | c)[at], ((b << 21) | c)[at], c[at]])
    kinds, back = np.unique(keys, return_inverse=True)
    n, closing = np.bincount(back), np.bincount(back, np.tile(closes[at], 3))
    names = ["".join(chr(x) for x in (k >> 42, (k >> 21) & 0x1FFFFF, k & 0x1FFFFF) if x) for k in kinds.tolist()]
    return pd.DataFrame({"suffix": pd.Series(names, dtype=object), "n": n, "closing": closing.astype(np.int64)})


def judge(response: str | None, prompt: str | None, repeated: float) -> tuple[str | None, str | None]:
    """(defect, suffix): the defect if the pair alone tells it; a suffix if the counts must.
    ``repeated``: share of repeated content in the response."""
    text = tidy(response or "")
    if not LETTER.search(text) and not re.search(r"\d", text):
        return (None if re.fullmatch(r"[\s….・。、,!?「」『』()♪~ー-]+", text) and re.search(r"\.\.|・・", text) else "empty"), None
    if has_residue(response):
        return None, None
    if is_copy(text, prompt):
        return "copied", None
    if len(response) >= MIN_CHARS and repeated >= MIN_SHARE:
        return None, None
    if is_foreign(text):
        return "wrong_language", None
    if is_refusal(text):
        return "refusal", None
    suffix = cut_suffix(text)
    return ("truncated", None) if suffix == "" else (None, suffix)


def _judged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        texts = list(pdf["response"])
        out = [judge(r, p, s) for r, p, s in zip(texts, pdf["prompt"], shares(texts)["repeated_share"])]
        yield pd.DataFrame({"row_id": pdf["row_id"], "defect": [d for d, _ in out], "suffix": [s for _, s in out]}).dropna(subset=["defect", "suffix"], how="all")


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield endings(list(pdf["response"]))


def _asked(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    texts = responses.select("row_id", F.col("id").cast("string").alias("id"), F.col("response").cast("string").alias("response")).where("row_id is not null and id is not null")
    asked = prompts.groupBy(F.col("id").cast("string").alias("id")).agg(F.min("prompt").alias("prompt"))
    return spread_join(texts, asked, "id").select("row_id", "response", "prompt")


def copied_pairs(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """(row_id) of the responses that are their prompt and little else; as in :func:`broken_pairs`."""

    @F.pandas_udf(T.BooleanType())
    def copy(response: pd.Series, prompt: pd.Series) -> pd.Series:
        return pd.Series([bool(r) and is_copy(tidy(r), p) for r, p in zip(response, prompt)], dtype=bool)

    return _asked(responses, prompts).where(copy("response", "prompt")).select("row_id").distinct()


def broken_pairs(responses: DataFrame, prompts: DataFrame) -> DataFrame:
    """(row_id, defect) of the defective pairs.

    ``responses``: row_id, id, response; ``prompts``: id, prompt (one or more rows an id; the
    first prompt in order counts). Pairs without an item are left out. Null and empty responses
    are ``empty``; rows repeated with one row_id are judged once. Null row_ids and ids are left
    out; a null prompt cannot be copied.
    """
    pairs = _asked(responses, prompts)
    kind = pairs.schema["row_id"].dataType.simpleString()
    judged = cut(pairs.mapInPandas(_judged, f"row_id {kind}, defect string, suffix string"))
    counts = responses.select(F.col("response").cast("string")).mapInPandas(_counted, "suffix string, n bigint, closing bigint").groupBy("suffix").agg(F.sum("n").alias("n"), F.sum("closing").alias("closing"))
    # one row a suffix decides for all rows that end in it; its own ending does not count
    open_ends = judged.where("suffix is not null").groupBy("suffix").agg(F.count("*").alias("rows"))
    tails = open_ends.select("suffix", F.explode(F.array(*(F.struct(F.lit(n).alias("width"), F.expr(f"right(suffix, {n})").alias("tail")) for n in (3, 2, 1)))).alias("x")).select("suffix", "x.width", F.col("x.tail").alias("tail"))
    known = tails.join(counts.withColumnRenamed("suffix", "tail"), "tail").where("n > 1")
    verdict = known.groupBy("suffix").agg(F.max_by(F.expr("(closing - 1) / (n - 1)"), "width").alias("closes"))
    cuts = verdict.where(F.col("closes") < CLOSES).select("suffix")
    by_count = spread_join(judged.where("suffix is not null"), cuts, "suffix").select("row_id", F.lit("truncated").alias("defect"))
    return judged.where("defect is not null").select("row_id", "defect").unionByName(by_count).distinct()
