"""Rule-based scores of responses; every function adds columns and shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsumugi.functions.text import clean_generated, col, count_matches, english_runs, strip
from tsumugi.operators.predicates import BACKTICK, PLACEHOLDER, any_pattern, contains_any, head_match, markers, matched, natural_end

# Marker lists of the scores.
ECHOES = ("## ユーザー発言", "## あなたの応答", "## 文脈", "## 場面", "## 元の発言")
POLITE_V2 = ("ございます", "いらっしゃ", "申し上げ", "お持ちになって", "おっしゃられ")
POLITE_V1 = ("ございます", "いらっしゃ", "申し上げ")
SILENCE_V2 = ("<silence>", "(沈黙)", "（沈黙）", "(無言)", "（無言）", "...")
SILENCE_V1 = ("<silence>", "(沈黙)", "(無言)")
WARMTH = ("ね", "よ", "かな", "おかえり", "おはよう", "おやすみ", "ありがとう", "すごい", "嬉しい", "楽しい", "頑張", "大丈夫")
EMPATHY = ("うん", "そっか", "そう", "わかる", "辛い", "嬉しい", "良かった", "悲しい", "大変", "そうだね")
GRAMS = (4, 5, 6, 8)


def degenerate_reason(c: Column | str) -> Column:
    """Why a response is degenerate, or '': empty, echoes the template, repeats a line three
    times, or, in more than 50 characters, an n-gram three times in a row.

    A triple that ends with the text does not count: published scores rest on that.
    """
    r = strip(c)
    lines = F.filter(F.transform(F.split(r, "\n"), lambda x: strip(x)), lambda x: x != "")
    most = F.array_max(F.transform(F.array_distinct(lines), lambda x: F.size(F.filter(lines, lambda y: y == x))))
    out = F.when(r == "", "empty").when(contains_any(r, markers(ECHOES)), "template_echo").when(most >= 3, F.format_string("line_repeated_%dx", most))
    for n in GRAMS:
        out = out.when((F.length(r) > 50) & r.rlike(rf"(?s)(.{{{n}}})\1\1(?=.)"), f"ngram_{n}_3x_repeat")
    return out.otherwise("")


def keigo_v2(text: Column, level: Column, expected: Column, anti: Column) -> dict[str, Column]:
    """Marker share with penalties, and whether it passes."""
    hits, n = F.size(matched(text, expected)), F.greatest(F.size(expected), F.lit(1))
    bad, deg = any_pattern(anti, text), degenerate_reason(text) != ""
    share = F.when(deg, 0.0).otherwise(hits / n)
    penal = F.when(bad, F.greatest(F.lit(0.0), share - 0.5)).otherwise(share)
    plain = F.when(contains_any(text, markers(POLITE_V2)) | deg, 0.0).otherwise(1.0)
    casual = level == "tameguchi"
    return {"matched": hits, "has_anti": bad, "is_degenerate": deg, "score": F.bround(F.when(casual, plain).otherwise(penal), 3), "passed": F.when(casual, plain >= 1.0).otherwise((penal >= 0.5) & ~bad & ~deg)}


def keigo_v1(text: Column, level: Column, expected: Column, anti: Column) -> dict[str, Column]:
    hits, n = F.size(matched(text, expected)), F.greatest(F.size(expected), F.lit(1))
    bad, polite = any_pattern(anti, text), contains_any(text, markers(POLITE_V1))
    casual = level == "tameguchi"
    return {"matched": hits, "has_anti": bad, "score": F.bround(F.when(casual, F.when(polite, 0.0).otherwise(1.0)).otherwise(hits / n), 3), "passed": F.when(casual, ~polite).otherwise((hits / n >= 0.5) & ~bad)}


def silence_v2(text: Column, examples: Column) -> dict[str, Column]:
    r = strip(text)
    token = contains_any(r, markers(SILENCE_V2))
    same = F.coalesce(F.exists(examples, lambda x: strip(x) == r), F.lit(False))
    short = (F.length(r) <= 8) | token
    deg = degenerate_reason(text) != ""
    return {"has_silence_token": token, "matches_example": same, "is_short": short, "is_degenerate": deg, "response_len": F.length(r), "passed": ~deg & (token | same | short)}


def silence_v1(text: Column, examples: Column) -> dict[str, Column]:
    quiet = contains_any(text, markers(SILENCE_V1)) | (F.length(strip(text)) < 10)
    same = F.coalesce(F.exists(examples, lambda x: F.contains(text, x) | F.contains(x, text)), F.lit(False))
    return {"is_silence_or_short": quiet, "matches_example": same, "passed": quiet | same}


def family_v2(text: Column, anti: Column) -> dict[str, Column]:
    r = strip(text)
    deg = degenerate_reason(text) != ""
    fits = F.length(r).between(5, 150).cast("int")
    zero = lambda c: F.when(deg, 0).otherwise(c).cast("int")
    count = lambda ms: F.size(matched(r, markers(ms)))
    empathy = F.least(F.lit(3), count(EMPATHY) + fits)
    proper = F.when(any_pattern(anti, r), 0).otherwise(2) + fits
    natural = F.when(natural_end(text), 2).otherwise(1)
    warm = F.least(F.lit(3), count(WARMTH))
    return {"empathy": zero(empathy), "appropriateness": zero(proper), "naturalness": zero(natural), "warmth": zero(warm), "total": zero(empathy + proper + natural + warm), "is_degenerate": deg}


def family_v1(text: Column, anti: Column) -> dict[str, Column]:
    bad, fits = any_pattern(anti, text, head_match), F.length(text).between(5, 200)
    good = ~bad & fits
    pick = lambda c, a, b: F.when(c, a).otherwise(b)
    return {"empathy": pick(good, 2, 1), "appropriateness": pick(~bad, 2, 0), "naturalness": pick(fits, 2, 1), "warmth": pick(~bad, 2, 1), "total": pick(good, 8, 4)}


def rule_v3(text: Column, anti: Column) -> dict[str, Column]:
    """Pass: no anti-pattern as it stands and a length of 1 to 199; a missing response fails."""
    t = F.coalesce(text, F.lit(""))
    bad = F.coalesce(contains_any(t, anti), F.lit(False))
    return {"has_anti": bad, "passed": ~bad & (F.length(t) > 0) & (F.length(t) < 200)}


def coverage(text: Column, keywords: Column, anti: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    some = lambda c: F.coalesce(F.size(F.filter(c, lambda k: F.contains(t, k))), F.lit(0))
    return {"kw_hit": F.greatest(some(keywords), F.lit(0)), "kw_max": F.greatest(F.coalesce(F.size(keywords), F.lit(0)), F.lit(0)), "anti_hit": F.greatest(some(anti), F.lit(0)), "resp_len": F.length(t)}


def artifacts(text: Column | str) -> dict[str, Column]:
    s = clean_generated(text)
    return {"english_fragment": F.size(english_runs(s)), "backtick": count_matches(s, BACKTICK), "html_tag": count_matches(s, r"(?i)</?(?:em|p|br|span|div)>"), "placeholder_only": s.rlike(PLACEHOLDER).cast("int")}


def answered(items: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """Items with a response, one row each: the response that came last (by ``ord``) of each id
    counts, empty ones are skipped, blank ones stay. Null keys match nothing."""
    last = responses.groupBy(key).agg(F.max_by("response", "ord").alias("response")).where("response is not null and response <> ''")
    return items.join(last, key)


def all_items(items: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """All items; '' where there is no response."""
    last = responses.groupBy(key).agg(F.max_by("response", "ord").alias("response"))
    return items.join(last, key, "left").withColumn("response", F.coalesce("response", F.lit("")))


def without_response(items: DataFrame, responses: DataFrame, key: str = "id") -> DataFrame:
    """(key, error): the items that have no response."""
    return items.select(key).join(responses.select(key).distinct(), key, "left_anti").select(key, F.lit("missing response").alias("error"))


def unknown_ids(responses: DataFrame, items: DataFrame, key: str = "id") -> DataFrame:
    """Responses to no item, with how many each id has."""
    return responses.join(items.select(key).distinct(), key, "left_anti").groupBy(key).agg(F.count("*").alias("n"))


def by_task(df: DataFrame) -> DataFrame:
    """``df`` (task, response, anti_patterns, examples, level, markers) with ``passed`` and
    ``total`` of the rule its task's name begins with: keigo by ``keigo_v2``, silence by
    ``silence_v2``, family by ``family_v2``, which gives no pass but a total; other tasks and
    empty responses have no row. Null patterns, examples and markers are none. One pass."""
    kind = F.when(F.startswith("task", F.lit("keigo")), "keigo").when(F.startswith("task", F.lit("silence")), "silence").when(F.startswith("task", F.lit("family")), "family")
    text, anti = F.col("response"), F.col("anti_patterns")
    keigo = keigo_v2(text, F.coalesce("level", F.lit("")), F.coalesce("markers", F.array().cast("array<string>")), F.coalesce(anti, F.array().cast("array<string>")))
    passed = F.when(kind == "keigo", keigo["passed"]).when(kind == "silence", silence_v2(text, F.col("examples"))["passed"])
    total = F.when(kind == "family", family_v2(text, anti)["total"])
    return df.where(kind.isNotNull() & (F.col("response") != "")).withColumns({"passed": passed, "total": total, "is_degenerate": degenerate_reason("response") != ""})


def merged(responses: DataFrame, items: DataFrame, key: str, order: list[str], n: int = 3) -> DataFrame:
    """The first ``n`` responses in order with their items' columns; the item's win a clash."""
    few = responses.orderBy(*order).limit(n)
    return few.drop(*[c for c in items.columns if c != key and c in few.columns]).join(items, key)
