"""Scores by a judge: prompts, reading of the judge's text, and judges that can be plugged in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.functions.text import col, prompt_lines
from tsumugi.operators.scoring import family_v1

Judge = Callable[[str], str]


def judge_prompt(context: Column, user: Column, expected: Column, anti: Column, response: Column) -> Column:
    """The text a judge reads; missing parts are empty, anti-patterns joined by ', '."""
    part = lambda name, c: F.concat(F.lit(f"{name}: "), F.coalesce(c, F.lit("")))
    return prompt_lines(part("文脈", context), part("発言", user), part("期待", expected), part("避ける", F.array_join(anti, ", ")), part("応答", response))


def parse_score(c: Column | str) -> Column:
    """The score in a judge's text, 0 to 12, or null.

    First a number after 総合, score, 合計 or total (any case, a colon or space between), cut to
    the range; else the first free-standing number of the range. A full-width colon does not
    count as one, and letters beside a number keep it from standing free."""
    t = col(c)
    named = F.nullif(F.regexp_extract(t, r"(?iU)(?:総合|score|合計|total)[:\s]*(\d+)", 1), F.lit(""))
    free = F.nullif(F.regexp_extract(t, r"(?U)\b(1[0-2]|\d)\b", 1), F.lit(""))
    digits = lambda x: F.translate(x, "０１２３４５６７８９", "0123456789").try_cast("decimal(38,0)")
    big = F.when(named.isNotNull() & digits(named).isNull(), F.lit(12))  # beyond 38 digits
    cut = F.when(digits(named).isNotNull(), F.least(F.lit(12), digits(named)).cast("int"))
    return F.coalesce(cut, big, digits(free).cast("int"))


PARTS = ("empathy", "appropriateness", "naturalness", "warmth")


def parse_parts(c: Column | str) -> Column:
    """The sum of the four parts in the JSON between the first { and the last } of a judge's
    text; null where it is no JSON or a part is missing, for a fallback to take over."""
    t = col(c)
    body = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    v = F.from_json(F.nullif(body, F.lit("")), "struct<empathy: int, appropriateness: int, naturalness: int, warmth: int>")
    return sum((v[p] for p in PARTS[1:]), v[PARTS[0]])


def parts_or_rule(text: Column | str, response: Column, anti: Column) -> Column:
    """The total a judge's text gives, or that of the first family rule where it gives none."""
    return F.coalesce(parse_parts(text), family_v1(response, anti)["total"])


def rule_judge(prompt: str) -> str:
    """A judge without a model, for tests: more for a response of middling length."""
    response = prompt.rpartition("応答: ")[2]
    return f"総合: {0 if not response.strip() else 9 if 5 <= len(response) <= 150 else 5}"


def judged(df: DataFrame, prompt: str, judge: Judge = rule_judge, tries: int = 1) -> DataFrame:
    """``df`` with ``judge_text`` and ``judge_score``. The judge runs in the executors, batch by
    batch; an exception, after ``tries`` tries, gives a null text and score, as does a null prompt."""
    def ask(p: str | None) -> str | None:
        for _ in range(tries if p is not None else 0):
            try:
                return judge(p)
            except Exception:  # noqa: BLE001 - whatever a judge may raise
                continue
        return None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(judge_text=pdf[prompt].map(ask))

    schema = df.drop("judge_text", "judge_score")
    out = schema.mapInPandas(run, T.StructType([*schema.schema.fields, T.StructField("judge_text", T.StringType())]))
    return out.withColumn("judge_score", parse_score("judge_text"))


def judge_summary(df: DataFrame, by: str) -> DataFrame:
    """n, judged, mean of the scores there are, and the share of responses under 3 characters."""
    short = (F.length("response") > 0) & (F.length("response") < 3)
    return df.groupBy(by).agg(F.count("*").alias("n"), F.count("judge_score").alias("judged"), F.bround(F.avg("judge_score"), 6).alias("mean_score"), F.bround(F.avg(short.cast("int")), 6).alias("degenerate_rate"))
