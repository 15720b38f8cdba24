"""Aggregates of scores: task summaries, coverage, comparisons, histograms, totals.

All group sums are partial before their shuffle. An empty input gives one row with n = 0 and
null rates where a summary has no groups, and no row where it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.text import clean_generated, overlap
from tsumugi.operators.scoring import artifacts


# Fixed value: the greatest total a summary reports.
MAX_POSSIBLE = 12


def rate(c: Column) -> Column:
    """Share of true values; null of none."""
    return F.avg(c.cast("int"))


def task_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """n, pass and degenerate rate, mean total and the greatest total a score reports, of the
    columns ``passed``, ``is_degenerate`` and ``total``; one that is not there gives null."""
    have = df.columns
    null = F.lit(None).cast("double")
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        (F.bround(rate(F.col("passed")), 6) if "passed" in have else F.max(null)).alias("pass_rate"),
        (F.bround(rate(F.col("is_degenerate")), 6) if "is_degenerate" in have else F.max(null)).alias("degenerate_rate"),
        (F.bround(F.avg("total"), 2) if "total" in have else F.max(null)).alias("mean_total"),
        (F.when(F.count("total") > 0, F.lit(MAX_POSSIBLE)) if "total" in have else F.max(null).cast("int")).alias("max_possible"),
    )


def coverage_summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Micro-averaged keyword coverage: hits over all keywords, with a guard against none."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.sum("kw_hit").alias("kw_hit"), F.sum("kw_max").alias("kw_max"), F.bround(F.sum("kw_hit") / F.greatest(F.lit(1), F.sum("kw_max")), 6).alias("coverage"), F.sum("anti_hit").alias("anti_hit"), F.bround(F.avg("resp_len"), 6).alias("avg_len"))


def seed_mean_std(df: DataFrame, by: list[str], seed: str, value: Column) -> DataFrame:
    """Mean and sample deviation over seeds of each seed's mean of ``value``."""
    per = df.groupBy(*by, seed).agg(F.avg(value).alias("v"))
    return per.groupBy(*by).agg(F.count("*").alias("seeds"), F.bround(F.avg("v"), 6).alias("mean"), F.bround(F.stddev_samp("v"), 6).alias("std"))


def compare_arms(df: DataFrame, key: list[str], by: str, arm: str, base: str, tuned: str, text: str, gold: str, order: list[str]) -> DataFrame:
    """A row a group: two runs over the keys both have. n, mean length of the cleaned texts
    and their overlap with ``gold``, and the sum of all artifacts, for either run.

    The last row in ``order`` of a key and run counts, also a null text, which is as an empty
    one; keys of one run alone and null keys are left out.
    """
    spot = F.struct(*order)
    last = df.where(F.col(arm).isin(base, tuned)).groupBy(*key, arm).agg(F.max_by(F.struct(by, text, gold), spot).alias("x"))
    s = F.coalesce(clean_generated(F.col(f"x.{text}")), F.lit(""))
    parts = artifacts(F.coalesce(F.col(f"x.{text}"), F.lit("")))
    one = last.select(*key, arm, F.col(f"x.{by}").alias(by), F.length(s).alias("len"), overlap(s, F.coalesce(F.col(f"x.{gold}"), F.lit(""))).alias("overlap"), sum(parts.values(), F.lit(0)).cast("bigint").alias("art"))
    side = lambda a: one.where(F.col(arm) == a)
    b, t = side(base).drop(arm), side(tuned).select(*key, *(F.col(c).alias(f"{c}_tuned") for c in ("len", "overlap", "art")))
    both = b.withColumnsRenamed({c: f"{c}_base" for c in ("len", "overlap", "art")}).join(t, key)
    means = [F.avg(f"{m}_{a}").alias(f"{m}_{a}") for m in ("len", "overlap") for a in ("base", "tuned")]
    return both.groupBy(by).agg(F.count("*").alias("n"), *means, *(F.sum(f"art_{a}").alias(f"art_{a}") for a in ("base", "tuned")))


def grand_macro(df: DataFrame) -> DataFrame:
    """One row of a comparison: means over groups of their means, sums of artifacts, the lift of
    the overlap, also in percent (guarded against 0), and the differences of the rest."""
    o, p, m, n = (F.avg(c) for c in ("overlap_base", "overlap_tuned", "len_base", "len_tuned"))
    a, b = F.sum("art_base"), F.sum("art_tuned")
    return df.agg(
        F.count("*").alias("groups"),
        *(F.bround(x, 6).alias(y) for x, y in ((m, "len_base"), (n, "len_tuned"), (n - m, "len_delta"), (o, "overlap_base"), (p, "overlap_tuned"), (p - o, "lift"))),
        F.bround(100 * (p - o) / F.greatest(F.lit(1e-4), o), 4).alias("lift_pct"),
        a.alias("art_base"), b.alias("art_tuned"), (b - a).alias("art_delta"),
    )


def histogram(df: DataFrame, reason: str, order: list[str], top: int | None = None) -> DataFrame:
    """(reason, n, first): reasons by count; ties go by the first row they stand in."""
    h = df.groupBy(reason).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    out = h.orderBy(F.desc("n"), "first")
    return (out.limit(top) if top else out).select(reason, "n")


def top_by_group(df: DataFrame, by: str, reason: str, order: list[str]) -> DataFrame:
    """(by, reason, n): the most frequent reason of each group; ties by first row."""
    h = df.groupBy(by, reason).agg(F.count("*").alias("n"), F.min(F.struct(*order)).alias("first"))
    w = Window.partitionBy(by).orderBy(F.desc("n"), "first")  # one row a reason
    return h.withColumn("_k", F.row_number().over(w)).where("_k = 1").select(by, reason, "n")


def totals(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts with subtotals and a grand total; ``TOTAL`` stands for all."""
    marks = [F.when(F.grouping(c) == 1, "TOTAL").otherwise(F.coalesce(F.col(c), F.lit("(null)"))).alias(c) for c in by]
    return df.rollup(*by).agg(F.count("*").alias("n"), *[m.alias(f"_{c}") for c, m in zip(by, marks)]).select(*[F.col(f"_{c}").alias(c) for c in by], "n")


def leaks(df: DataFrame, limit: float = 0.3) -> DataFrame:
    """The items of which more than ``limit`` leaked: a row each, not one list for all."""
    return df.where(F.col("ratio") > limit)


def leak_summary(df: DataFrame, by: str, limit: float = 0.3) -> DataFrame:
    """A row a split: questions, mean and maximal ratio, and how many lie above ``limit``."""
    return df.groupBy(by).agg(F.count("*").alias("n_questions"), F.bround(F.avg("ratio"), 6).alias("mean_leak_ratio"), F.bround(F.max("ratio"), 6).alias("max_leak_ratio"), F.count_if(F.col("ratio") > limit).alias("n_leaks"))
