"""Building an item set: keyed loads, dedup, union, re-numbering, templates, splits, samples.

Order matters in all of them, so every operator takes the columns that order the rows; ids
that could repeat in one place are ordered by all of them. First-wins and last-wins pick a row
by a pre-aggregated minimum or maximum, never by a window over a hot key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.functions.text import col, prompt_lines, strip
from tsumugi.session import cut


def _picked(df: DataFrame, key: list[str], order: list[str], how) -> DataFrame:
    rest = [c for c in df.columns if c not in key]
    best = df.groupBy(*key).agg(how(F.struct(*(F.col(f"`{c}`") for c in rest)), F.struct(*order)).alias("_row"))
    return best.select(*key, "_row.*").select(*df.columns)


def last_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the last in order."""
    return _picked(df, key, order, F.max_by)


def first_wins(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row a key: the first in order."""
    return _picked(df, key, order, F.min_by)


def dedup_key(context: Column | str, user: Column | str, length: int | None = None) -> Column:
    """``context|user``, null as '', cut to ``length`` characters where given."""
    whole = F.concat(F.coalesce(col(context), F.lit("")), F.lit("|"), F.coalesce(col(user), F.lit("")))
    return F.left(whole, F.lit(length)) if length else whole


def tagged_union(parts: list[tuple[DataFrame, str, str | None]]) -> DataFrame:
    """All parts under each other by name; ``source`` and, where given, ``axis`` set for each."""
    out = []
    for i, (df, source, axis) in enumerate(parts):
        df = df.withColumn("source", F.lit(source)).withColumn("part_ord", F.lit(i))
        out.append(df.withColumn("axis", F.lit(axis)) if axis is not None else df)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), out)


def canonical_axis(axis: Column | str, renamed: dict[str, str] | None = None) -> Column:
    """The axis under its present name; null or '' is ``unknown``."""
    a = F.when(strip(axis) == "", None).otherwise(col(axis))
    for old, new in (renamed or {"generation": "generation_gap"}).items():
        a = F.when(a == old, new).otherwise(a)
    return F.coalesce(a, F.lit("unknown"))


def ranked(df: DataFrame, by: str, order: list[str], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``df`` with each row's 0-based place in its group, in order of the columns ``order``.

    A group may hold a third of all rows: rows are range-sorted by group and order, counted by
    partition, and offset by the counts before, so no group is put in one task. ``parts``:
    partitions of the sort, as many as the session's shuffles have by default.
    """
    keys = [F.col(by), *map(F.col, order)]
    spread = (df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)).sortWithinPartitions(by, *order)
    placed = cut(spread.withColumn("_p", F.spark_partition_id()))  # sampled bounds differ from run to run: sorted once
    counts = placed.groupBy(by, "_p").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_b", F.coalesce(F.sum("_n").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = placed.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order)))
    return within.join(before.drop("_n"), [by, "_p"]).withColumn(name, F.col("_r") + F.col("_b") - 1).drop("_p", "_r", "_b")


def renumbered(df: DataFrame, axis: str, order: list[str], pattern: str = "v06-%s-%04d", start: int = 0) -> DataFrame:
    """New stable ids by place in the axis; the old id stays as ``orig_id``."""
    placed = ranked(df.withColumn("orig_id", F.col("id")), axis, order, "_rank")
    return placed.withColumn("id", F.format_string(pattern, F.col(axis), F.col("_rank") + start)).drop("_rank")


def filled(df: DataFrame, dim: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from ``dim`` (key, column) where it is null; dim has one row an axis."""
    return df.join(F.broadcast(dim.withColumnRenamed(column, "_default")), key, "left").withColumn(column, F.coalesce(column, "_default")).drop("_default")


def sft_prompt(axis: Column, definition: Column, context: Column, user: Column) -> Column:
    """The four-line prompt of a training pair; the user's line only if it is not blank."""
    return prompt_lines(F.concat(axis, F.lit("軸: "), F.coalesce(definition, F.lit(""))), F.concat(F.lit("場面: "), F.coalesce(context, F.lit(""))), F.when(strip(user) != "", F.concat(F.lit("ユーザー発言: "), strip(user))), F.lit("回答:"))


def draw(key: Column | str, seed: int) -> Column:
    """A reproducible random order: hexadecimal MD5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string")))


def split(df: DataFrame, by: str, key: str, share: float = 0.8, seed: int = 2026) -> DataFrame:
    """``df`` with ``part``: the first ``share`` of each group, rounded down, in drawn order is
    train, the rest eval. Null groups are a group."""
    d = df.withColumn("_d", draw(key, seed))
    sizes = d.groupBy(by).agg(F.count("*").alias("_n"))
    out = ranked(d.withColumn("_g", F.coalesce(F.col(by), F.lit("\x00"))), "_g", ["_d", key], "_k").drop("_g")
    known = sizes.withColumn("_g2", F.coalesce(F.col(by), F.lit("\x00"))).select("_g2", "_n")
    joined = out.withColumn("_g2", F.coalesce(F.col(by), F.lit("\x00"))).join(known, "_g2")
    return joined.withColumn("part", F.when(F.col("_k") < F.floor(F.col("_n") * share), "train").otherwise("eval")).drop("_d", "_k", "_n", "_g2")


def first_k(df: DataFrame, by: str, order: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group in order; Spark keeps only k a group and task."""
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= k).drop("_k")


def sample_k(df: DataFrame, by: str, key: str, k: int, seed: int = 42) -> DataFrame:
    """``k`` rows of each group in drawn order."""
    return first_k(df.withColumn("_d", draw(key, seed)), by, ["_d", key], k).drop("_d")


def not_done(todo: DataFrame, done: DataFrame, key: str, least: int) -> DataFrame:
    """Rows of ``todo`` whose key has fewer than ``least`` finished rows."""
    finished = done.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select(key)
    return todo.join(finished, key, "left_anti")
