"""Mixing sources to target weights.

Weighted fair queueing: the documents of a source stand in a shuffled order, the MD5 of a seed and
the key; a source that is used up starts again until its cap of repeats. The virtual finish time
of a document is its source's tokens up to its end over the source's weight. All documents of a
mix are put in order of their finish times, whatever their size, and the queue is cut where the
total budget is used up: until a source reaches its cap, all sources keep their shares but for
the documents on either side of the cut.

No running total puts a source or a mix in one task: an order is divided into ranges (the first
digits of the MD5; equal widths of finish time), totals of the ranges are added up in a table of
bounded size, and running sums go within ranges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsumugi.session import cut as cut_table

DIGITS = 3
#: Ranges of finish time of a mix.
RANGES = 1 << 16


def _running(rows: DataFrame, group: list[str], part: str, order: list[str], total: str, most: str = "tokens") -> DataFrame:
    """``rows`` with the running total of ``most`` in ``total``, by group, in order of part and order."""
    parts = rows.groupBy(*group, part).agg(F.sum(most).alias("_t"))
    earlier = Window.partitionBy(*group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = parts.select(*group, part, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_before"))
    within = F.sum(most).over(Window.partitionBy(*group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_run", within).join(offsets, [*group, part]).withColumn(total, F.col("_before") + F.col("_run")).drop("_before", "_run")


def mix(docs: DataFrame, targets: DataFrame, budget: float | None = None, seed: int = 2026, key: str = "doc_id") -> DataFrame:
    """(mix_id, source, key, pass, tokens, virtual_finish): the documents of each mix.

    ``docs``: key, source, tokens; ``targets``: mix_id, source, target_share, max_repeats.
    ``budget``: tokens of each mix; where it is more than the sources can give under their caps,
    sources at their cap fall short of their share. Without one it is the largest total for which
    every source with documents can give its share. Documents of other or null sources, null keys
    and sizes are left out; sources without documents, shares not above 0 and caps below 1 give
    nothing. Repeated rows count as documents.
    """
    want = targets.where("target_share > 0 and max_repeats >= 1").select("mix_id", "source", "target_share", "max_repeats").distinct()  # one row a source and mix
    rows = cut_table(docs.select(F.col(f"`{key}`").alias("key"), "source", F.col("tokens").cast("bigint").alias("tokens")).where("key is not null and tokens > 0"))  # texts are read once
    totals = rows.join(want.select("source").distinct(), "source", "left_semi").groupBy("source").agg(F.sum("tokens").alias("total"))
    given = totals.join(want, "source")
    reach = F.lit(float(budget)) if budget is not None else F.min(F.col("total") * F.col("max_repeats") / F.col("target_share"))
    quotas = given.join(given.groupBy("mix_id").agg(reach.alias("budget")), "mix_id")
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("key").cast("string")))
    each = rows.join(quotas, "source").withColumn("place", order).withColumn("part", F.substring("place", 1, DIGITS))
    queued = _running(each, ["mix_id", "source"], "part", ["place", "key"], "upto")
    passes = F.least(F.col("max_repeats"), F.ceil(F.col("budget") / F.col("total")).cast("int"))  # no source gives more than all
    copies = queued.withColumn("pass", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), passes)))).withColumn("virtual_finish", ((F.col("pass") - 1) * F.col("total") + F.col("upto")) / F.col("target_share"))
    last = quotas.groupBy("mix_id").agg(F.max(passes * F.col("total") / F.col("target_share")).alias("last"))
    ranged = copies.join(last, "mix_id").withColumn("range", F.least(F.lit(RANGES - 1), F.floor(F.col("virtual_finish") / F.col("last") * RANGES)).cast("int"))
    served = _running(ranged, ["mix_id"], "range", ["virtual_finish", "source", "key", "pass"], "served")
    kept = served.where("served <= budget")
    return kept.select("mix_id", "source", F.col("key").alias(key), F.col("pass").cast("int").alias("pass"), "tokens", "virtual_finish").orderBy("mix_id", "virtual_finish", "source", key, "pass")


def shares(mixed: DataFrame, targets: DataFrame, key: str = "doc_id") -> DataFrame:
    """(mix_id, source, target_share, actual_share, shortfall, tokens, uses, repeats): what each
    source of the targets really gives, and by how much of the mix it falls short; a source
    without documents has share 0."""
    used = mixed.groupBy("mix_id", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"), F.max("pass").alias("repeats"))
    every = targets.join(used, ["mix_id", "source"], "left").na.fill({"tokens": 0, "uses": 0, "repeats": 0})
    total = F.sum("tokens").over(Window.partitionBy("mix_id"))  # one row a source of the targets
    actual = F.round(F.coalesce(F.try_divide(F.col("tokens"), total), F.lit(0.0)), 6)
    out = every.withColumn("actual_share", actual)
    return out.select("mix_id", "source", "target_share", "actual_share", F.round(F.greatest(F.lit(0.0), F.col("target_share") - F.col("actual_share")), 6).alias("shortfall"), "tokens", "uses", F.col("repeats").cast("int").alias("repeats"))
