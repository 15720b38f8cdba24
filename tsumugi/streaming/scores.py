"""Row-wise scores and windowed rates under Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsumugi.operators.scoring import degenerate_reason


def scored(stream: DataFrame, text: str = "response") -> DataFrame:
    """A stream (or table) with ``deg_reason``; keeps no state."""
    return stream.withColumn("deg_reason", degenerate_reason(text))


def degenerate_rates(stream: DataFrame, time: str = "ingested_at", by: str = "variant", window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Degenerate rate of each variant and window; rows later than ``late`` are left out, rows
    repeated with one row_id within it count once. Rows without a time are left out."""
    rows = scored(stream.where(F.col(time).isNotNull()).withWatermark(time, late))
    rows = rows.dropDuplicatesWithinWatermark(["row_id"]) if stream.isStreaming else rows.dropDuplicates(["row_id"])
    rates = rows.groupBy(F.window(time, window), by).agg(F.count("*").alias("n"), F.count_if(F.col("deg_reason") != "").alias("degenerate"))
    return rates.select(F.col("window.start").alias("window_start"), by, "n", "degenerate")
