"""Joins that hold up when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on; so at most 1 / HOT keys are hot.
HOT = 0.002


def spread_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot: float = HOT, salts: int = 64) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) without putting a hot key in one task.

    Keys with more than ``hot`` of the left rows are found by a pre-aggregated count; there are
    at most ``1 / hot`` of them. Left rows of hot keys get one of ``salts`` salts and
    the few right rows of hot keys are repeated under every salt; all other rows have salt 0.
    One shuffle of each side; the result has each matching row once. ``how``: inner or left. A
    null key matches nothing.
    """
    if how not in ("inner", "left"):
        raise ValueError(how)
    counts = left.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.sum("_n").alias("_all"))
    heavy = counts.crossJoin(F.broadcast(total)).where(F.col("_n") > F.col("_all") * hot).select(F.col(key), F.lit(True).alias("_hot"))
    # at most 1 / hot keys: a proven bound, whatever the size of the input
    marked = left.join(F.broadcast(heavy), key, "left")
    # the salt depends on the row and its partition: a task done again gives the same rows
    held = [F.col(f"`{c}`") for c, kind in left.dtypes if "map<" not in kind and "variant" not in kind]
    salted = marked.withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(*held, F.spark_partition_id()), F.lit(salts)).cast("int")).otherwise(0)).drop("_hot")
    copies = right.join(F.broadcast(heavy), key, "left").withColumn("_salt", F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop("_hot")
    return salted.join(copies, [key, "_salt"], how).drop("_salt")
