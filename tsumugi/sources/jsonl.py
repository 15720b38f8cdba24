"""JSON Lines and other files as sources and sinks.

Lines keep their file and number, so that everything that depends on order can be ordered. The
line break is LF. Files are split by Spark; numbers come from a two-pass count, so no file has
to fit in one task.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsumugi.operators.schema_drift import parse


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a file of a pattern, is there, on any file system Spark reads."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def first_existing(spark: SparkSession, *paths: str) -> str | None:
    """The first path that is there, in order of preference."""
    return next((p for p in paths if exists(spark, p)), None)


def lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(file, line_no, line): the lines of the files that exist; line_no counts from 1.

    Missing files give no rows. Blank lines keep their number.
    """
    there = [p for p in paths if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "file string, line_no bigint, line string")
    raw = spark.read.text(there).select("_metadata.file_path", "_metadata.file_block_start", F.col("value").alias("line"))
    placed = raw.withColumn("_m", F.monotonically_increasing_id())
    counts = placed.groupBy("file_path", "file_block_start").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    w = Window.partitionBy("file_path").orderBy("file_block_start").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))  # one row a block
    # ids rise by one within a block: it is read by one task
    out = placed.join(before, ["file_path", "file_block_start"])
    return out.select(F.col("file_path").alias("file"), (F.col("_m") - F.col("_first") + F.col("_before") + 1).alias("line_no"), "line")


def document(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """The rows of one JSON document over several lines: an object, or an array of objects. A
    missing file gives no rows of ``schema``, and an error where no schema is given."""
    if schema is not None and not exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(schema) if schema is not None else reader).json(path)


def parsed(src: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of lines (file, line_no, line): typed rows with file and line_no, and a
    row (file, line_no, error) for every line that is no whole JSON object. Blank lines are
    neither. Strict: no trailing text, no NaN; a key given twice has its last value."""
    known = {f.name for f in schema.fields}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ok, text = [], []
            for line in pdf["line"]:
                found = parse(line)
                ok.append(found is not None)
                text.append(json.dumps({k: v for k, v in found.items() if k in known}, ensure_ascii=False) if found is not None else None)
            yield pd.DataFrame({"file": pdf["file"], "line_no": pdf["line_no"], "ok": ok, "text": text})

    read = src.where(F.col("line").rlike(r"(?U)\S")).mapInPandas(run, "file string, line_no bigint, ok boolean, text string")
    rows = read.where("ok").select("file", "line_no", F.from_json("text", schema).alias("r")).select("file", "line_no", "r.*")
    return rows, read.where("not ok").select("file", "line_no", F.lit("not a whole JSON object").alias("error"))


def strict(src: DataFrame, schema: T.StructType) -> DataFrame:
    """Typed rows; the first bad line raises when the rows are used."""
    rows, errors = parsed(src, schema)
    fail = errors.select(F.raise_error(F.concat_ws(":", "file", "line_no", "error")).cast("boolean").alias("x"))
    return rows.unionByName(fail.where("x").select(*(F.lit(None).cast(t).alias(n) for n, t in rows.dtypes)))


def write_jsonl(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """One object a line in order; null fields are left out. Range-sorted files, or one file for
    small results."""
    out = df.coalesce(1).sortWithinPartitions(*order) if one_file else df.orderBy(*order)
    out.write.mode("overwrite").option("ignoreNullFields", "true").json(path)


def write_master(df: DataFrame, folder: str, by: str) -> None:
    """All rows in ``master`` and a folder an axis in ``by_axis``."""
    df.write.mode("overwrite").json(f"{folder}/master")
    df.write.mode("overwrite").partitionBy(by).json(f"{folder}/by_axis")


def write_report(summary: DataFrame, details: DataFrame, folder: str) -> None:
    """Summary and details of a scoring run side by side."""
    summary.write.mode("overwrite").json(f"{folder}/summary")
    details.write.mode("overwrite").json(f"{folder}/results")


def append_batch(df: DataFrame, path: str, batch: int | str) -> None:
    """Adds a batch; doing a batch again replaces it, so a retry doubles nothing."""
    df.write.mode("overwrite").json(f"{path}/batch={batch}")


def perf_lines(spark: SparkSession, path: str, top: int = 15) -> DataFrame:
    """The first lines of a run's log that tell its speed, in order."""
    speed = r"(?i)llama_perf|tokens/s|tok/s|eval time|draft|accept"
    return lines(spark, path).where(F.col("line").rlike(speed)).orderBy("file", "line_no").limit(top)
