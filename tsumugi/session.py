"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import gc
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cpus: int | str = 8, memory: str = "12g", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    b = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory)
    b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in DEFAULTS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Only where that setting is empty (tests, a single machine) a local folder is made.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = spark.conf.get("tsumugi.local.checkpoint.dir", None)
        if not shared:
            shared = "file://" + tempfile.mkdtemp(prefix="tsumugi-")
            spark.conf.set("tsumugi.local.checkpoint.dir", shared)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared)
    return shared


def cut(df: DataFrame) -> DataFrame:
    """``df`` written once to a table in the shared folder and read back.

    The lineage ends there and the rows survive the loss of any executor; unlike
    ``checkpoint()`` nothing is computed twice.
    """
    spark = df.sparkSession
    at = f"{checkpoint_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of finished intermediate tables; one that is missing is left alone."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        at = jvm.org.apache.hadoop.fs.Path(folder)
        at.getFileSystem(conf).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets go of what finished jobs left: their broadcasts and shuffles stay on the driver and
    the executors' disks until the driver's objects for them are collected. For long loops."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def ship(spark: SparkSession) -> SparkSession:
    """Make this package importable in Python workers, wherever they run. Does it once."""
    sc = spark.sparkContext
    if getattr(sc, "_tsumugi_shipped", False):
        return spark
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="tsumugi-code-")  # on the driver; executors fetch it from there
    with zipfile.ZipFile(f"{folder}/tsumugi_code.zip", "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(f"{folder}/tsumugi_code.zip")
    sc._tsumugi_shipped = True
    return spark
