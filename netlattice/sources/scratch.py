"""Shared scratch tables: written once under ``spark.checkpoint.dir``, read back by every executor."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_root(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs on one machine (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = f"file://{tempfile.mkdtemp(prefix='netlattice-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def saved(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet below the scratch root and return the written table.

    Cuts the lineage of iterative plans; the folder goes when the driver's JVM ends, or when it is ``freed``.
    """
    path = f"{scratch_root(spark)}/netlattice-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)
    table = spark.read.schema(df.schema).parquet(path)
    table.scratch_path = path
    return table


def freed(*tables: DataFrame) -> None:
    """Deletes scratch tables that nothing will read any more; a table that ``saved`` did not write is left alone."""
    for table in tables:
        if path := getattr(table, "scratch_path", None):
            spark = table.sparkSession
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
