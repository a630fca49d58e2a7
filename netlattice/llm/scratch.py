"""What every operator here needs of the session: shared scratch tables, input tables, shuffle width."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netlattice.sources.scratch import saved, scratch_root

__all__ = ["saved", "scratch_root", "table", "width"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def width(spark: SparkSession) -> int:
    """Number of shuffle partitions the session asks for."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
