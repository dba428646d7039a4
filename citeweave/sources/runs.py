"""Runs by slug as a partitioned table, of which one can be written anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_runs(df: DataFrame, path: str, by: str = "slug") -> None:
    """A folder for each run, all anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy(by).parquet(path)


def replace_runs(df: DataFrame, path: str, by: str = "slug") -> None:
    """Writes the runs that df has rows of; the folders of all others stay as they are. The new files become visible together, when all are there."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def read_run(spark: SparkSession, path: str, slug: str, by: str = "slug") -> DataFrame:
    """One run's rows; no other folder is listed for reading."""
    return spark.read.parquet(path).where(F.col(by) == F.lit(slug))
