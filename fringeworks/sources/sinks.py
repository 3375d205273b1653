"""Result stores: partitioned Parquet with dynamic overwrite, bins added by commits, and keyed upserts by staging."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.operators.sweep import upserted
from fringeworks.sources.store import append_new, read


def write_bins(spectra: DataFrame, path: str) -> None:
    """Bin spectra by date. A rerun replaces the dates it brings, so no bin is stored twice."""
    dated = spectra.withColumn("date", F.to_date(F.timestamp_micros(F.expr("bin_start_ns div 1000"))))
    dated.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)


def append_bins(spectra: DataFrame, path: str) -> int:
    """Bins that aren't in the store yet are added to it; how many. Others may add to it meanwhile: no bin is stored twice."""
    dated = spectra.withColumn("date", F.to_date(F.timestamp_micros(F.expr("bin_start_ns div 1000"))))
    return append_new(dated, path, "bin_start_ns", "date")


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    return read(spark, path).drop("commit_name")


def upsert_cells(cells: DataFrame, path: str, staging: str, keys: list[str] | None = None, by: str = "i") -> None:
    """Replace the cells of a stored grid by key. The result is staged first: Spark can't overwrite what it reads."""
    spark = cells.sparkSession
    keys = keys or ["i", "j"]
    old = spark.read.parquet(path).join(cells.select(by).distinct(), by, "left_semi")
    upserted(cells, old.select(*cells.columns), keys).write.mode("overwrite").parquet(staging)
    spark.read.parquet(staging).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
