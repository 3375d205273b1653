"""Parameter sweeps: the grid, its cells that are still empty, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sweep_axis(spark: SparkSession, points: int, repeats: int, low: float, high: float) -> DataFrame:
    """i, j, vpp: equal steps in power from low to high, ``repeats`` cells each."""
    step = (high**2 - low**2) / max(1, points - 1)
    return spark.range(points * repeats).select(F.expr(f"int(id div {repeats})").alias("i"), F.expr(f"int(id % {repeats})").alias("j")).withColumn("vpp", F.sqrt(F.lit(low**2) + F.col("i") * step))


def sweep_left(grid: DataFrame, done: DataFrame) -> DataFrame:
    """The cells of the grid without a result, in order."""
    return grid.join(done.select("i", "j").distinct(), ["i", "j"], "left_anti").orderBy("i", "j")


def upserted(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """``new``, and of ``old`` what it doesn't replace."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"), allowMissingColumns=True)
