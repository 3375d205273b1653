"""Event detection and event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.operators.stats import haloed

BLOCK = 1 << 17


def sta_lta(df: DataFrame, short: int, long: int, key: str = "trace_id", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, sample_idx, ratio of the mean energies of the last ``short`` and ``long`` samples; 0 where the long window isn't full."""
    rows = haloed(df, key, max(block, long), long - 1, 0)
    order = Window.partitionBy(key, "block").orderBy("sample_idx")
    energy = F.col(value) * F.col(value)
    ratio = F.avg(energy).over(order.rowsBetween(1 - short, 0)) / F.nullif(F.avg(energy).over(order.rowsBetween(1 - long, 0)), F.lit(0.0))
    return rows.withColumn("ratio", F.when(F.col("sample_idx") < long - 1, 0.0).otherwise(F.coalesce(ratio, F.lit(0.0)))).where("_own").select(key, "sample_idx", "ratio")


def z_detect(df: DataFrame, n: int, key: str = "trace_id", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, sample_idx, z: the energy of the last ``n`` samples, standardised over the trace."""
    rows = haloed(df, key, max(block, n), n - 1, 0)
    s = F.sum(F.col(value) * F.col(value)).over(Window.partitionBy(key, "block").orderBy("sample_idx").rowsBetween(1 - n, 0))
    sums = rows.withColumn("s", s).where("_own").select(key, "sample_idx", "s")
    about = sums.groupBy(key).agg(F.avg("s").alias("_m"), F.stddev_pop("s").alias("_d"))
    return sums.join(about, key).select(key, "sample_idx", ((F.col("s") - F.col("_m")) / F.nullif(F.col("_d"), F.lit(0.0))).alias("z"))


def triggers(df: DataFrame, on: float, off: float, key: str = "trace_id", value: str = "ratio", block: int = BLOCK) -> DataFrame:
    """key, onset, end (sample indices): stretches at ``off`` or above, from their first sample above ``on``.

    Stretches are found within blocks, and those that touch across an edge, a row each, are put together along the trace.
    """
    high = df.where(F.col(value) >= off).withColumn("block", F.expr(f"sample_idx div {block}"))
    inside = Window.partitionBy(key, "block").orderBy("sample_idx")
    islands = high.withColumn("_island", F.col("sample_idx") - F.row_number().over(inside))
    parts = islands.groupBy(key, "block", "_island").agg(F.min("sample_idx").alias("begin"), F.max("sample_idx").alias("end"), F.min(F.when(F.col(value) > on, F.col("sample_idx"))).alias("onset"))
    order = Window.partitionBy(key).orderBy("begin")
    parts = parts.withColumn("_fresh", F.when(F.col("begin") == F.lag("end").over(order) + 1, 0).otherwise(1)).withColumn("_group", F.sum("_fresh").over(order))
    found = parts.groupBy(key, "_group").agg(F.min("onset").alias("onset"), F.max("end").alias("end"))
    return found.where("onset is not null").select(key, "onset", "end")


def merge_events(events: DataFrame, gap: float, keys: list[str], width: float = 4096.0) -> DataFrame:
    """keys, begin, end, n: events that begin within ``gap`` of the end of the one before are one, ending where its last member does.

    A segmented scan: events are ordered within time buckets of ``width``; a bucket's last end and how many groups begin in it are one row, and these rows
    alone are scanned along a key. So no task orders a whole key, and a group may run over any number of buckets.
    """
    bucketed = events.withColumn("_bucket", F.floor(F.col("begin") / width))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("begin", "end")
    fresh = lambda last: F.when(F.col("begin") > last + gap, 1).otherwise(0)
    placed = bucketed.withColumn("_fresh", fresh(F.lag("end").over(inside)))  # the first of a bucket isn't known here
    sums = placed.groupBy(*keys, "_bucket").agg(F.sum("_fresh").alias("_more"), F.min("begin").alias("begin"), F.max_by("end", F.struct("begin", "end")).alias("_last"))
    along = Window.partitionBy(*keys).orderBy("_bucket")
    sums = sums.withColumn("_first", fresh(F.lag("_last").over(along)))
    before = F.coalesce(F.sum(F.col("_first") + F.col("_more")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*keys, "_bucket", (before + F.col("_first")).alias("_ahead"))
    grouped = placed.withColumn("_within", F.sum("_fresh").over(inside)).join(sums, [*keys, "_bucket"]).withColumn("_group", F.col("_ahead") + F.col("_within"))
    return grouped.groupBy(*keys, "_group").agg(F.min("begin").alias("begin"), F.max_by("end", F.struct("begin", "end")).alias("end"), F.count(F.lit(1)).alias("n")).drop("_group")


def coincidences(a: DataFrame, b: DataFrame, keys: list[str], slack: float = 1.0, width: float = 64.0) -> DataFrame:
    """keys, begin, end: events of ``a`` and ``b`` (begin, end in seconds) that overlap within ``slack``.

    Both sides are dealt to time buckets of ``width`` seconds, so the join is on equal keys; a pair that meets in
    several buckets counts in the first.
    """
    bucket = lambda low, high: F.explode(F.sequence(F.floor(low / width), F.floor(high / width)))
    left = a.select(*keys, F.col("begin").alias("b1"), F.col("end").alias("e1"), bucket(F.col("begin") - slack, F.col("end") + slack).alias("_k"))
    right = b.select(*keys, F.col("begin").alias("b2"), F.col("end").alias("e2"), bucket(F.col("begin"), F.col("end")).alias("_k"))
    b1, e1, b2, e2 = (F.col(c) for c in ("b1", "e1", "b2", "e2"))
    meet = left.join(right, [*keys, "_k"]).where(F.col("_k") == F.greatest(F.floor((b1 - slack) / width), F.floor(b2 / width)))
    inside, begins, ends = (b2 >= b1 - slack) & (e2 <= e1 + slack), (b2 >= b1 - slack) & (b2 <= e1 + slack), (e2 >= b1 - slack) & (e2 <= e1 + slack)
    pair = lambda low, high: F.struct(low.alias("begin"), high.alias("end"))
    found = F.when(inside, pair(b2, e2)).when(begins, pair(b2, e1)).when(ends, pair(b1, e2)).when((b2 <= b1 - slack) & (e2 >= e1 + slack), pair(b1, e1))
    return meet.withColumn("_e", found).where("_e is not null").select(*keys, "_e.begin", "_e.end")


def trim_around(samples: DataFrame, events: DataFrame, keys: list[str], margin: float = 15.0, width: float = 64.0) -> DataFrame:
    """Each event's samples (column ``t``) from ``margin`` before its begin to ``margin`` after its end, by time buckets."""
    low, high = F.col("begin") - margin, F.col("end") + margin
    dealt = events.select(*keys, "begin", "end", F.explode(F.sequence(F.floor(low / width), F.floor(high / width))).alias("_k"))
    joined = samples.withColumn("_k", F.floor(F.col("t") / width)).join(dealt, [*keys, "_k"])
    return joined.where((F.col("t") >= low) & (F.col("t") <= high)).drop("_k")
