"""Repair of the 16-bit turn counter, parallel within one trace.

A trace is cut into blocks of ``block`` samples by index, so the answer doesn't depend on how rows lie. A block takes the
last counter of the block before it by an equi-join; wraps are found and summed inside the block, and the blocks' totals, one
row each, are summed along the trace and joined back. No task holds more than a block, or a trace's row per block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.functions.decode import WRAP

BLOCK = 1 << 17


def _steps(iqm: DataFrame, block: int, key: str) -> DataFrame:
    """``iqm`` with block and step: the counter less the one of the sample before, null at a trace's first."""
    cut = iqm.withColumn("block", F.expr(f"sample_idx div {block}"))
    last = cut.groupBy(key, "block").agg(F.max_by("m", "sample_idx").alias("_carry")).withColumn("block", F.col("block") + 1)
    inside = Window.partitionBy(key, "block").orderBy("sample_idx")
    return cut.join(last, [key, "block"], "left").withColumn("step", F.col("m") - F.coalesce(F.lag("m").over(inside), F.col("_carry"))).drop("_carry")


def deltas(iqm: DataFrame, block: int = BLOCK, key: str = "trace_id") -> DataFrame:
    """``iqm`` with block and delta: +1 where the counter has jumped up by more than WRAP, -1 where down, else 0."""
    return _steps(iqm, block, key).withColumn("delta", F.when(F.col("step") > WRAP, 1).when(F.col("step") < -WRAP, -1).otherwise(0)).drop("step")


def rollovers(iqm: DataFrame, block: int = BLOCK, key: str = "trace_id") -> DataFrame:
    """key, sample_idx, delta: the wraps alone."""
    return deltas(iqm, block, key).where("delta != 0").select(key, "sample_idx", F.col("delta").cast("smallint").alias("delta"))


def suspicious(iqm: DataFrame, block: int = BLOCK, key: str = "trace_id") -> DataFrame:
    """key, sample_idx, step: steps above half the range that are not taken for wraps."""
    return _steps(iqm, block, key).where((F.abs("step") > 0x8000) & (F.abs("step") <= WRAP)).select(key, "sample_idx", "step")


def _unwrapped(rows: DataFrame, key: str, anchor: str, bounds: DataFrame | None) -> DataFrame:
    """Rows with block and delta (those without m are stored wraps) -> m_unwrapped, inside ``bounds``.

    A block's running sum and its offset, from one row for each block that is summed along the trace.
    """
    before = Window.partitionBy(key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.groupBy(key, "block").agg(F.sum("delta").alias("_total")).select(key, "block", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(key, "block").orderBy("sample_idx").rangeBetween(Window.unboundedPreceding, 0)
    found = rows.withColumn("_turns", F.sum("delta").over(inside)).where("m is not null").join(offsets, [key, "block"]).withColumn("_turns", F.col("_turns") + F.col("_before"))
    return _counted(found, key, anchor, bounds)


def _counted(found: DataFrame, key: str, anchor: str, bounds: DataFrame | None) -> DataFrame:
    """m_unwrapped from the turns at each sample, inside ``bounds``."""
    if bounds is not None:
        found = found.join(bounds.select(key, "start_idx", "end_idx"), key).where("sample_idx >= start_idx and sample_idx < end_idx").drop("start_idx", "end_idx")
    turns = F.col("_turns")
    if anchor == "window":  # a wrap on the first sample of the window counts, those before it don't
        begin = found.groupBy(key).agg(F.min_by(F.col("_turns") - F.col("_here"), "sample_idx").alias("_begin"))
        found, turns = found.join(begin, key), turns - F.col("_begin")
    return found.withColumn("m_unwrapped", F.col("m") - 65536 * turns).drop("_turns", "_before", "_begin", "_here", "delta", "block")


def _anchored(anchor: str) -> None:
    if anchor not in ("trace", "window"):
        raise ValueError("anchor is 'trace' or 'window'")


def unwrap(iqm: DataFrame, block: int = BLOCK, key: str = "trace_id", anchor: str = "trace", bounds: DataFrame | None = None) -> DataFrame:
    """``iqm`` with m_unwrapped, only inside ``bounds`` (key, start_idx, end_idx) if they are given.

    Turns are counted from the trace's first sample, or with ``anchor='window'`` from each window's: the two differ by a multiple of
    65536 in a window. Wraps are looked for in all that ``iqm`` holds. Samples are shuffled once, by (trace, block): steps inside blocks need no other block, and
    those from block to block are found on one row for each block, with the turns before it.
    """
    _anchored(anchor)
    inside, along = Window.partitionBy(key, "block").orderBy("sample_idx"), Window.partitionBy(key).orderBy("block")
    wrap = lambda step: F.when(step > WRAP, 1).when(step < -WRAP, -1).otherwise(0)
    cut = iqm.withColumn("block", F.expr(f"sample_idx div {block}"))
    inner = cut.withColumn("_ahead", F.lag("m").over(inside)).withColumn("delta", wrap(F.col("m") - F.col("_ahead")))
    blocks = inner.groupBy(key, "block").agg(F.min_by("m", "sample_idx").alias("_first"), F.max_by("m", "sample_idx").alias("_last"), F.sum("delta").alias("_inner"))
    carried = F.when(F.lag("block").over(along) == F.col("block") - 1, F.lag("_last").over(along))
    blocks = blocks.withColumn("_edge", wrap(F.col("_first") - carried))
    ahead = F.coalesce(F.sum(F.col("_edge") + F.col("_inner")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    blocks = blocks.select(key, "block", "_edge", (ahead + F.col("_edge")).alias("_before"))
    found = inner.withColumn("_turns", F.sum("delta").over(inside.rowsBetween(Window.unboundedPreceding, 0))).join(blocks, [key, "block"])
    found = found.withColumns({"_turns": F.col("_turns") + F.col("_before"), "_here": F.when(F.col("_ahead").isNull(), F.col("_edge")).otherwise(F.col("delta"))})
    return _counted(found.drop("_ahead", "_edge"), key, anchor, bounds)


def apply_rollovers(iqm: DataFrame, wraps: DataFrame, block: int = BLOCK, key: str = "trace_id", anchor: str = "trace", bounds: DataFrame | None = None) -> DataFrame:
    """``iqm`` with m_unwrapped from a stored table of wraps, as ``unwrap``: samples and wraps of a block are sorted together and summed on the way.

    ``iqm`` may hold the samples of a window only; turns before it count with ``anchor='trace'``.
    """
    _anchored(anchor)
    samples = iqm.withColumns({"block": F.expr(f"sample_idx div {block}"), "delta": F.lit(0)})
    stored = wraps.select(key, "sample_idx", F.col("delta").cast("int").alias("delta"), F.expr(f"sample_idx div {block}").alias("block"))
    rows = samples.unionByName(stored, allowMissingColumns=True)
    same = Window.partitionBy(key, "block").orderBy("sample_idx").rangeBetween(0, 0)
    return _unwrapped(rows.withColumn("_here", F.sum("delta").over(same)), key, anchor, bounds)
