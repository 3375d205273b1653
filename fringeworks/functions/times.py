"""Instants, local times and time windows over traces, in exact integer nanoseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SECOND = 1_000_000_000


def epoch_ns(ts) -> Column:
    return F.unix_micros(ts.cast("timestamp")) * 1000


def local_time(ts, zone: str) -> Column:
    """The wall clock in ``zone`` of an instant, without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


def instant(local, zone: str) -> Column:
    """The UTC instant (without a zone) of a wall clock in ``zone``."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), local.cast("timestamp_ntz"))


def second_of_day(ts) -> Column:
    """Time of day folded onto one date, in seconds."""
    return F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def window_bounds(catalog: DataFrame, start: int | None = None, duration: int | None = None, end: int | None = None, relative: bool = False) -> DataFrame:
    """``catalog`` (start_ns, end_ns, interval_ns and perhaps a view so far: view_start_ns, view_end_ns) with the new view.

    ``start`` and ``end`` are ns since the epoch, or since each trace's start if ``relative``; ``duration`` is in ns. The view is clamped
    into the trace; a duration counts from the start as given, before clamping. Adds start_idx and end_idx, half-open,
    truncated to whole samples. A window that begins behind the view's end drags the end with it, and the other way round.
    """
    if duration is not None and end is not None:
        raise ValueError("give a duration or an end, not both")
    if duration is not None and duration < 0:
        raise ValueError("the duration is negative")
    if duration is not None and start is None:
        raise ValueError("a duration needs a start")
    if start is not None and end is not None and start > end:
        raise ValueError("the start lies behind the end")
    origin = F.col("start_ns") if relative else F.lit(0)
    clamp = lambda c: F.least(F.greatest(c, F.col("start_ns")), F.col("end_ns"))
    seen = "view_start_ns" in catalog.columns
    old_start, old_end = (F.col("view_start_ns"), F.col("view_end_ns")) if seen else (F.col("start_ns"), F.col("end_ns"))
    new_start = old_start if start is None else clamp(F.lit(start) + origin)
    new_end = old_end
    if duration is not None:
        new_end = clamp(F.lit(start + duration) + origin)
    elif end is not None:
        new_end = clamp(F.lit(end) + origin)
        new_start = new_start if start is not None else F.least(new_start, new_end)
    elif start is not None:
        new_end = F.greatest(new_end, new_start)
    viewed = catalog.withColumns({"_vs": new_start, "_ve": new_end}).drop("view_start_ns", "view_end_ns").withColumnsRenamed({"_vs": "view_start_ns", "_ve": "view_end_ns"})
    first = F.expr("(view_start_ns - start_ns) div interval_ns")
    return viewed.withColumn("start_idx", first).withColumn("end_idx", F.col("start_idx") + F.expr("(view_end_ns - view_start_ns) div interval_ns"))


def in_window(samples: DataFrame, bounds: DataFrame, key: str = "trace_id") -> DataFrame:
    """The samples inside their trace's window; the catalog of bounds is the small side."""
    return samples.join(bounds.select(key, "start_idx", "end_idx"), key).where((F.col("sample_idx") >= F.col("start_idx")) & (F.col("sample_idx") < F.col("end_idx"))).drop("start_idx", "end_idx")
