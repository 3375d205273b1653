"""A stored index of captures: a row for each block of samples, built once and used for any window.

A row has where the counter stood at the block's first and last sample, how far from zero it went, the wraps in the block (a sparse list) and the turns
before it. A window then needs its own bytes and one row: the turns up to its first sample are those before the block and the block's wraps
up to there; the wraps within are in the samples that are read anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeworks.functions.decode import WRAP
from fringeworks.operators.unwrap import unwrap
from fringeworks.sources import store
from fringeworks.sources.captures import _open, dealt, read_ranges
from fringeworks.sources.phase_trace import BLOCK, header_words, name_of

_WRAPS = "array<struct<sample_idx:bigint,delta:int>>"
_SCANNED = f"trace_id string, block long, n long, first_m long, last_m long, inner long, least long, most long, wraps {_WRAPS}"


def scan_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """trace_id, block, n, first_m, last_m, inner (wraps less wraps back inside), least and most (of the counter's size), wraps: read range by range, a row each; no sample leaves its task."""
    ranges = files.select("path", "length", F.explode(F.expr(f"sequence(0l, greatest(length div 8 - 1, 0), {block}l)")).alias("first"))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        kind = pa.list_(pa.struct([("sample_idx", pa.int64()), ("delta", pa.int32())]))
        types = [pa.string(), *[pa.int64()] * 7, kind]
        for b in batches:
            rows = []
            for path, length, first in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                with _open(path) as f:
                    head = header_words(f.read_at(min(8, length), 0))
                    n = min(block, length // 8 - (head or 0) - first)
                    if head is None or n <= 0:
                        continue
                    m = np.frombuffer(f.read_at(8 * n, 8 * (head + first)), "<i8") >> 48
                step = np.diff(m)
                delta = (step > WRAP).astype(np.int64) - (step < -WRAP)
                at = np.flatnonzero(delta)
                wraps = [{"sample_idx": int(first + k + 1), "delta": int(delta[k])} for k in at]
                rows.append((name_of(path), first // block, n, int(m[0]), int(m[-1]), int(delta.sum()), int(np.abs(m).min()), int(np.abs(m).max()), wraps))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split(" ")[0] for x in _SCANNED.split(", ")])

    return dealt(ranges, F.least(F.expr("length div 8") - F.col("first"), F.lit(block))).mapInArrow(run, _SCANNED)


def with_turns(scanned: DataFrame, block: int = BLOCK) -> DataFrame:
    """The blocks with ``before``: the turns up to and with the step to their first sample, which is among their wraps then."""
    along = Window.partitionBy("trace_id").orderBy("block")
    step = F.col("first_m") - F.lag("last_m").over(along)
    edged = scanned.withColumn("edge", F.when(step > WRAP, 1).when(step < -WRAP, -1).otherwise(0))
    before = F.sum(F.col("edge") + F.col("inner")).over(along.rowsBetween(Window.unboundedPreceding, 0)) - F.col("inner")
    first = F.array(F.struct((F.col("block") * block).alias("sample_idx"), F.col("edge").alias("delta")))
    wraps = F.when(F.col("edge") != 0, F.concat(first, "wraps")).otherwise(F.col("wraps"))
    return edged.withColumn("before", before).withColumn("wraps", wraps).drop("inner", "edge")


def add_captures(files: DataFrame, path: str, block: int = BLOCK) -> int:
    """Indexes the captures of ``files`` (path, length) that the index at ``path`` hasn't got; how many. Others may do so meanwhile: each is in it once."""
    spark = files.sparkSession
    known = store.committed_keys(spark, path, "trace_id string").withColumnRenamed("trace_id", "_name")
    name = F.regexp_extract("path", "([^/]+?)([.]bin)?$", 1)
    fresh = files.withColumn("_name", F.url_decode(F.regexp_replace(name, "[+]", "%2B")))
    fresh = fresh.join(known, "_name", "left_anti").drop("_name")
    return store.append_new(with_turns(scan_blocks(fresh, block), block), path, "trace_id")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return store.read(spark, path, f"{_SCANNED.replace('inner long, ', '')}, before long").drop("commit_name")


def window_turns(index: DataFrame, bounds: DataFrame, block: int = BLOCK) -> DataFrame:
    """``bounds`` (trace_id, start_idx, end_idx) with turns (up to and with each window's first sample) and here (what of it is that sample's own wrap)."""
    rows = index.select("trace_id", "block", "before", "wraps")
    placed = bounds.withColumn("block", F.expr(f"start_idx div {block}")).join(rows, ["trace_id", "block"])
    edge = F.aggregate(F.filter("wraps", lambda w: w["sample_idx"] == F.col("block") * block), F.lit(0).cast("long"), lambda s, w: s + w["delta"])
    upto = F.aggregate(F.filter("wraps", lambda w: w["sample_idx"] <= F.col("start_idx")), F.lit(0).cast("long"), lambda s, w: s + w["delta"])
    here = F.aggregate(F.filter("wraps", lambda w: w["sample_idx"] == F.col("start_idx")), F.lit(0).cast("long"), lambda s, w: s + w["delta"])
    return placed.select(*bounds.columns, (F.col("before") - edge + upto).alias("turns"), here.alias("here"))


def read_windows(files: DataFrame, index: DataFrame, bounds: DataFrame, anchor: str = "trace", block: int = BLOCK) -> DataFrame:
    """trace_id, sample_idx, word, m, m_unwrapped of the windows ``bounds`` (trace_id, start_idx, end_idx; one for each trace): only their bytes are read.

    Turns count from the trace's first sample, or with ``anchor='window'`` from the window's, with that sample's own wrap.
    """
    if anchor not in ("trace", "window"):
        raise ValueError("anchor is 'trace' or 'window'")
    name = F.url_decode(F.regexp_replace(F.regexp_extract("path", "([^/]+?)([.]bin)?$", 1), "[+]", "%2B"))
    named = files.select("path", "length").withColumn("trace_id", name).join(bounds.select("trace_id", "start_idx", "end_idx"), "trace_id")
    words = read_ranges(named, block).withColumn("m", F.shiftright("word", 48))
    found = unwrap(words, block)  # a window's first sample has no step, so its turns count from there
    ahead = window_turns(index, bounds, block).select("trace_id", (F.col("turns") if anchor == "trace" else F.col("here")).alias("_turns"))
    return found.join(ahead, "trace_id").withColumn("m_unwrapped", F.col("m_unwrapped") - 65536 * F.col("_turns")).select("trace_id", "sample_idx", "word", "m", "m_unwrapped")
