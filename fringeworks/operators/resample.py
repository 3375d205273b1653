"""Downsampling and differences along a trace."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 17


def block_average(df: DataFrame, n: int, key: str = "trace_id", value: str = "x") -> DataFrame:
    """key, block_idx, mean: each ``n`` samples, the short tail over its own length."""
    return df.groupBy(key, F.expr(f"sample_idx div {n}").alias("block_idx")).agg(F.avg(value).alias("mean"))


def difference(df: DataFrame, key: str = "trace_id", value: str = "x", block: int = BLOCK, scale=1.0) -> DataFrame:
    """key, sample_idx, diff: (next - this) * scale; the last sample of a trace has none. ``scale`` may be a column.

    Each block gets the first value of the next by an equi-join, so a trace isn't sorted in one task.
    """
    cut = df.withColumn("block", F.expr(f"sample_idx div {block}"))
    first = cut.groupBy(key, "block").agg(F.min_by(value, "sample_idx").alias("_next")).withColumn("block", F.col("block") - 1)
    inside = Window.partitionBy(key, "block").orderBy("sample_idx")
    following = F.coalesce(F.lead(value).over(inside), F.col("_next"))
    factor = scale if not isinstance(scale, (int, float)) else F.lit(scale)
    made = cut.join(first, [key, "block"], "left").withColumn("diff", (following - F.col(value)) * factor)
    return made.where("diff is not null").select(key, "sample_idx", "diff")


def settled(df: DataFrame, fs: float, seconds: float = 0.003) -> DataFrame:
    """Samples from the last one before ``seconds`` on."""
    return df.where(F.col("sample_idx") >= int(np.ceil(seconds * fs)) - 1)


def fir_taps(q: int, per: int = 20) -> np.ndarray:
    """A Hamming-windowed sinc of ``per * q + 1`` taps with its edge at 1/q of half the rate and unit gain at zero."""
    n = per * q + 1
    k = np.arange(n) - (n - 1) / 2
    h = np.sinc(k / q) / q * (0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)))
    return h / h.sum()


def decimated(x: np.ndarray, q: int) -> np.ndarray:
    """Every q-th sample of the zero-phase filtered ``x``, zeros beyond its ends: a strided product, nothing filtered in vain."""
    taps = fir_taps(q)
    half = len(taps) // 2
    padded = np.concatenate([np.zeros(half), x, np.zeros(half + q)])
    rows = -(-len(x) // q)
    return np.lib.stride_tricks.sliding_window_view(padded, len(taps))[: rows * q : q] @ taps[::-1]


def decimate(df: DataFrame, q: int, key: str = "trace_id", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, sample_idx (of the decimated trace), x: FIR decimation over whole traces, zeros beyond their ends.

    A tap reaches 10 q samples to either side: a block of inputs gets that halo from its neighbours and is filtered by strided
    products in one task, so a sample is shuffled once (in a halo, twice) and a long trace is many tasks.
    """
    from fringeworks.operators.stats import haloed

    half = 10 * q
    block = max(block // q, -(-half // q)) * q  # blocks begin at samples that are kept
    taps = fir_taps(q)[::-1]
    kind = dict(df.dtypes)[key]

    def run(table):
        import pyarrow as pa

        own = table.column("_own").to_numpy(zero_copy_only=False)
        at = table.column("sample_idx").to_numpy()
        begin = table.column("block")[0].as_py() * block
        if not own.any():  # the halo of a block that the trace doesn't reach
            return pa.table({key: table.column(key)[:0], "sample_idx": pa.array([], pa.int64()), "x": pa.array([], pa.float64())})
        n = int(at[own].max()) + 1 - begin
        x = np.zeros(block + 2 * half)
        x[at - begin + half] = table.column(value).to_numpy()
        rows = -(-n // q)
        made = np.lib.stride_tricks.sliding_window_view(x, len(taps))[: rows * q : q] @ taps
        names = pa.array([table.column(key)[0].as_py()] * rows, table.column(key).type)
        return pa.table({key: names, "sample_idx": pa.array(begin // q + np.arange(rows)), "x": pa.array(made)})

    cut = haloed(df.select(key, "sample_idx", F.col(value).cast("double").alias(value)), key, block, half, half)
    return cut.groupBy(key, "block").applyInArrow(run, f"{key} {kind}, sample_idx long, x double")
