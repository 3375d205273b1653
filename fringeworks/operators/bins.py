"""Jobs over fixed time bins and many traces: which files a bin needs, what is left to do, averaged spectra per bin."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fringeworks.functions.decode import from_db
from fringeworks.functions.times import SECOND, second_of_day
from fringeworks.operators.resample import fir_taps
from fringeworks.operators.spectral import zoom_density


def time_bins(spark: SparkSession, start_ns: int, end_ns: int, step_ns: int) -> DataFrame:
    """bin_start_ns from start (included) to end (not included)."""
    return spark.range(start_ns, end_ns, step_ns).select(F.col("id").alias("bin_start_ns"))


def bins_left(bins: DataFrame, done: DataFrame, key: str = "bin_start_ns") -> DataFrame:
    return bins.join(done.select(key).distinct(), key, "left_anti")


def bin_files(traces: DataFrame, start_ns: int, end_ns: int, step_ns: int, mode: str = "endpoints") -> DataFrame:
    """bin_start_ns, trace_id, position (1 for the first in name order): the traces that a bin needs.

    ``endpoints``: those that hold the bin's start or end instant, bounds included; ``overlap``: all that share time with it.
    Bins are evenly spaced, so each trace names its bins by arithmetic: no range join.
    """
    low, high = F.col("start_ns") - start_ns, F.col("end_ns") - start_ns
    last = (end_ns - start_ns - 1) // step_ns
    if mode == "endpoints":
        k = F.explode(F.sequence(F.greatest(F.ceil(low / step_ns), F.lit(0)), F.least(F.floor(high / step_ns), F.lit(last + 1))))
        held = traces.where((F.ceil(low / step_ns) <= F.floor(high / step_ns)) & (high >= 0) & (F.ceil(low / step_ns) <= last + 1)).select("trace_id", k.alias("k"))
        found = held.unionByName(held.withColumn("k", F.col("k") - 1)).where(f"k between 0 and {last}").distinct()
    elif mode == "overlap":
        k = F.explode(F.sequence(F.greatest(F.floor(low / step_ns), F.lit(0)), F.least(F.ceil(high / step_ns) - 1, F.lit(last))))
        held = traces.where((high > 0) & (low < end_ns - start_ns) & (high > low)).select("trace_id", k.alias("k"))
        found = held.distinct()
    else:
        raise ValueError("mode is 'endpoints' or 'overlap'")
    order = Window.partitionBy("k").orderBy("trace_id")
    return found.select((F.lit(start_ns) + F.col("k") * step_ns).alias("bin_start_ns"), "trace_id", F.row_number().over(order).alias("position"))


def batches(bin_traces: DataFrame, catalog: DataFrame, bin_ns: int, batch_ns: int = 120 * SECOND, window_ns: int = 6 * SECOND, overlap: float = 0.9, settle_ns: int = SECOND) -> DataFrame:
    """bin_start_ns, trace_id, batch, start_idx, end_idx: stretches of a trace for a bin.

    Batches are ``batch_ns`` long and ``batch_ns`` less the window overlap apart. They begin at the bin, or ``settle_ns`` into a
    trace that begins later; a bin's next trace goes on where the one before ran out; the last may reach into the next bin.
    """
    hop = batch_ns - int(window_ns * overlap)
    joined = bin_traces.join(catalog.select("trace_id", "start_ns", "end_ns", "interval_ns"), "trace_id")
    order = Window.partitionBy("bin_start_ns").orderBy("position")
    joined = joined.withColumn("_from", F.greatest("bin_start_ns", F.col("start_ns") + settle_ns)).withColumn("_to", F.least(F.col("end_ns"), F.col("bin_start_ns") + bin_ns))
    count = F.when(F.col("_to") > F.col("_from"), F.ceil((F.col("_to") - F.col("_from")) / hop)).otherwise(0)
    reached = F.max(F.col("_from") + (count * hop)).over(order.rowsBetween(Window.unboundedPreceding, -1))
    joined = joined.withColumn("_from", F.greatest("_from", F.coalesce(reached, F.col("_from"))))
    count = F.when(F.col("_to") > F.col("_from"), F.ceil((F.col("_to") - F.col("_from")) / hop)).otherwise(0).cast("int")
    rows = joined.withColumn("_n", count).where("_n > 0").withColumn("batch", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    begin = F.col("_from") + F.col("batch") * hop
    rows = rows.withColumn("_b", begin).withColumn("_e", F.least(F.col("_b") + batch_ns, F.col("end_ns")))
    rows = rows.withColumn("start_idx", F.expr("(_b - start_ns) div interval_ns"))
    return rows.withColumn("end_idx", F.col("start_idx") + F.expr("(_e - _b) div interval_ns")).select("bin_start_ns", "trace_id", "batch", "start_idx", "end_idx", (F.lit(SECOND) / F.col("interval_ns")).alias("fs"))


def _halo(factors: tuple[int, ...]) -> int:
    """Samples on either side that a cascade of decimations can reach: ten outputs of each step, at that step's rate."""
    reach, rate = 0, 1
    for q in factors:
        reach, rate = reach + 10 * q * rate, rate * q
    return reach


def _needed(first: int, last: int, length: int, factors: tuple[int, ...]) -> list[tuple[int, int, int]]:
    """For the outputs ``first`` to ``last`` (not included) of a cascade over ``length`` samples: what each step reads, and its input's length."""
    lengths = [length]
    for q in factors:
        lengths.append(-(-lengths[-1] // q))
    out = []
    for q, n in zip(reversed(factors), reversed(lengths[:-1]), strict=True):
        first, last = max(0, first * q - 10 * q), min(n, (last - 1) * q + 10 * q + 1)
        out.append((first, last, n))
    return out[::-1]


def cascaded(x: np.ndarray, begin: int, first: int, last: int, length: int, factors: tuple[int, ...]) -> np.ndarray:
    """The outputs ``first`` to ``last`` of the cascade over a batch of ``length`` samples, of which ``x`` has those from ``begin`` on that it needs.

    Each step takes zeros beyond the ends of its own input, so the outputs are those of the whole batch to the last bit but for the order of sums.
    """
    reads = _needed(first, last, length, factors)
    x = x[reads[0][0] - begin : reads[0][1] - begin]
    for (low, _, _), q, (to_low, to_high) in zip(reads, factors, [*[r[:2] for r in reads[1:]], (first, last)], strict=True):
        taps = fir_taps(q)
        half = len(taps) // 2
        at = to_low * q - half - low  # where the first output's taps begin in x
        ahead = max(0, -at)
        padded = np.concatenate([np.zeros(ahead), x, np.zeros(max(0, (to_high - 1) * q + half + 1 - low - len(x)))])
        x = np.lib.stride_tricks.sliding_window_view(padded, len(taps))[at + ahead :: q][: to_high - to_low] @ taps[::-1]
    return x


def packed_samples(samples: DataFrame, value: str = "x", cell: int = 1 << 16) -> DataFrame:
    """trace_id, cell, data (doubles): each trace's samples in cells of ``cell``, a row each; missing ones are zero. This is the only time that a sample is a row in a shuffle."""
    kind = dict(samples.dtypes)["trace_id"]

    def run(table):
        import pyarrow as pa

        at = table.column("sample_idx").to_numpy() % cell
        x = np.zeros(int(at.max()) + 1)
        x[at] = table.column("x").to_numpy()
        return pa.table({"trace_id": table.column("trace_id")[:1], "cell": table.column("cell")[:1], "data": pa.array([x.tobytes()], pa.binary())})

    rows = samples.select("trace_id", F.expr(f"sample_idx div {cell}").alias("cell"), "sample_idx", F.col(value).cast("double").alias("x")).where("x is not null")
    return rows.groupBy("trace_id", "cell").applyInArrow(run, f"trace_id {kind}, cell long, data binary")


def decimated_batches(samples: DataFrame, plan: DataFrame, factors: tuple[int, ...] = (2, 2, 5, 5), value: str = "x", block: int = 1 << 17, cell: int = 1 << 16) -> DataFrame:
    """bin_start_ns, trace_id, batch, fs (after decimation), length (likewise), first, data: each batch through the cascade, in pieces of ``block`` samples before it.

    A piece gets its halo from the packed samples, so a task's bytes are those of a block, whatever the rate; only packed rows are dealt to batches.
    """
    kind = dict(samples.dtypes)["trace_id"]
    down = int(np.prod(factors)) if factors else 1
    step = max(1, block // down)  # outputs of a piece
    reach = _halo(factors)
    n = F.col("end_idx") - F.col("start_idx")
    pieces = plan.select("bin_start_ns", "trace_id", "batch", "fs", "start_idx", n.alias("n")).where("n > 0")
    pieces = pieces.withColumn("length", F.expr(f"(n + {down - 1}) div {down}")).withColumn("first", F.explode(F.expr(f"sequence(0l, length - 1, {step}l)")))
    low = F.greatest(F.col("first") * down - reach, F.lit(0))
    high = F.least((F.least(F.col("first") + step, F.col("length")) - 1) * down + reach + 1, F.col("n"))
    cells = F.explode(F.expr(f"sequence((start_idx + low) div {cell}, (start_idx + high - 1) div {cell})"))
    wanted = pieces.withColumns({"low": low, "high": high}).withColumn("cell", cells)
    joined = wanted.join(packed_samples(samples, value, cell), ["trace_id", "cell"])
    schema = f"bin_start_ns long, trace_id {kind}, batch int, fs double, length long, first long, data binary"

    def run(batches):
        import pyarrow as pa

        for b in batches:
            made = []
            for row in b.select(["start_idx", "n", "length", "first", "low", "high", "cells"]).to_pylist():
                x = np.zeros(row["high"] - row["low"])
                origin = row["start_idx"] + row["low"]  # the trace's sample at x[0]
                for part in row["cells"]:
                    own, at = np.frombuffer(part["data"]), part["cell"] * cell
                    i, j = max(origin, at), min(origin + len(x), at + len(own))
                    if i < j:
                        x[i - origin : j - origin] = own[i - at : j - at]
                last = min(row["first"] + step, row["length"])
                made.append((cascaded(x, row["low"], row["first"], last, row["n"], factors) if factors else x).tobytes())
            fs = pa.array(b.column("fs").to_numpy() / down)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("bin_start_ns", "trace_id", "batch")), fs, b.column("length"), b.column("first"), pa.array(made, pa.binary())], names=["bin_start_ns", "trace_id", "batch", "fs", "length", "first", "data"])

    # a piece has a few cells, so they are gathered by Spark and many pieces go to Python together
    gathered = joined.groupBy("bin_start_ns", "trace_id", "batch", "first", "fs", "start_idx", "n", "length", "low", "high").agg(F.collect_list(F.struct("cell", "data")).alias("cells"))
    return gathered.mapInArrow(run, schema)


def averaged_spectrum(pieces: DataFrame, window_s: float = 6.0, overlap: float = 0.9, f1: float = 1.5, f2: float = 50.0, least_s: float = 6.0, block: int = 1 << 17) -> DataFrame:
    """bin_start_ns, freq_idx, freq_hz, freq_label_hz, n_windows, mean_db, std_db, from the pieces of ``decimated_batches``.

    Windows are dealt in groups that span about ``block`` decimated samples, so a task has a few pieces and no batch; their dB are
    reduced there to count, mean and variance, and these are merged per (bin, frequency).
    """
    from fringeworks.operators.spectral import power_of_two_near

    schema = "bin_start_ns long, freq_idx int, freq_hz double, freq_label_hz double, n long, mean double, var double"
    sized = pieces.withColumn("nfft", power_of_two_near(F.col("fs") * window_s))
    sized = sized.where(F.col("length") >= F.greatest(F.col("nfft"), F.floor(F.col("fs") * least_s))).withColumn("hop", F.col("nfft") - F.floor(F.col("nfft") * overlap))
    sized = sized.withColumn("many", F.greatest(F.expr(f"({block} - nfft) div hop"), F.lit(1))).withColumn("size", F.octet_length("data") / 8)
    # of the windows j (from hop j to hop j + nfft) those that share samples with the piece, as groups of ``many``
    windows = F.expr("(length - nfft) div hop")
    low, high = F.greatest(F.ceil((F.col("first") - F.col("nfft") + 1) / F.col("hop")), F.lit(0)), F.least(F.floor((F.col("first") + F.col("size") - 1) / F.col("hop")), windows)
    dealt = sized.withColumns({"a": low.cast("long"), "b": high.cast("long")}).where("a <= b").withColumn("part", F.explode(F.expr("sequence(a div many, b div many)")))

    def run(batches):
        import pyarrow as pa

        names = [n.split(" ")[0] for n in schema.split(", ")]

        def reduced(fs, nfft, held):
            """The groups of windows of one rate, a row for each and frequency; one transform is for all."""
            counts = np.array([len(w) for _, w in held])
            starts = np.cumsum(counts) - counts
            db = 10 * np.log10(np.maximum(zoom_density(np.concatenate([w for _, w in held]), f1, f2, fs, "linear"), 1e-300))
            mean = np.add.reduceat(db, starts) / counts[:, None]
            var = np.add.reduceat((db - np.repeat(mean, counts, 0)) ** 2, starts) / counts[:, None]
            k = np.tile(np.arange(nfft), len(held))
            columns = [np.repeat([b for b, _ in held], nfft), k.astype(np.int32), f1 + k * (f2 - f1) / nfft, np.tile(np.linspace(f1, f2, nfft), len(held)), np.repeat(counts, nfft), mean.ravel(), var.ravel()]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)

        for b in batches:
            held: dict = {}
            for r in range(b.num_rows):
                row = {c: b.column(c)[r].as_py() for c in ("bin_start_ns", "part", "fs", "length", "nfft", "hop", "many", "pieces")}
                fs, nfft, hop = row["fs"], row["nfft"], row["hop"]
                begin = row["part"] * row["many"] * hop
                count = min(row["many"], (row["length"] - nfft) // hop + 1 - row["part"] * row["many"])
                x = np.zeros((count - 1) * hop + nfft)
                for piece in row["pieces"]:
                    own = np.frombuffer(piece["data"])
                    i, j = max(begin, piece["first"]), min(begin + len(x), piece["first"] + len(own))
                    if i < j:
                        x[i - begin : j - begin] = own[i - piece["first"] : j - piece["first"]]
                same = held.setdefault((fs, nfft), [])
                same.append((row["bin_start_ns"], np.lib.stride_tricks.sliding_window_view(x, nfft)[::hop]))
                if sum(w.size for _, w in same[-64:]) > 1 << 16 or len(same) == 1024:
                    yield reduced(fs, nfft, held.pop((fs, nfft)))
            for (fs, nfft), same in held.items():
                yield reduced(fs, nfft, same)

    grouped = dealt.groupBy("bin_start_ns", "trace_id", "batch", "part", "fs", "length", "nfft", "hop", "many").agg(F.collect_list(F.struct("first", "data")).alias("pieces"))
    parts = grouped.mapInArrow(run, schema)
    keys = ["bin_start_ns", "freq_idx", "freq_hz", "freq_label_hz"]
    sums = parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum(F.col("n") * (F.col("var") + F.col("mean") ** 2)).alias("q"))
    mean = F.col("s") / F.col("n")
    return sums.select(*keys, F.col("n").alias("n_windows"), mean.alias("mean_db"), F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))).alias("std_db"))


def diurnal_profile(spectrum: DataFrame, freq_idx: int, ts: str = "bin_start", drop_last: int = 9) -> DataFrame:
    """ts, day, second_of_day, value, low, high: one frequency, linear, by day; the last ``drop_last`` points of the last day are left out."""
    one = spectrum.where(F.col("freq_idx") == freq_idx).withColumn("day", F.to_date(ts)).withColumn("second_of_day", second_of_day(F.col(ts)))
    rank = F.row_number().over(Window.partitionBy("day").orderBy(F.desc(ts)))
    last = one.agg(F.max("day").alias("_last"))
    one = one.withColumn("_rank", rank).join(F.broadcast(last)).where((F.col("day") != F.col("_last")) | (F.col("_rank") > drop_last))
    m, s = F.col("mean_db"), F.col("std_db")
    return one.select(ts, "day", "second_of_day", from_db(m).alias("value"), from_db(m - s).alias("low"), from_db(m + s).alias("high"))


def nth_from_end(df: DataFrame, n: int, keys: list[str], ts: str = "bin_start") -> DataFrame:
    """The n-th last row by time for each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ts)))).where(F.col("_r") == n).drop("_r")


def collated(spark: SparkSession, path: str, freqs: list[int]) -> DataFrame:
    """bin_start, freq_idx, position (1 for the first by time), value, low, high (linear) of a stored table of bin spectra, ordered by frequency and time."""
    rows = spark.read.parquet(path).where(F.col("freq_idx").isin(freqs))
    m, s = F.col("mean_db"), F.col("std_db")
    position = F.row_number().over(Window.partitionBy("freq_idx").orderBy("bin_start"))
    return rows.select("bin_start", "freq_idx", position.alias("position"), from_db(m).alias("value"), from_db(m - s).alias("low"), from_db(m + s).alias("high")).orderBy("freq_idx", "bin_start")
