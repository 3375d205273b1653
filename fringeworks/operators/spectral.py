"""Windows, detrending, tapers and spectra.

A trace is cut into blocks that get the samples their last windows need from the next block; a block's overlapped windows are views of
one array, so a sample is shuffled once or twice whatever the overlap. A window's spectrum is then a small numpy step on Arrow
batches, without a further shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def nearest_power_of_two(x: float) -> int:
    """The power of two nearest to ``x``; of two as near, the smaller."""
    low = 1 << max(0, int(np.floor(np.log2(x))))
    return low if x - low <= 2 * low - x else 2 * low


def power_of_two_near(x):
    """``nearest_power_of_two`` of a column."""
    low = F.pow(F.lit(2.0), F.floor(F.log2(x)))
    return F.when(x - low <= 2 * low - x, low).otherwise(2 * low).cast("long")


def frames(df: DataFrame, nfft: int, hop: int, key: str = "trace_id", value: str = "x", block: int = 1 << 17) -> DataFrame:
    """key, win_idx, samples (array in order): the whole windows of ``nfft`` samples, ``hop`` apart."""
    from fringeworks.operators.stats import haloed

    if not 0 < hop <= nfft:
        raise ValueError("windows must overlap by less than their length")
    count = max(block // hop, -(-nfft // hop))  # windows that begin in a block
    block = count * hop
    kind = dict(df.dtypes)[key]

    def run(table):
        import pyarrow as pa

        table = table.sort_by("sample_idx")
        x, first = table.column(value).to_numpy(), table.column("block")[0].as_py()
        whole = min(count, (len(x) - nfft) // hop + 1) if len(x) >= nfft and table.column("sample_idx")[0].as_py() == first * block else 0
        windows = np.lib.stride_tricks.sliding_window_view(x, nfft)[: whole * hop : hop] if whole else np.empty((0, nfft))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(whole + 1, dtype=np.int32) * nfft), pa.array(np.ascontiguousarray(windows).ravel()))
        names = pa.array([table.column(key)[0].as_py()] * whole, table.column(key).type)
        return pa.table({key: names, "win_idx": pa.array(first * count + np.arange(whole)), "samples": lists})

    cut = haloed(df.select(key, "sample_idx", F.col(value).cast("double").alias(value)), key, block, 0, nfft - hop)
    return cut.groupBy(key, "block").applyInArrow(run, f"{key} {kind}, win_idx long, samples array<double>")


def centre_time(nfft: int, hop: int, fs: float):
    return (F.lit(nfft / 2) + F.col("win_idx") * hop) / fs


def detrended(x: np.ndarray, kind: str | Callable) -> np.ndarray:
    """Rows of ``x`` without their mean or least-squares line; a callable is applied as it is."""
    if callable(kind):
        return kind(x)
    if kind == "none":
        return x
    if kind == "mean":
        return x - x.mean(1, keepdims=True)
    if kind == "linear":
        t = np.arange(x.shape[1]) - (x.shape[1] - 1) / 2
        slope = x @ t / max(1e-300, t @ t)
        return x - x.mean(1, keepdims=True) - slope[:, None] * t
    raise ValueError(f"no way to detrend by {kind!r}")


def taper(kind: str | Callable, n: int) -> np.ndarray:
    if callable(kind):
        return np.asarray(kind(n))
    if kind == "hann":
        return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(1)
    if kind == "box":
        return np.ones(n)
    raise ValueError(f"no taper {kind!r}")


@lru_cache(8)
def _chirp(n: int, m: int, begin: float, step: float):
    """What Bluestein's transform of ``n`` samples to ``m`` frequencies needs: (chirp, its transform, length)."""
    size = 1 << int(np.ceil(np.log2(n + m - 1)))
    k = np.arange(max(n, m), dtype=float)
    w = np.exp(-1j * np.pi * step * k**2)
    pre = np.exp(-2j * np.pi * begin * np.arange(n)) * w[:n]
    kernel = np.zeros(size, complex)
    kernel[:m] = 1 / w[:m]
    kernel[size - n + 1 :] = 1 / w[1:n][::-1]
    return pre, np.fft.fft(kernel), w[:m], size


def zoom_transform(x: np.ndarray, f1: float, f2: float, m: int, fs: float) -> np.ndarray:
    """Rows of ``x`` at f1 + k (f2 - f1) / m, k < m: chirp-z by Bluestein."""
    pre, kernel, post, size = _chirp(x.shape[1], m, f1 / fs, (f2 - f1) / m / fs)
    return np.fft.ifft(np.fft.fft(x * pre, size, axis=1) * kernel, axis=1)[:, :m] * post


def zoom_density(x: np.ndarray, f1: float, f2: float, fs: float, detrend: str | Callable = "none", window: str | Callable = "hann") -> np.ndarray:
    """One-sided power density of rows of ``x`` on as many frequencies as samples. All but the first bin count double, and but the last
    if their number is even, as in a full spectrum."""
    n = x.shape[1]
    w = taper(window, n)
    power = np.abs(zoom_transform(detrended(x, detrend) * w, f1, f2, n, fs)) ** 2 / fs / (w @ w)
    power[:, 1 : n - 1 if n % 2 == 0 else n] *= 2
    return power


def _by_row(df: DataFrame, keys: list[str], column: str, made: Callable, name: str) -> DataFrame:
    """keys and ``name`` (array<double>): ``made`` of the stacked arrays of a batch, grouped by their length."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in keys), f"{name} array<double>"])

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            rows, out = b.column(len(keys)).to_pylist(), [None] * b.num_rows
            by_size: dict[int, list[int]] = {}
            for k, r in enumerate(rows):
                if r:
                    by_size.setdefault(len(r), []).append(k)
            for own in by_size.values():
                for k, y in zip(own, made(np.array([rows[k] for k in own], float)), strict=True):
                    out[k] = y
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(keys))], pa.array(out, pa.list_(pa.float64()))], names=[*keys, name])

    return df.select(*keys, column).mapInArrow(run, schema)


def _long(rows: DataFrame, keys: list[str], array: str, freq, label=None) -> DataFrame:
    out = rows.select(*keys, F.posexplode(array).alias("freq_idx", "value")).withColumn("freq_hz", freq)
    return out if label is None else out.withColumn("freq_label_hz", label)


def zoom_spectrogram(windows: DataFrame, keys: list[str], f1: float, f2: float, fs: float, nfft: int, amplitude: bool = False, detrend: str | Callable = "none", window: str | Callable = "hann", sides: str = "onesided", mode: str = "psd") -> DataFrame:
    """keys, freq_idx, value, freq_hz (evaluated at), freq_label_hz (evenly spaced with both ends): a row per window and frequency."""
    if sides != "onesided" or mode != "psd":
        raise ValueError("only one-sided power densities")
    made = lambda x: zoom_density(x, f1, f2, fs, detrend, window)
    rows = _by_row(windows, keys, "samples", (lambda x: np.sqrt(made(x))) if amplitude else made, "spectrum")
    k = F.col("freq_idx")
    return _long(rows, keys, "spectrum", f1 + k * ((f2 - f1) / nfft), f1 + k * ((f2 - f1) / (nfft - 1)))


def full_spectrogram(df: DataFrame, fs: float, win_s: float | None = None, overlap: float = 0.9, db: bool = False, key: str = "trace_id", value: str = "x") -> DataFrame:
    """key, win_idx, freq_idx, freq_hz, value: Hann windows of the trace without its mean, amplitude or 10 log10 of the power, without zero frequency."""
    nfft = nearest_power_of_two((fs / 100 if win_s is None else win_s) * fs)
    if nfft < 2:
        raise ValueError("the window is too short")
    hop = nfft - int(nfft * overlap)
    mean = df.groupBy(key).agg(F.avg(value).alias("_mean"))
    centred = df.join(mean, key).withColumn(value, F.col(value) - F.col("_mean"))

    def made(x):
        w = taper("hann", nfft)
        power = np.abs(np.fft.rfft(x * w, axis=1)) ** 2 / fs / (w @ w)
        power[:, 1:-1] *= 2
        return 10 * np.log10(np.maximum(power[:, 1:], 1e-300)) if db else np.sqrt(power[:, 1:])

    rows = _by_row(frames(centred, nfft, hop, key, value), [key, "win_idx"], "samples", made, "spectrum")
    return _long(rows, [key, "win_idx"], "spectrum", (F.col("freq_idx") + 1) * (fs / nfft))


def segments(df: DataFrame, key: str = "trace_id", value: str = "x", length: int = 1 << 20, halo: int = 0) -> DataFrame:
    """key, segment, samples: stretches of at most ``length`` samples, so an array stays bounded.

    With ``halo`` up to so many samples of the neighbours lie on either side; before (samples of them ahead) and own tell which are the stretch.
    """
    pair = F.struct("sample_idx", F.col(value).alias("v"))
    if not halo:
        rows = df.groupBy(key, F.expr(f"sample_idx div {length}").alias("segment")).agg(F.array_sort(F.collect_list(pair)).alias("s"))
        return rows.select(key, "segment", F.col("s.v").alias("samples"))
    dealt = df.withColumn("segment", F.explode(F.expr(f"sequence(greatest(sample_idx - {halo}, 0) div {length}, (sample_idx + {halo}) div {length})")))
    begin = F.col("segment") * length
    rows = dealt.groupBy(key, "segment").agg(
        F.array_sort(F.collect_list(pair)).alias("s"), F.count_if(F.col("sample_idx") < begin).cast("int").alias("before"), F.count_if(F.col("sample_idx").between(begin, begin + length - 1)).cast("int").alias("own"),
    )
    return rows.where("own > 0").select(key, "segment", F.col("s.v").alias("samples"), "before", "own")


def periodogram(rows: DataFrame, keys: list[str], fs: float) -> DataFrame:
    """keys, freq_idx, value, n: one-sided density of each array without its mean, no taper; freq_hz = freq_idx fs / n."""

    def made(x):
        n = x.shape[1]
        power = np.abs(np.fft.rfft(x - x.mean(1, keepdims=True), axis=1)) ** 2 / (fs * n)
        power[:, 1 : -1 if n % 2 == 0 else None] *= 2
        return power

    sized = rows.withColumn("n", F.size("samples"))
    return _long(_by_row(sized, [*keys, "n"], "samples", made, "spectrum"), [*keys, "n"], "spectrum", F.col("freq_idx") * fs / F.col("n"))


def fft_amplitude(rows: DataFrame, keys: list[str], fs: float, low: float, high: float) -> DataFrame:
    """keys, freq_idx, freq_hz, value: unscaled amplitude of each array's transform at frequencies from ``low`` to ``high``."""
    sized = rows.withColumn("n", F.size("samples"))
    found = _long(_by_row(sized, [*keys, "n"], "samples", lambda x: np.abs(np.fft.rfft(x, axis=1)), "spectrum"), [*keys, "n"], "spectrum", F.col("freq_idx") * fs / F.col("n"))
    return found.where(F.col("freq_hz").between(low, high))


def crop(spectrogram: DataFrame, f_cond=None, t_cond=None) -> DataFrame:
    """Rows under conditions on freq_hz and t_s; None lets all pass."""
    for cond in (f_cond, t_cond):
        spectrogram = spectrogram if cond is None else spectrogram.where(cond)
    return spectrogram


def extent(spectrogram: DataFrame, keys: list[str] | None = None, t: str = "t_s", f: str = "freq_hz") -> DataFrame:
    """t0, t1, f0, f1 (half a step beyond the outermost centres), least, most of a spectrogram."""
    half = lambda c: F.when(F.count_distinct(c) > 1, (F.max(c) - F.min(c)) / (F.count_distinct(c) - 1) / 2).otherwise(0.0)
    return spectrogram.groupBy(*(keys or [])).agg(
        (F.min(t) - half(t)).alias("t0"), (F.max(t) + half(t)).alias("t1"), (F.min(f) - half(f)).alias("f0"), (F.max(f) + half(f)).alias("f1"), F.min("value").alias("least"), F.max("value").alias("most"),
    )


def butterworth_bandpass(low: float, high: float, fs: float, corners: int = 4) -> list[np.ndarray]:
    """Second-order sections (b0 b1 b2 1 a1 a2) of a band-pass from the analogue Butterworth prototype by the bilinear map."""
    warp = lambda f: 2 * fs * np.tan(np.pi * f / fs)
    w1, w2 = warp(low), warp(high)
    proto = np.exp(1j * np.pi * (2 * np.arange(corners) + corners + 1) / (2 * corners))
    half = proto * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2)
    poles = np.concatenate([half + root, half - root])
    z = (2 * fs + poles) / (2 * fs - poles)
    upper = sorted((p for p in z if p.imag > 0), key=lambda p: p.imag)
    sections = [np.array([1, 0, -1, 1, -2 * p.real, abs(p) ** 2]) for p in upper]
    centre = np.exp(2j * np.pi * np.sqrt(low * high) / fs)
    gain = np.prod([(s[0] + s[1] / centre + s[2] / centre**2) / (s[3] + s[4] / centre + s[5] / centre**2) for s in sections])
    sections[0][:3] /= abs(gain)
    return sections


def _filtered(x: np.ndarray, sections: list[np.ndarray], block: int = 256) -> np.ndarray:
    """Each row of ``x`` through the sections from rest, ``block`` samples at a time.

    A section is a linear system with a state of two numbers: a block's output is its input through the impulse response plus what
    its first state fades out to, so only the states go from block to block one after the other.
    """
    rows, n = x.shape
    count = -(-n // block)
    x = np.concatenate([x, np.zeros((rows, count * block - n))], 1).reshape(rows, count, block)
    for b0, b1, b2, _, a1, a2 in sections:
        a, b = np.array([[-a1, 1.0], [-a2, 0.0]]), np.array([b1 - a1 * b0, b2 - a2 * b0])
        fades, reaches = np.empty((block, 2)), np.empty((block, 2))
        row, column = np.array([1.0, 0.0]), b
        for k in range(block):
            fades[k], reaches[block - 1 - k] = row, column
            row, column = row @ a, a @ column
        response = np.r_[b0, reaches[::-1, 0][: block - 1]]
        at = np.arange(block)[:, None] - np.arange(block)[None, :]
        y = x @ np.where(at >= 0, response[np.maximum(at, 0)], 0.0).T
        gained, power = x @ reaches, np.linalg.matrix_power(a, block)
        state = np.zeros((rows, count, 2))
        for k in range(1, count):
            state[:, k] = state[:, k - 1] @ power.T + gained[:, k - 1]
        x = y + state @ fades.T
    return x.reshape(rows, -1)[:, :n]


def settling(low: float, high: float, fs: float, corners: int = 4, tolerance: float = 1e-10) -> int:
    """Samples after which what the band-pass began with has faded to ``tolerance``: by its slowest pole, so by the low corner or a narrow band."""
    slowest = max(float(np.sqrt(s[5])) for s in butterworth_bandpass(low, high, fs, corners))
    return int(np.ceil(np.log(tolerance) / np.log(slowest)))


def bandpass(rows: DataFrame, keys: list[str], low: float, high: float, fs: float, corners: int = 4) -> DataFrame:
    """keys, samples: each array filtered forwards and backwards, so its phase stays.

    An array is a whole trace, or one of ``segments`` with a halo of ``settling`` samples, which is dropped after filtering: the values
    are then those of the whole trace to 1e-8 of its largest sample, whatever the segments' length. Later segments without halo are refused.
    """
    sections = butterworth_bandpass(low, high, fs, corners)
    both = lambda x: _filtered(_filtered(x, sections)[:, ::-1], sections)[:, ::-1]
    halo = ["before", "own"] if {"before", "own"} <= set(rows.columns) else []
    if not halo and "segment" in rows.columns:
        refused = F.raise_error(F.lit("segments of a longer trace need a halo")).cast("array<double>")
        rows = rows.withColumn("samples", F.when(F.col("segment") > 0, refused).otherwise(F.col("samples")))
    found = _by_row(rows, [*keys, *halo], "samples", both, "filtered")
    return found.select(*keys, (F.slice("filtered", F.col("before") + 1, F.col("own")) if halo else F.col("filtered")).alias("samples"))
