"""Operators against numpy on traces whose truth is known."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions import decode, times
from fringeworks.functions import hooks
from fringeworks.functions.hooks import analyse
from fringeworks.operators import bins, events, resample, spectral, stats, sweep, unwrap

SECOND = times.SECOND

DATA = "/root/testdata/sf0.001"


def trace(spark, values, key=1, name="x", kind="double"):
    rows = [(key, k, float(v) if kind == "double" else int(v)) for k, v in enumerate(values)]
    return spark.createDataFrame(rows, f"trace_id long, sample_idx long, {name} {kind}").repartition(3)


def ordered(df, column):
    return np.array([r[column] for r in df.orderBy("sample_idx").collect()])


def test_decoding_fields(spark):
    values = [(i, q, m) for i in (-(2**23), -1, 0, 1, 2**23 - 1) for q in (-(2**23), -1, 0, 1, 2**23 - 1) for m in (-32768, -1, 0, 1, 32767)]
    words = [(m << 48) + ((i & 0xFFFFFF) << 24) + (q & 0xFFFFFF) for i, q, m in values]
    df = spark.createDataFrame([(0, k, w) for k, w in enumerate(words)], "trace_id long, sample_idx long, word long")
    assert [(r.i, r.q, r.m) for r in decode.decode(df).orderBy("sample_idx").collect()] == values


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 17])
def test_unwrap_recovers_a_ramp(spark, block):
    r = np.random.default_rng(3)
    true = np.cumsum(r.integers(-4000, 4001, 700))
    m = (true + 32768) % 65536 - 32768
    iqm = trace(spark, m, name="m", kind="long")
    found = ordered(unwrap.unwrap(iqm, block), "m_unwrapped")
    assert (found - found[0] == true - true[0]).all()
    stored = unwrap.apply_rollovers(iqm, unwrap.rollovers(iqm, block), block)
    assert (ordered(stored, "m_unwrapped") == found).all()
    assert unwrap.suspicious(iqm, block).count() == 0


@pytest.mark.parametrize("block", [16, 1 << 17])
def test_turns_counted_from_a_window(spark, block):
    """A wrap on the window's first sample counts in either anchor; windows of two traces, one without a wrap before it."""
    true = {1: np.cumsum(np.random.default_rng(4).integers(-4000, 4001, 300)), 2: np.arange(200) * 3000}
    rows = [(k, i, int((v + 32768) % 65536 - 32768)) for k, t in true.items() for i, v in enumerate(t)]
    iqm = spark.createDataFrame(rows, "trace_id long, sample_idx long, m long").repartition(3)
    wraps = unwrap.rollovers(iqm, block)
    on_wrap = wraps.where("trace_id = 2 and sample_idx > 60").agg(F.min("sample_idx")).first()[0]
    places = {1: (37, 250), 2: (on_wrap, 180)}
    bounds = spark.createDataFrame([(k, a, b) for k, (a, b) in places.items()], "trace_id long, start_idx long, end_idx long")
    part = times.in_window(iqm, bounds)
    by_hand = {}
    for k, (a, b) in places.items():
        stored = sorted((r.sample_idx, r.delta) for r in wraps.where(F.col("trace_id") == k).collect())
        for i in range(a, b):
            m = int((true[k][i] + 32768) % 65536 - 32768)
            by_hand[k, i] = (m - 65536 * sum(d for at, d in stored if at <= i), m - 65536 * sum(d for at, d in stored if a <= at <= i))
    for n, anchor in enumerate(("trace", "window")):
        for found in (unwrap.unwrap(iqm, block, anchor=anchor, bounds=bounds), unwrap.apply_rollovers(iqm, wraps, block, anchor=anchor, bounds=bounds), unwrap.apply_rollovers(part, wraps, block, anchor=anchor, bounds=bounds)):
            assert {(r.trace_id, r.sample_idx): r.m_unwrapped for r in found.collect()} == {at: v[n] for at, v in by_hand.items()}
    assert any(v[0] != v[1] for v in by_hand.values())
    with pytest.raises(ValueError):
        unwrap.unwrap(iqm, anchor="file")


def test_steps_below_the_threshold_are_told(spark):
    iqm = trace(spark, [0, 30000, -15536, 0], name="m", kind="long")
    assert unwrap.rollovers(iqm, 2).count() == 0
    assert [tuple(r) for r in unwrap.suspicious(iqm, 2).collect()] == [(1, 2, -45536)]


def test_statistics(spark):
    x = np.random.default_rng(1).normal(3, 2, 500)
    df = trace(spark, x)
    s = stats.summary(stats.skip_first(df, 100), ["trace_id"]).first()
    assert np.allclose([s.n, s.mean, s.std_dev, s.min], [400, x[100:].mean(), x[100:].std(), x[100:].min()])
    m = stats.moments(df, ["trace_id"]).first()
    z = (x - x.mean()) / x.std()
    assert np.allclose([m.m3, m.m4, m.m5, m.m6], [(z**k).mean() for k in (3, 4, 5, 6)])
    p = stats.percentiles(df, ["trace_id"]).first()
    assert np.allclose([p.p50, p.p75, p.p90, p.p100], np.percentile(x, [50, 75, 90, 100]))
    odd = np.r_[np.zeros(300), -np.geomspace(1e-9, 1e9, 100), [7.0]]
    several = df.unionByName(trace(spark, odd, 2)).unionByName(trace(spark, [5.0], 3)).unionByName(trace(spark, [1.0, 1.0], 4))
    for r in stats.percentiles(several, ["trace_id"], at=(0.0, 0.1, 0.5, 0.77, 1.0), most=16).collect():
        assert np.allclose(r[1:], np.percentile({1: x, 2: odd, 3: [5.0], 4: [1.0, 1.0]}[r.trace_id], [0, 10, 50, 77, 100]), rtol=1e-12, atol=0)
    assert np.allclose(stats.percentiles(df, []).first(), np.percentile(x, [50, 75, 90, 100]))
    h = {r.bin: r.n for r in stats.histogram(df, ["trace_id"]).collect()}
    width = np.ptp(x) / 100
    expected, _ = np.histogram(x, np.linspace(x.min(), x.max(), 101))
    assert sum(h.values()) == 500 and width > 0 and sum(abs(h.get(k + 1, 0) - n) for k, n in enumerate(expected)) <= 2
    assert not stats.mode_flag(df, ["trace_id"], tolerance=1).first().single_mode


def test_percentiles_of_skewed_values(spark, monkeypatch):
    """Radix selection: an outlier, values that differ in their last bits, extremes; no bin over ``most`` values is ordered."""
    from fringeworks.sources import work

    r = np.random.default_rng(3)
    tiny = 1 + np.arange(2000) * 2.0**-52
    kinds = {"outlier": np.r_[r.normal(size=5000), 1e12], "bits": r.permutation(tiny), "range": np.r_[5e-324, -5e-324, 0.0, -0.0, 1.7e308, -1.7e308, 2.0**-1022, r.normal(size=500) * 10.0 ** r.integers(-300, 300, 500)], "equal": np.full(3000, 0.1), "edges": np.r_[[2.0**k for k in range(-30, 30)], [np.nextafter(2.0**k, 0) for k in range(-30, 30)]], "ends": [-np.inf, 1.0, 2.0, np.inf, np.inf]}
    df = spark.createDataFrame([(k, float(v)) for k, x in kinds.items() for v in x], "k string, x double")
    kept, old = {}, work.stored
    monkeypatch.setattr(work, "stored", lambda df, name: kept.setdefault((name, len(kept)), old(df, name)))
    at = (0.0, 0.1, 0.5, 0.77, 1.0)
    for row in stats.percentiles(df, ["k"], at=at, most=64).collect():
        with np.errstate(invalid="ignore", over="ignore"):
            want = [np.percentile(kinds[row.k], 100 * p, method="linear") for p in at]
        if row.k == "ends":
            assert [row.p0, row.p50, row.p100] == [-np.inf, 2.0, np.inf]
        else:
            assert np.allclose(row[1:], want, rtol=1e-13, atol=0), row.k
    last = list(kept.values())[-1]
    assert last.where("_m > 64 and _several").count() == 0 and "_d4" in last.columns and len(kept) == 6
    kept.clear()
    assert stats.percentiles(df.where("k = 'equal'"), ["k"], most=64).first().p50 == 0.1 and len(kept) == 2  # one value needs no further digit
    few = stats.percentiles(df.where("k = 'outlier'"), ["k"], most=10_000)
    assert np.allclose(few.first()[1:], np.percentile(kinds["outlier"], [50, 75, 90, 100])) and stats.percentiles(df.where("k = 'no'"), ["k"]).collect() == []


@pytest.mark.parametrize("kept", [[], ["a"], ["b"], ["a", "c"], ["a", "b", "c"]])
def test_moments_over_any_axis(spark, kept):
    x = np.random.default_rng(2).random((4, 3, 5)) * 100
    rows = [(a, b, c, float(x[a, b, c])) for a in range(4) for b in range(3) for c in range(5)]
    df = spark.createDataFrame(rows, "a int, b int, c int, x double")
    axes = tuple(k for k, name in enumerate("abc") if name not in kept)
    mean, var = x.mean(axes), x.var(axes)
    for found in (stats.axis_moments(df, kept), stats.merged_moments(stats.axis_moments(df.withColumn("part", (F.col("c") + F.col("b")) % 2), [*kept, "part"]), kept)):
        for r in found.collect():
            at = tuple(r[k] for k in kept)
            assert np.allclose([r["mean"], r["var"]], [mean[at], var[at]])


def test_differing_axes_fail(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [1.0, 2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="kept axis"):
        stats.same_shape(df, ["k"], "v").collect()


@pytest.mark.parametrize("block", [32, 50, 1 << 17])
def test_sliding_windows(spark, block):
    x = np.random.default_rng(4).normal(size=203)
    mirrored = np.r_[x[:16][::-1], x, x[-15:][::-1]]
    moving = np.convolve(mirrored, np.ones(32) / 32, "valid")
    assert np.allclose(ordered(stats.moving_mean(trace(spark, x), block=block), "moving"), moving)
    rms = np.sqrt(np.convolve((x - moving) ** 2, np.ones(32) / 32, "valid"))
    assert np.allclose(ordered(stats.sliding_rms(trace(spark, x), block=block), "rms"), rms)


def test_sorts_of_bounded_parts(spark, monkeypatch):
    """Tasks grow with the rows, so a part to sort doesn't, however well it compresses; a halo reaches over a block shorter than the window."""
    from fringeworks.plans import fixtures as fx
    from fringeworks.sources import work

    monkeypatch.setattr(work, "ROWS_A_TASK", 500)
    rows = spark.range(6000).selectExpr("id div 100 as trace_id", "id % 100 as sample_idx", "sin(id) as x")
    for made in (stats.moving_mean(rows), stats.sliding_rms(rows)):
        assert made.rdd.getNumPartitions() == 12
    assert fx.words(spark, DATA).rdd.getNumPartitions() == -(-fx.table(spark, DATA, "lineitem").count() // 500)
    want, got = (sorted((r.trace_id, r.sample_idx, round(r.rms, 9)) for r in stats.sliding_rms(rows, block=b).collect()) for b in (1 << 17, 20))
    assert want == got and len(got) == 60 * 69


def test_resampling(spark):
    x = np.random.default_rng(5).normal(size=431)
    df = trace(spark, x)
    assert np.allclose(ordered(resample.difference(df, block=64, scale=10.0), "diff"), np.diff(x) * 10)
    means = {r.block_idx: r["mean"] for r in resample.block_average(df, 5).collect()}
    assert np.allclose([means[k] for k in range(87)], [x[5 * k : 5 * k + 5].mean() for k in range(87)])
    assert ordered(resample.settled(df, 1000.0), "sample_idx")[0] == 2
    for q in (2, 5):
        taps = resample.fir_taps(q)
        full = np.convolve(x, taps)[len(taps) // 2 :][: len(x)][::q]
        assert np.allclose(resample.decimated(x, q), full)
        for block in (50, 431, 1 << 17):
            assert np.allclose(ordered(resample.decimate(df, q, block=block), "x"), full)


def test_spectra(spark):
    assert [spectral.nearest_power_of_two(x) for x in (2400, 3, 6, 2048, 1)] == [2048, 2, 4, 2048, 1]
    x = np.random.default_rng(6).normal(size=(3, 64))
    k = 1.5 + np.arange(64) * 48.5 / 64
    direct = x @ np.exp(-2j * np.pi * np.outer(np.arange(64), k) / 128)
    assert np.allclose(spectral.zoom_transform(x, 1.5, 50, 64, 128), direct)
    t = np.arange(64)
    assert np.allclose(spectral.detrended(x, "linear"), [r - np.polyval(np.polyfit(t, r, 1), t) for r in x])
    rows = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "k int, samples array<double>")
    p = {(r.k, r.freq_idx): r.value for r in spectral.periodogram(rows, ["k"], 128.0).collect()}
    assert np.isclose(sum(v for (k, _), v in p.items() if k == 1) * 2, (x[1] - x[1].mean()).var())  # Parseval: density times 2 Hz
    for bad in ({"sides": "twosided"}, {"mode": "phase"}):
        with pytest.raises(ValueError):
            spectral.zoom_spectrogram(rows, ["k"], 1.5, 50, 128, 64, **bad)
    with pytest.raises(ValueError):
        spectral.frames(trace(spark, [1.0]), 8, 0)


def test_labels_and_extent(spark):
    rows = spark.createDataFrame([(1, [0.0] * 2048)], "k int, samples array<double>")
    made = spectral.zoom_spectrogram(rows, ["k"], 1.5, 50.0, 400.0, 2048).where("freq_idx = 600").first()
    assert abs(made.freq_label_hz - 15.715925744992672) < 1e-12 and abs(made.freq_hz - 15.708984375) < 1e-12
    grid = spark.createDataFrame([(float(f), float(t), f * 10.0 + t) for f in range(8) for t in range(6)], "freq_hz double, t_s double, value double")
    cut = spectral.crop(grid, F.col("freq_hz").between(1, 3), F.col("t_s").between(3, 4))
    e = spectral.extent(cut).first()
    assert (cut.count(), e.t0, e.t1, e.f0, e.f1) == (6, 2.5, 4.5, 0.5, 3.5)
    assert spectral.crop(grid).count() == 48


def test_a_sine_peaks_where_it_should(spark):
    fs, f0 = 40.0, 5.0
    df = trace(spark, np.sin(2 * np.pi * f0 * np.arange(400) / fs))
    windows = spectral.frames(df, 64, 16)
    assert windows.count() == (400 - 64) // 16 + 1
    peak = spectral.zoom_spectrogram(windows, ["trace_id", "win_idx"], 1.0, 10.0, fs, 64, True).groupBy("win_idx").agg(F.max_by("freq_hz", "value").alias("f"))
    assert all(abs(r.f - f0) < 0.2 for r in peak.collect())
    full = spectral.full_spectrogram(df, fs, 1.6).groupBy("win_idx").agg(F.max_by("freq_hz", "value").alias("f"))
    assert all(abs(r.f - f0) < 0.7 for r in full.collect())
    both = np.sin(2 * np.pi * f0 * np.arange(400) / fs) + np.sin(2 * np.pi * 0.05 * np.arange(400) / fs)
    out = spectral.bandpass(spectral.segments(trace(spark, both)), ["trace_id", "segment"], 2.0, 10.0, fs).first().samples
    assert np.allclose(out[100:300], np.sin(2 * np.pi * f0 * np.arange(400) / fs)[100:300], atol=0.05)


@pytest.mark.parametrize(("low", "high", "length"), [(2.0, 10.0, 1000), (2.0, 10.0, 37), (0.5, 15.0, 400), (4.8, 5.2, 900)])
def test_bandpass_is_the_same_in_any_segments(spark, low, high, length):
    fs, x = 40.0, np.random.default_rng(3).normal(100, 5, 2500)
    df, halo = trace(spark, x), spectral.settling(low, high, fs)
    whole = np.array(spectral.bandpass(spectral.segments(df), ["trace_id", "segment"], low, high, fs).first().samples)
    cut = spectral.bandpass(spectral.segments(df, length=length, halo=halo), ["trace_id", "segment"], low, high, fs).orderBy("segment").collect()
    assert [r.segment for r in cut] == list(range(-(-2500 // length)))
    assert np.abs(np.concatenate([r.samples for r in cut]) - whole).max() < 1e-8 * np.abs(x).max()


def test_filter_against_a_loop():
    sections, x = spectral.butterworth_bandpass(0.5, 15.0, 40.0), np.random.default_rng(5).normal(size=(3, 700))
    want = x.copy()
    for b0, b1, b2, _, a1, a2 in sections:
        for row in want:
            s1 = s2 = 0.0
            for k, v in enumerate(row.tolist()):
                row[k] = b0 * v + s1
                s1, s2 = b1 * v - a1 * row[k] + s2, b2 * v - a2 * row[k]
    for block in (1, 7, 256, 1000):
        assert np.allclose(spectral._filtered(x, sections, block), want)


@pytest.mark.parametrize("block", [20, 100, 1 << 17])
@pytest.mark.parametrize(("nfft", "hop"), [(64, 7), (64, 64), (16, 1)])
def test_frames_in_any_blocks(spark, block, nfft, hop):
    x = np.random.default_rng(7).normal(size=331)
    df = trace(spark, x).unionByName(trace(spark, x[: nfft - 1], 2)).unionByName(trace(spark, x[:nfft], 3))
    found = {(r.trace_id, r.win_idx): r.samples for r in spectral.frames(df, nfft, hop, block=block).collect()}
    want = {(1, k): x[k * hop : k * hop + nfft] for k in range((331 - nfft) // hop + 1)} | {(3, 0): x[:nfft]}
    assert found.keys() == want.keys() and all(np.array_equal(found[k], want[k]) for k in want)


def test_bandpass_refuses_segments_without_halo(spark):
    with pytest.raises(Exception, match="need a halo"):
        spectral.bandpass(spectral.segments(trace(spark, np.zeros(20)), length=10), ["trace_id", "segment"], 2.0, 10.0, 40.0).collect()


def test_events(spark):
    x = np.r_[np.zeros(20), np.ones(5) * 5, np.zeros(20)] + 0.1
    ratio = ordered(events.sta_lta(trace(spark, x), 3, 10), "ratio")
    e = x**2
    expected = [0 if k < 9 else e[k - 2 : k + 1].mean() / e[k - 9 : k + 1].mean() for k in range(len(x))]
    assert np.allclose(ratio, expected)
    assert np.allclose(ordered(events.sta_lta(trace(spark, x), 3, 10, block=10), "ratio"), expected)
    onset = next(k for k, v in enumerate(expected) if v > 2)
    found = {block: sorted((r.onset, r.end) for r in events.triggers(trace(spark, expected), 2.0, 1.0, value="x", block=block).collect()) for block in (2, 7, 1000)}
    assert found[2] == found[7] == found[1000] and found[2][0][0] == onset
    rows = spark.createDataFrame([(0.0, 1.0), (2.5, 3.0), (10.0, 11.0)], "begin double, end double").withColumn("k", F.lit(1))
    assert sorted((r.begin, r.end, r.n) for r in events.merge_events(rows, 2.0, ["k"]).collect()) == [(0.0, 3.0, 2), (10.0, 11.0, 1)]
    other = spark.createDataFrame([(0.5, 4.0, 1), (9.5, 11.5, 1), (100.0, 101.0, 1), (-200.0, 300.0, 1)], "begin double, end double, k int")
    pairs = events.coincidences(rows, other, ["k"], 0.1, 2.0)
    assert sorted((r.begin, r.end) for r in pairs.collect()) == [(0.0, 1.0), (0.5, 1.0), (2.5, 3.0), (2.5, 3.0), (10.0, 11.0), (10.0, 11.0)]


TRACE = (1_705_595_676 * SECOND, 2 * 3600)  # start, seconds at 40 kHz
HOUR, MINUTE = 3600 * SECOND, 60 * SECOND


@pytest.mark.parametrize(
    ("given", "seconds"),
    [
        ({}, (0, 7200)),
        ({"start": TRACE[0] + 10 * MINUTE, "duration": HOUR}, (600, 3600)),
        ({"start": TRACE[0] - 15 * MINUTE, "duration": HOUR}, (0, 2700)),
        ({"start": TRACE[0] - 2 * HOUR, "duration": HOUR}, (0, 0)),
        ({"start": TRACE[0] + 3 * HOUR, "duration": HOUR}, (7200, 0)),
        ({"start": TRACE[0] + HOUR, "end": TRACE[0] + 5 * HOUR}, (3600, 3600)),
        ({"start": TRACE[0] + 3 * HOUR}, (7200, 0)),
        ({"start": TRACE[0] + HOUR}, (3600, 3600)),
        ({"end": TRACE[0] + HOUR}, (0, 3600)),
        ({"end": TRACE[0] - HOUR}, (0, 0)),
        ({"start": HOUR, "end": 90 * MINUTE, "relative": True}, (3600, 1800)),
    ],
)
def test_time_windows(spark, given, seconds):
    catalog = spark.createDataFrame([(1, TRACE[0], TRACE[0] + TRACE[1] * SECOND, 25_000)], "trace_id long, start_ns long, end_ns long, interval_ns long")
    r = times.window_bounds(catalog, **given).first()
    assert (r.start_idx, r.end_idx) == (seconds[0] * 40_000, sum(seconds) * 40_000)


def test_time_windows_in_turn(spark):
    catalog = spark.createDataFrame([(1, 0, 100 * SECOND, SECOND)], "trace_id long, start_ns long, end_ns long, interval_ns long")
    first = times.window_bounds(catalog, start=10 * SECOND, end=20 * SECOND)
    later, sooner = times.window_bounds(first, start=50 * SECOND).first(), times.window_bounds(first, end=5 * SECOND).first()
    assert (later.start_idx, later.end_idx, sooner.start_idx, sooner.end_idx) == (50, 50, 5, 5)
    for bad in ({"start": 1, "duration": 1, "end": 2}, {"start": 1, "duration": -1}, {"duration": 1}, {"start": 2, "end": 1}):
        with pytest.raises(ValueError):
            times.window_bounds(catalog, **bad)


def test_bins_and_batches(spark):
    minute = 15 * MINUTE
    catalog = spark.createDataFrame([("a", 0, 40 * MINUTE, 25_000), ("b", 40 * MINUTE, 50 * MINUTE, 25_000), ("c", 46 * MINUTE, 47 * MINUTE, 25_000)], "trace_id string, start_ns long, end_ns long, interval_ns long")
    found = sorted((r.bin_start_ns // minute, r.trace_id) for r in bins.bin_files(catalog, 0, HOUR, minute).collect())
    assert found == [(0, "a"), (1, "a"), (2, "a"), (2, "b"), (3, "b")]
    inside = sorted((r.bin_start_ns // minute, r.trace_id, r.position) for r in bins.bin_files(catalog, 0, HOUR, minute, "overlap").collect())
    assert inside == [(0, "a", 1), (1, "a", 1), (2, "a", 1), (2, "b", 2), (3, "b", 1), (3, "c", 2)]
    plan = bins.batches(bins.bin_files(catalog, 0, HOUR, minute, "overlap"), catalog, minute).where(F.col("bin_start_ns") == minute).orderBy("batch").collect()
    assert len(plan) == 8
    assert [(r.start_idx, r.end_idx) for r in plan[:2]] == [(900 * 40_000, 1020 * 40_000), (int(1014.6 * 40_000), int(1134.6 * 40_000))]
    left = bins.bins_left(bins.time_bins(spark, 0, 4, 1), spark.createDataFrame([(1,), (3,)], "bin_start_ns long"))
    assert sorted(r[0] for r in left.collect()) == [0, 2]


def test_averaged_spectrum(spark):
    fs, n = 40, 600
    x = np.sin(2 * np.pi * 5 * np.arange(n) / fs) + 0.01 * np.random.default_rng(1).normal(size=n)
    catalog = spark.createDataFrame([(1, 0, n * SECOND // fs, SECOND // fs)], "trace_id long, start_ns long, end_ns long, interval_ns long")
    plan = bins.batches(bins.bin_files(catalog, 0, 15 * SECOND, 15 * SECOND, "overlap"), catalog, 15 * SECOND, 6 * SECOND, 2 * SECOND)
    found = bins.averaged_spectrum(bins.decimated_batches(trace(spark, x), plan, (2,), block=64, cell=32), 2.0, 0.9, 1.5, 9.0, least_s=2.0)
    assert abs(found.agg(F.max_by("freq_hz", "mean_db")).first()[0] - 5) < 0.3
    assert found.agg(F.count_distinct("n_windows")).first()[0] == 1


def test_cascade_in_pieces():
    """The outputs of a whole batch, whatever part of it is asked for: zeros beyond each step's ends."""
    r = np.random.default_rng(7)
    for factors in ((2,), (2, 2, 5, 5), (5, 3)):
        for n in (1, 7, 100, 2600, 5001):
            x = r.normal(size=n) + 3
            whole = x
            for q in factors:
                whole = resample.decimated(whole, q)
            for step in (1, 3, len(whole)) if n < 200 else (7, 26, len(whole)):
                for first in range(0, len(whole), step):
                    last = min(first + step, len(whole))
                    low, high, _ = bins._needed(first, last, n, factors)[0]
                    reach, down = bins._halo(factors), int(np.prod(factors))
                    assert low >= first * down - reach and high <= (last - 1) * down + reach + 1
                    assert np.allclose(bins.cascaded(x[low:high], low, first, last, n, factors), whole[first:last], atol=1e-12)


@pytest.mark.parametrize(("block", "cell", "windows"), [(100, 64, 150), (700, 1000, 40), (1 << 17, 1 << 16, 1 << 17)])
def test_batches_are_the_same_for_any_block(spark, block, cell, windows):
    fs, n, factors = 400, 9000, (2, 5)
    r = np.random.default_rng(2)
    x = np.sin(2 * np.pi * 5 * np.arange(n) / fs) + r.normal(size=n)
    catalog = spark.createDataFrame([(1, 0, n * SECOND // fs, SECOND // fs)], "trace_id long, start_ns long, end_ns long, interval_ns long")
    plan = bins.batches(bins.bin_files(catalog, 0, 15 * SECOND, 15 * SECOND, "overlap"), catalog, 15 * SECOND, 6 * SECOND, 2 * SECOND)
    pieces = bins.decimated_batches(trace(spark, x), plan, factors, block=block, cell=cell)
    found = {(r.bin_start_ns, r.freq_idx): r for r in bins.averaged_spectrum(pieces, 2.0, 0.9, 1.5, 9.0, 2.0, windows).collect()}
    db = {}
    for p in plan.collect():
        y = x[p.start_idx : p.end_idx]
        for q in factors:
            y = resample.decimated(y, q)
        nfft = spectral.nearest_power_of_two(2.0 * 40)
        if len(y) >= max(nfft, 80):
            w = np.lib.stride_tricks.sliding_window_view(y, nfft)[:: nfft - int(nfft * 0.9)]
            db.setdefault(p.bin_start_ns, []).append(10 * np.log10(spectral.zoom_density(w, 1.5, 9.0, 40.0, "linear")))
    assert len(found) == sum(x[0].shape[1] for x in db.values())
    for b, own in db.items():
        own = np.concatenate(own)
        for k in range(own.shape[1]):
            assert np.allclose([found[b, k].n_windows, found[b, k].mean_db, found[b, k].std_db], [len(own), own[:, k].mean(), own[:, k].std()], atol=1e-8)


def test_sweeps_and_hooks(spark):
    grid = sweep.sweep_axis(spark, 5, 3, 0.2, 10.0)
    vpp = [r.vpp for r in grid.where("j = 0").orderBy("i").collect()]
    assert np.allclose(vpp, np.sqrt(np.linspace(0.04, 100, 5)))
    done = grid.where("i < 2 or (i = 2 and j = 1)")
    assert [(r.i, r.j) for r in sweep.sweep_left(grid, done).collect()][:2] == [(2, 0), (2, 2)]
    merged = sweep.upserted(done.withColumn("vpp", F.lit(0.0)), grid, ["i", "j"])
    assert merged.count() == 15 and merged.where("vpp = 0").count() == done.count()
    out = analyse(trace(spark, [1, 2, 3]), lambda t: t.select(["trace_id", "x"]).slice(0, 1), "trace_id long, x double")
    assert out.count() == 1


@pytest.mark.parametrize(("block", "fan"), [(7, 2), (64, 3), (1000, 256)])
def test_reductions_by_blocks(spark, block, fan):
    x = np.random.default_rng(9).gamma(2.0, size=333) * 5 + 100
    df = trace(spark, x).unionByName(trace(spark, [4.0, 4.0], 2)).repartition(5)
    found = {r.trace_id: r for r in hooks.reduce_traces(df, hooks.moments_hook(), block=block, fan=fan).collect()}
    z = (x - x.mean()) / x.std()
    assert np.allclose(found[1][1:], [333, x.mean(), x.std(), *((z**k).mean() for k in (3, 4, 5, 6))]) and found[2].m3 is None and found[2].n == 2
    ranged = df.join(hooks.reduce_traces(df, hooks.range_hook(), block=block, fan=fan), "trace_id")
    counts = {r.trace_id: r.counts for r in hooks.reduce_traces(ranged, hooks.histogram_hook(20), block=block, fan=fan).collect()}
    assert counts[1] == np.histogram(x, 20)[0].tolist() and sum(counts[2]) == 2
    # states merge in order, in whatever groups
    order = hooks.Reduction(lambda: [], lambda s, t: s + t.column("sample_idx").to_pylist(), lambda a, b: a + b, lambda s: {"ok": s == sorted(s), "n": len(s)}, "ok boolean, n long")
    assert sorted((r.trace_id, r.ok, r.n) for r in hooks.reduce_traces(df, order, block=block, fan=fan).collect()) == [(1, True, 333), (2, True, 2)]


@pytest.mark.parametrize("width", [0.5, 10.0, 1e6])
def test_events_merge_over_buckets(spark, width):
    r = np.random.default_rng(5)
    rows = [(k, float(b), float(b + abs(e))) for k, n in (("a", 400), ("b", 3), ("c", 1)) for b, e in zip(np.cumsum(r.exponential(3, n)), r.normal(0, 4, n))] + [("a", 5.0, 5.0), ("a", 5.0, 90.0)]
    want = []
    for key in "abc":
        own, groups = sorted(x[1:] for x in rows if x[0] == key), []
        for k, (b, e) in enumerate(own):
            if k and b <= own[k - 1][1] + 2.0:
                groups[-1].append((b, e))
            else:
                groups.append([(b, e)])
        want += [(key, g[0][0], g[-1][1], len(g)) for g in groups]
    found = events.merge_events(spark.createDataFrame(rows, "k string, begin double, end double"), 2.0, ["k"], width)
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_local_time(spark):
    df = spark.sql("select timestamp_ntz'2024-01-19 00:34:36' as ts")
    r = df.select(times.local_time(F.col("ts"), "Asia/Singapore").alias("l")).select("l", times.instant(F.col("l"), "Asia/Singapore").alias("u"), times.second_of_day(F.col("l")).alias("s")).first()
    assert (str(r.l), str(r.u), r.s) == ("2024-01-19 08:34:36", "2024-01-19 00:34:36", 8 * 3600 + 34 * 60 + 36)
