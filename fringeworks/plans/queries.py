"""One query per operator of the trace engine, each over whole tables, and the DuckDB SQL that must agree."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.functions import decode, hooks, times
from fringeworks.operators import bins, events, resample, spectral, stats, sweep, transform, unwrap
from fringeworks.plans import fixtures as fx
from fringeworks.sources import catalog as catalogs
from fringeworks.sources.work import stored, work_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
SECOND = times.SECOND
#: Parameters of the queries: samples dropped, tolerance of a single mode, rate of signals, frames' rate and band, rate of words.
DROP, TOLERANCE, FS, F1, F2, NFFT, WORD_FS = 100, 4000, 40.0, 1.5, 50.0, 64, 2000.0


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


_W = fx.WORDS.format(lineitem="lineitem")
_DECODED = f"""with w as ({_W}),
d as (select trace_id, sample_idx, m_true, word >> 48 as m, ((((word >> 24) & 16777215) + 8388608) & 16777215) - 8388608 as i, (((word & 16777215) + 8388608) & 16777215) - 8388608 as q from w),
s as (select *, m - lag(m) over (partition by trace_id order by sample_idx) as step from d),
u as (select *, cast(m - 65536 * sum(case when step > 61440 then 1 when step < -61440 then -1 else 0 end) over (partition by trace_id order by sample_idx) as bigint) as mu from s),
p as (select *, -atan2(i, q) / (2 * pi()) - mu as cycles, sqrt(cast(i as double) * i + cast(q as double) * q) as radius from u)
"""
_SIGNAL = f"with g as ({fx.SIGNAL.format(events='events')})"
_BLOCKS = "with f as (select vec_id, label, unnest(range(0, 64)) as n, cast(unnest(embedding) as double) as x from embeddings)"
_CATALOG = "with c as (select o_orderkey as trace_id, epoch_us(o_orderdate) * 1000 as start_ns, epoch_us(o_orderdate) * 1000 + cast(round(o_totalprice * 1000) as bigint) * 1000000 as end_ns, 1000000000 as interval_ns from orders)"


def _iqm(spark, d):
    return decode.decode(fx.words(spark, d))


def _samples(spark, d):
    """trace_id, sample_idx, cycles, radius of the unwrapped words."""
    rows = unwrap.unwrap(_iqm(spark, d))
    return rows.select("trace_id", "sample_idx", decode.cycles(turns="m_unwrapped").alias("cycles"), decode.radius().alias("radius"))


# --- words, counters, phase


@query(_DECODED + "select trace_id, sample_idx, cast(i as int) as i, cast(q as int) as q, m from d")
def decode_iqm(spark, d):
    return _iqm(spark, d).select("trace_id", "sample_idx", "i", "q", "m")


@query(_DECODED + "select trace_id, sample_idx, cast(case when step > 0 then 1 else -1 end as smallint) as delta from s where abs(step) > 61440")
def rollovers(spark, d):
    return unwrap.rollovers(_iqm(spark, d))


@query(_DECODED + "select trace_id, sample_idx, m_true, mu as m_unwrapped, mu as m_from_rollovers from u", "unwrap")
def unwrap_turns(spark, d):
    """By the wraps themselves, and from a stored table of them."""
    iqm = stored(_iqm(spark, d).select("trace_id", "sample_idx", "m_true", "m"), "counters")
    wraps = stored(unwrap.rollovers(iqm), "wraps")
    found = unwrap.apply_rollovers(unwrap.unwrap(iqm).withColumnRenamed("m_unwrapped", "_by_wraps"), wraps)
    return found.select("trace_id", "sample_idx", "m_true", F.col("_by_wraps").alias("m_unwrapped"), F.col("m_unwrapped").alias("m_from_rollovers"))


@query(_DECODED + """, c as (select trace_id, count(*) as n from u group by trace_id), v as (select u.*, sum(case when step > 61440 then 1 when step < -61440 then -1 else 0 end) over (partition by u.trace_id order by sample_idx) as turns from u),
w0 as (select v.*, n // 3 as a, 2 * n // 3 as b from v join c using (trace_id)), base as (select trace_id, max(case when sample_idx = a - 1 then turns else -1000000 end) as before from w0 group by trace_id)
select trace_id, sample_idx, mu as by_trace, cast(mu + 65536 * before as bigint) as by_window from w0 join base using (trace_id) where sample_idx >= a and sample_idx < b""")
def unwrap_window(spark, d):
    """The middle third of each trace, its turns counted from the trace's first sample and from the window's, by stored wraps."""
    iqm = stored(_iqm(spark, d).select("trace_id", "sample_idx", "m"), "counters")
    bounds = stored(iqm.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).select("trace_id", F.expr("n div 3").alias("start_idx"), F.expr("2 * n div 3").alias("end_idx")), "bounds")
    wraps = stored(unwrap.rollovers(iqm), "wraps")
    part = times.in_window(iqm.select("trace_id", "sample_idx", "m"), bounds)
    by_trace = unwrap.apply_rollovers(part, wraps, bounds=bounds).withColumnRenamed("m_unwrapped", "by_trace")
    both = unwrap.apply_rollovers(by_trace, wraps, anchor="window", bounds=bounds)
    return both.select("trace_id", "sample_idx", "by_trace", F.col("m_unwrapped").alias("by_window"))


@query(_DECODED + f"select trace_id, sample_idx, sample_idx / {FS} as t_s, round(cycles, 6) as cycles, round(cycles * 1.55 / 1.5, 5) as microns from p")
def reduced_phase(spark, d):
    microns = F.round(decode.microns_in_fibre(F.col("cycles")), 5).alias("microns")
    return _samples(spark, d).select("trace_id", "sample_idx", (F.col("sample_idx") / FS).alias("t_s"), F.round("cycles", 6).alias("cycles"), microns)


@query(_DECODED + "select trace_id, sample_idx, round(radius, 2) as radius from p")
def radius(spark, d):
    return _iqm(spark, d).select("trace_id", "sample_idx", F.round(decode.radius(), 2).alias("radius"))


@query(_DECODED + ", t as (select trace_id, sample_idx // 12 as sample_idx, m from d where sample_idx % 12 = 0) select trace_id, sample_idx, m - lag(m) over (partition by trace_id order by sample_idx) as step from t qualify abs(step) > 32768 and abs(step) <= 61440")
def suspicious_steps(spark, d):
    """Every twelfth word: the counter goes 36000 up or 29536 down, both under the threshold of a wrap."""
    thin = _iqm(spark, d).where("sample_idx % 12 = 0").withColumn("sample_idx", F.expr("sample_idx div 12"))
    return unwrap.suspicious(thin)


# --- statistics

_KEEP = f"from p where sample_idx >= {DROP} group by trace_id"


@query(_DECODED + f"select trace_id, count(*) as n, round(avg(radius), 3) as mean, round(stddev_pop(radius), 3) as std_dev, round(min(radius), 3) as min {_KEEP}")
def radius_stats(spark, d):
    found = stats.summary(stats.skip_first(_iqm(spark, d), DROP).withColumn("x", decode.radius()), ["trace_id"])
    return found.select("trace_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "std_dev", "min")])


@query(_DECODED + f"select trace_id, round(avg(cycles), 4) as mean, round(stddev_pop(cycles), 4) as std_dev {_KEEP}")
def phase_stats(spark, d):
    found = stats.summary(stats.skip_first(_samples(spark, d), DROP), ["trace_id"], "cycles")
    return found.select("trace_id", F.round("mean", 4).alias("mean"), F.round("std_dev", 4).alias("std_dev"))


_Z = _DECODED + ", z as (select trace_id, (radius - avg(radius) over (partition by trace_id)) / stddev_pop(radius) over (partition by trace_id) as z from p) select trace_id, "


@query(_Z + ", ".join(f"round(avg(pow(z, {k})), 6) as m{k}" for k in (3, 4, 5, 6)) + " from z group by trace_id")
def radius_moments(spark, d):
    found = stats.moments(_iqm(spark, d).withColumn("x", decode.radius()), ["trace_id"])
    return found.select("trace_id", *[F.round(f"m{k}", 6).alias(f"m{k}") for k in (3, 4, 5, 6)])


@query(_DECODED + "select trace_id, " + ", ".join(f"round(quantile_cont(cycles, {p}), 4) as p{round(100 * p)}" for p in (0.5, 0.75, 0.9, 1.0)) + " from p group by trace_id")
def phase_percentiles(spark, d):
    found = stats.percentiles(_samples(spark, d), ["trace_id"], "cycles")
    return found.select("trace_id", *[F.round(f"p{p}", 4).alias(f"p{p}") for p in (50, 75, 90, 100)])


@query(_DECODED + f"select trace_id, round(max(cycles) - min(cycles), 4) as span, max(cycles) - min(cycles) <= {TOLERANCE} as single_mode from p group by trace_id")
def mode_flag(spark, d):
    return stats.mode_flag(_samples(spark, d), ["trace_id"], "cycles", TOLERANCE).withColumn("span", F.round("span", 4))


@query(_DECODED + """, e as (select trace_id, min(radius) as lo, (max(radius) - min(radius)) / 100 as w from p group by trace_id)
select trace_id, cast(case when w = 0 then 1 else least(floor((radius - lo) / w) + 1, 100) end as int) as bin, round(lo + (bin - 1) * w, 2) as low, count(*) as n from p join e using (trace_id) group by trace_id, bin, lo, w""")
def radius_hist(spark, d):
    return stats.histogram(_iqm(spark, d).withColumn("x", decode.radius()), ["trace_id"]).withColumn("low", F.round("low", 2))


@query(_BLOCKS + " select label, n, count(*) as count, round(avg(x), 9) as mean, round(var_pop(x), 9) as var from f group by label, n")
def welford_axis(spark, d):
    """Over vectors, label and position kept: directly, and merged from parts of 16 vectors."""
    parts = stats.axis_moments(fx.blocks(spark, d).withColumn("part", F.col("vec_id") % 16).withColumnRenamed("n", "at"), ["label", "at", "part"])
    merged = stats.merged_moments(parts, ["label", "at"])
    return merged.select("label", F.col("at").alias("n"), F.col("n").alias("count"), F.round("mean", 9).alias("mean"), F.round("var", 9).alias("var"))


_MOVING = _SIGNAL + """, k as (select trace_id, count(*) as c from g group by trace_id),
e as (select trace_id, sample_idx, x, c, true as own from g join k using (trace_id) union all select trace_id, -sample_idx - 1, x, c, false from g join k using (trace_id) where sample_idx < 16
      union all select trace_id, 2 * c - 1 - sample_idx, x, c, false from g join k using (trace_id) where sample_idx >= c - 15),
m as (select *, avg(x) over (partition by trace_id order by sample_idx rows between 16 preceding and 15 following) as moving from e),
r as (select trace_id, sample_idx, c, sqrt(avg((x - moving) * (x - moving)) over (partition by trace_id order by sample_idx rows between 16 preceding and 15 following)) as rms from m where own)
select trace_id, sample_idx, round(rms, 6) as rms from r where sample_idx >= 16 and sample_idx < c - 15"""


@query(_MOVING)
def sliding_rms(spark, d):
    return stats.sliding_rms(fx.signal(spark, d)).withColumn("rms", F.round("rms", 6))


# --- along a trace


@query(_DECODED + f", v as (select trace_id, sample_idx, round((lead(cycles) over (partition by trace_id order by sample_idx) - cycles) * {WORD_FS} * 1550e-9, 6) as metres_per_s from p) select * from v where metres_per_s is not null and sample_idx >= 5")
def velocity(spark, d):
    """Without the samples of the first 3 ms at 2 kHz."""
    found = resample.difference(resample.settled(_samples(spark, d), WORD_FS), value="cycles", scale=WORD_FS)
    return found.select("trace_id", "sample_idx", F.round(decode.metres(F.col("diff")), 6).alias("metres_per_s"))


@query(_SIGNAL + " select trace_id, sample_idx // 5 as block_idx, round(avg(x), 6) as mean from g group by trace_id, sample_idx // 5")
def block_avg(spark, d):
    return resample.block_average(fx.signal(spark, d), 5).withColumn("mean", F.round("mean", 6))


@query(_SIGNAL + """, t0 as (select k, case when k = 20 then 0.5 else sin(pi() * (k - 20) / 2.0) / (pi() * (k - 20) / 2.0) / 2 end * (0.54 - 0.46 * cos(2 * pi() * k / 40.0)) as h from (select unnest(range(0, 41)) as k) a),
t as (select k - 20 as k, h / (select sum(h) from t0) as h from t0), sizes as (select trace_id, max(sample_idx) + 1 as n from g group by trace_id),
o as (select trace_id, unnest(range(0, (n + 1) // 2)) as j from sizes)
select o.trace_id, o.j as sample_idx, round(sum(g.x * t.h), 6) as x from o join t on true join g on g.trace_id = o.trace_id and g.sample_idx = 2 * o.j + t.k group by o.trace_id, o.j""")
def decimate(spark, d):
    return resample.decimate(fx.signal(spark, d), 2).withColumn("x", F.round("x", 6))


@query(_SIGNAL + """, k as (select trace_id, count(*) as c from g group by trace_id having count(*) >= 64), w as (select trace_id, unnest(range(0, (c - 64) // 7 + 1)) as win_idx from k)
select w.trace_id, w.win_idx, round((32 + w.win_idx * 7) / 40.0, 6) as t_s, round(sum(g.x * (0.5 - 0.5 * cos(2 * pi() * (g.sample_idx - w.win_idx * 7) / 63.0))), 6) as tapered
from w join g on g.trace_id = w.trace_id and g.sample_idx between w.win_idx * 7 and w.win_idx * 7 + 63 group by w.trace_id, w.win_idx""")
def frames(spark, d):
    """The Hann-weighted sum of each window of 64 samples, 7 apart."""
    made = spectral.frames(fx.signal(spark, d), NFFT, 7)
    weights = F.array(*[F.lit(float(w)) for w in spectral.taper("hann", NFFT)])
    total = F.aggregate(F.zip_with("samples", weights, lambda x, w: x * w), F.lit(0.0), lambda a, x: a + x)
    return made.select("trace_id", "win_idx", F.round(spectral.centre_time(NFFT, 7, FS), 6).alias("t_s"), F.round(total, 6).alias("tapered"))


@query(_BLOCKS + ", l as (select vec_id, regr_slope(x, n) as a, regr_intercept(x, n) as b from f group by vec_id) select vec_id, n, round(x - a * n - b, 6) as x from f join l using (vec_id)")
def detrend(spark, d):
    """Least-squares lines of frames by grouped regression sums."""
    rows = fx.blocks(spark, d)
    lines = rows.groupBy("vec_id").agg(F.regr_slope("x", "n").alias("a"), F.regr_intercept("x", "n").alias("b"))
    return rows.join(lines, "vec_id").select("vec_id", "n", F.round(F.col("x") - F.col("a") * F.col("n") - F.col("b"), 6).alias("x"))


_ZOOM = _BLOCKS + f""", m as (select vec_id, n, x - avg(x) over (partition by vec_id) as x0, (0.5 - 0.5 * cos(2 * pi() * n / 63.0)) as w from f), k as (select unnest(range(0, {NFFT})) as k),
z as (select vec_id, k, sum(x0 * w * cos(2 * pi() * ({F1} + k * {F2 - F1} / {NFFT}) * n / 128.0)) as re, sum(x0 * w * sin(2 * pi() * ({F1} + k * {F2 - F1} / {NFFT}) * n / 128.0)) as im, sum(w * w) as s from m, k group by vec_id, k),
psd as (select vec_id, cast(k as int) as freq_idx, {F1} + k * {F2 - F1} / {NFFT} as freq_hz, {F1} + k * {F2 - F1} / {NFFT - 1} as freq_label_hz, (re * re + im * im) / 128.0 / s * case when k in (0, {NFFT - 1}) then 1 else 2 end as value from z)
"""


def _zoom(spark, d, amplitude=False):
    return spectral.zoom_spectrogram(fx.vectors(spark, d), ["vec_id"], F1, F2, 128.0, NFFT, amplitude, "mean")


@query(_ZOOM + "select vec_id, freq_idx, round(freq_hz, 6) as freq_hz, round(freq_label_hz, 6) as freq_label_hz, round(value, 9) as value from psd")
def cz_psd(spark, d):
    return _zoom(spark, d).select("vec_id", "freq_idx", F.round("freq_hz", 6).alias("freq_hz"), F.round("freq_label_hz", 6).alias("freq_label_hz"), F.round("value", 9).alias("value"))


@query(_ZOOM + "select vec_id, freq_idx, round(sqrt(value), 7) as value from psd")
def cz_asd(spark, d):
    return _zoom(spark, d, True).select("vec_id", "freq_idx", F.round("value", 7).alias("value"))


@query(_ZOOM + "select vec_id, freq_idx, round(value, 9) as value from psd where freq_hz between 10 and 20 and vec_id / 4.0 < 25")
def spectro_crop(spark, d):
    made = _zoom(spark, d).withColumn("t_s", F.col("vec_id") / 4)
    return spectral.crop(made, F.col("freq_hz").between(10, 20), F.col("t_s") < 25).select("vec_id", "freq_idx", F.round("value", 9).alias("value"))


@query(_ZOOM + """select round(min(vec_id) / 4.0 - h, 6) as t0, round(max(vec_id) / 4.0 + h, 6) as t1, round(min(freq_hz) - g, 6) as f0, round(max(freq_hz) + g, 6) as f1, round(min(value), 9) as least, round(max(value), 9) as most
from psd, (select (max(vec_id) - min(vec_id)) / 4.0 / (count(distinct vec_id) - 1) / 2 as h, (max(freq_hz) - min(freq_hz)) / (count(distinct freq_idx) - 1) / 2 as g from psd) x group by h, g""")
def spectro_extent(spark, d):
    made = spectral.extent(_zoom(spark, d).withColumn("t_s", F.col("vec_id") / 4))
    return made.select(*[F.round(c, 9 if c in ("least", "most") else 6).alias(c) for c in made.columns])


_DFT = ", k as (select unnest(range(0, 33)) as k), z as (select vec_id, k, sum({x} * cos(2 * pi() * k * n / 64.0)) as re, sum({x} * sin(2 * pi() * k * n / 64.0)) as im from m, k group by vec_id, k) "


@query(_BLOCKS + ", m as (select vec_id, n, x - avg(x) over (partition by vec_id) as x0 from f)" + _DFT.format(x="x0") + "select vec_id, cast(k as int) as freq_idx, k * 128.0 / 64 as freq_hz, round((re * re + im * im) / (128.0 * 64) * case when k in (0, 32) then 1 else 2 end, 9) as value from z")
def periodogram(spark, d):
    return spectral.periodogram(fx.vectors(spark, d), ["vec_id"], 128.0).select("vec_id", "freq_idx", "freq_hz", F.round("value", 9).alias("value"))


@query(_BLOCKS + ", m as (select vec_id, n, x from f)" + _DFT.format(x="x") + "select vec_id, cast(k as int) as freq_idx, k * 128.0 / 64 as freq_hz, round(sqrt(re * re + im * im), 7) as value from z where k * 2 between 3 and 50")
def fft_amplitude(spark, d):
    return spectral.fft_amplitude(fx.vectors(spark, d), ["vec_id"], 128.0, 3.0, 50.0).select("vec_id", "freq_idx", "freq_hz", F.round("value", 7).alias("value"))


_LONG_WINDOWS = _SIGNAL + """, c as (select trace_id, count(*) as c, avg(x) as mean from g group by trace_id having count(*) >= 64), w as (select trace_id, mean, unnest(range(0, (c - 64) // 7 + 1)) as win_idx from c), k as (select unnest(range(1, 33)) as k)"""


@query(_LONG_WINDOWS + """, z as (select w.trace_id, w.win_idx, k, sum((g.x - w.mean) * h * cos(2 * pi() * k * n / 64.0)) as re, sum((g.x - w.mean) * h * sin(2 * pi() * k * n / 64.0)) as im
  from (select *, unnest(range(0, 64)) as n from w) w join g on g.trace_id = w.trace_id and g.sample_idx = w.win_idx * 7 + n, (select unnest(range(0, 64)) as t, 0.5 - 0.5 * cos(2 * pi() * t / 63.0) as h) t, k where t.t = n group by w.trace_id, w.win_idx, k),
s as (select sum(pow(0.5 - 0.5 * cos(2 * pi() * t / 63.0), 2)) as s from (select unnest(range(0, 64)) as t) x)
select trace_id, win_idx, cast(k - 1 as int) as freq_idx, k * 40.0 / 64 as freq_hz, round(sqrt((re * re + im * im) / 40.0 / s * case when k = 32 then 1 else 2 end), 6) as value from z, s""")
def specgram(spark, d):
    return spectral.full_spectrogram(fx.signal(spark, d), FS, 1.6).withColumn("value", F.round("value", 6))


def _bandpass_sql(low: float, high: float) -> str:
    """The same sections as a recursion over samples: forwards from rest, then the result backwards."""
    sections = [list(map(float, s)) for s in spectral.butterworth_bandpass(low, high, FS)]

    def step(v: str, states: str) -> tuple[str, list[str]]:
        """The chain of sections of one sample as nested selects: (value, states) of each, the last first."""
        sql, columns = f"select trace_id, k, n, {v} as v0, {states}", ["v0"]
        for j, (b0, b1, b2, _, a1, a2) in enumerate(sections):
            sql = f"select *, {b1!r} * v{j} - {a1!r} * v{j + 1} + q{j} as np{j}, {b2!r} * v{j} - {a2!r} * v{j + 1} as nq{j} from (select *, {b0!r} * v{j} + p{j} as v{j + 1} from ({sql}) y{j}) z{j}"
        return sql, columns

    number = len(sections)
    old = ", ".join(f"r.np{j} as p{j}, r.nq{j} as q{j}" for j in range(number))
    rest = ", ".join(f"0.0::double as p{j}, 0.0::double as q{j}" for j in range(number))
    kept = f"trace_id, k, n, v{number} as y, " + ", ".join(f"np{j}, nq{j}" for j in range(number))
    parts = []
    for name, source in (("f", "g2"), ("b", "turned")):
        first = step("x", rest)[0].replace("select trace_id, k, n, x as v0", f"select trace_id, k, n, x as v0", 1) + ""
        begin = first.replace(f", {rest}", f", {rest} from {source} where k = 0", 1)
        following = step("s.x", old)[0].replace("select trace_id, k, n, s.x as v0", "select s.trace_id, s.k, s.n, s.x as v0", 1).replace(old, f"{old} from {name} r join {source} s on s.trace_id = r.trace_id and s.k = r.k + 1", 1)
        parts.append(f"{name} as (select {kept} from ({begin}) begun union all select {kept} from ({following}) went)")
    return "with recursive " + _SIGNAL.removeprefix("with ") + f", g2 as (select trace_id, sample_idx as k, count(*) over (partition by trace_id) as n, x from g), {parts[0]}, turned as (select trace_id, n - 1 - k as k, n, y as x from f), {parts[1]} select trace_id, n - 1 - k as sample_idx, round(y, 6) as x from b"


_BAND = (0.5, 15.0)


@query(_bandpass_sql(*_BAND))
def bandpass(spark, d):
    rows = spectral.segments(fx.signal(spark, d), length=128, halo=spectral.settling(*_BAND, FS))
    found = spectral.bandpass(rows, ["trace_id", "segment"], *_BAND, FS).select("trace_id", "segment", F.posexplode("samples").alias("k", "x"))
    return found.select("trace_id", (F.col("segment") * 128 + F.col("k")).alias("sample_idx"), F.round("x", 6).alias("x"))


@query(_DECODED + """, q as (select trace_id, sample_idx, count(*) over (partition by trace_id) as n, 2 * pi() * (cycles - avg(cycles) over (partition by trace_id)) as x from p),
z as (select trace_id, n, k, sum(x * cos(2 * pi() * ((k * sample_idx) % n) / n)) as re, sum(x * sin(2 * pi() * ((k * sample_idx) % n) / n)) as im from (select *, unnest(range(0, n // 2 + 1)) as k from q) y group by trace_id, n, k)
select trace_id, cast(k as int) as freq_idx, round(k * 2000.0 / n, 6) as freq_hz, round(log10(greatest((re * re + im * im) / (2000.0 * n) * case when k = 0 or 2 * k = n then 1 else 2 end, 1e-12)), 4) as log_value from z where k > 0""")
def phase_periodogram(spark, d):
    """The density of a trace's phase in radians, of which the ramp of its turns is part; in blocks of 256 samples, so most traces take several."""
    samples = _samples(spark, d).select("trace_id", "sample_idx", (2 * F.pi() * F.col("cycles")).alias("x"))
    made = transform.whole_periodogram(samples, WORD_FS, block=256).where("freq_idx > 0")
    return made.select("trace_id", F.col("freq_idx").cast("int").alias("freq_idx"), F.round("freq_hz", 6).alias("freq_hz"), F.round(F.log10(F.greatest("value", F.lit(1e-12))), 4).alias("log_value"))


@query(_DECODED + f""", q as (select trace_id, sample_idx, count(*) over (partition by trace_id) as n, radius as x from p),
z as (select trace_id, n, k, sum(x * cos(2 * pi() * ((k * sample_idx) % n) / n)) as re, sum(x * sin(2 * pi() * ((k * sample_idx) % n) / n)) as im from (select *, unnest(range(0, n // 2 + 1)) as k from q) y group by trace_id, n, k)
select trace_id, k as freq_idx, round(k * {WORD_FS} / n, 6) as freq_hz, round(sqrt(re * re + im * im), 2) as value from z where k * {WORD_FS} / n between 100.0 and 400.0""")
def radius_amplitude(spark, d):
    """The amplitude of whole traces of the radius from 100 to 400 Hz."""
    samples = _iqm(spark, d).select("trace_id", "sample_idx", decode.radius().alias("x"))
    made = transform.whole_amplitude(samples, WORD_FS, 100.0, 400.0, block=256)
    return made.select("trace_id", "freq_idx", F.round("freq_hz", 6).alias("freq_hz"), F.round("value", 2).alias("value"))


@query(_BLOCKS + ", m as (select vec_id, n, x - first(x order by n) over (partition by vec_id order by n) as x from f)" + _DFT.replace("range(0, 33)", "range(0, 64)").replace("128.0", "128").format(x="x").replace("k * n / 64.0", f"({F1} + k * {F2 - F1} / {NFFT}) * n / 128.0") + f"select vec_id, cast(k as int) as freq_idx, round((re * re + im * im) / 128.0 / 64 * case when k in (0, 63) then 1 else 2 end, 9) as value from z")
def zoom_callables(spark, d):
    """Detrending and taper given as functions: less the first sample, and none."""
    made = spectral.zoom_spectrogram(fx.vectors(spark, d), ["vec_id"], F1, F2, 128.0, NFFT, detrend=lambda x: x - x[:, :1], window=lambda n: [1.0] * n)
    return made.select("vec_id", "freq_idx", F.round("value", 9).alias("value"))


@query(_DECODED + "select trace_id, count(*) as n, round(max(cycles) - min(cycles), 4) as span, max(sample_idx) as last_idx from p group by trace_id")
def trace_hook(spark, d):
    """A function of the user's on each trace, which need not fit a task: by blocks of 128 samples, and merged."""

    def update(state, table):
        x = table.column("cycles").to_numpy()
        return merge(state, (len(x), x.min(), x.max(), table.column("sample_idx").to_numpy().max()))

    def merge(a, b):
        return (a[0] + b[0], min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3])) if a else b

    about = hooks.Reduction(lambda: None, update, merge, lambda s: {"n": s[0], "span": float(s[2] - s[1]), "last_idx": int(s[3])}, "n long, span double, last_idx long")
    return hooks.reduce_traces(_samples(spark, d), about, block=128, fan=4).withColumn("span", F.round("span", 4))


@query(SQL["radius_moments"])
def hook_moments(spark, d):
    rows = _iqm(spark, d).select("trace_id", "sample_idx", decode.radius().alias("x"))
    found = hooks.reduce_traces(rows, hooks.moments_hook(), block=128, fan=2)
    return found.select("trace_id", *[F.round(f"m{k}", 6).alias(f"m{k}") for k in (3, 4, 5, 6)])


@query(_DECODED + """, e as (select trace_id, min(radius) as least, (max(radius) - min(radius)) / 100 as width from p group by trace_id)
select trace_id, cast(least(floor((radius - least) / width), 99) as int) as bin, count(*) as n from p join e using (trace_id) group by all""")
def hook_histogram(spark, d):
    """Two reductions: the ranges, then counts between them."""
    rows = _iqm(spark, d).select("trace_id", "sample_idx", decode.radius().alias("x"))
    ranges = hooks.reduce_traces(rows, hooks.range_hook(), block=128)
    found = hooks.reduce_traces(rows.join(ranges.select("trace_id", "least", "most"), "trace_id"), hooks.histogram_hook(), block=128)
    return found.select("trace_id", F.posexplode("counts").alias("bin", "n")).where("n > 0")


# --- events

_SPANS = "with e as (select user_id, event_type, epoch_us(ts) / 1000000 as b, epoch_us(ts) / 1000000 + value as f from events)"
_STA = _SIGNAL + ", r as (select trace_id, sample_idx, case when sample_idx < 49 then 0.0 else coalesce(avg(x * x) over (partition by trace_id order by sample_idx rows between 4 preceding and current row) / nullif(avg(x * x) over (partition by trace_id order by sample_idx rows between 49 preceding and current row), 0), 0.0) end as ratio from g)"


@query(_STA + " select trace_id, sample_idx, round(ratio, 6) as ratio from r")
def sta_lta(spark, d):
    return events.sta_lta(fx.signal(spark, d), 5, 50).withColumn("ratio", F.round("ratio", 6))


@query(_SIGNAL + ", s as (select trace_id, sample_idx, sum(x * x) over (partition by trace_id order by sample_idx rows between 69 preceding and current row) as s from g) select trace_id, sample_idx, round((s - avg(s) over (partition by trace_id)) / nullif(stddev_pop(s) over (partition by trace_id), 0), 6) as z from s")
def z_detect(spark, d):
    return events.z_detect(fx.signal(spark, d), 70).withColumn("z", F.round("z", 6))


@query(_STA + ", h as (select *, sample_idx - row_number() over (partition by trace_id order by sample_idx) as island from r where ratio >= 0.8) select trace_id, min(sample_idx) filter (ratio > 1.5) as onset, max(sample_idx) as \"end\" from h group by trace_id, island having count(*) filter (ratio > 1.5) > 0")
def trigger_onset(spark, d):
    return events.triggers(events.sta_lta(fx.signal(spark, d), 5, 50), 1.5, 0.8)


@query(_SPANS + """, p as (select *, case when b > lag(f) over w + 600 then 1 else 0 end as fresh from e window w as (partition by user_id, event_type order by b, f)),
g as (select *, sum(fresh) over (partition by user_id, event_type order by b, f rows unbounded preceding) as k from p)
select user_id, event_type, round(min(b), 3) as begin, round(max_by(f, b), 3) as "end", count(*) as n from g group by user_id, event_type, k""")
def event_merge(spark, d):
    found = events.merge_events(fx.spans(spark, d), 600.0, ["user_id", "event_type"])
    return found.select("user_id", "event_type", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "n")


@query(_SPANS + """, x as (select a.user_id, a.b as b1, a.f as e1, c.b as b2, c.f as e2 from e a join e c on a.user_id = c.user_id and a.event_type = 'click' and c.event_type = 'view'),
y as (select user_id, case when b2 >= b1 - 1 and e2 <= e1 + 1 then 1 when b2 >= b1 - 1 and b2 <= e1 + 1 then 2 when e2 >= b1 - 1 and e2 <= e1 + 1 then 3 when b2 <= b1 - 1 and e2 >= e1 + 1 then 4 end as k, * exclude (user_id) from x)
select user_id, round(case when k <= 2 then b2 else b1 end, 3) as begin, round(case when k in (1, 3) then e2 else e1 end, 3) as "end" from y where k is not null""")
def event_coincidence(spark, d):
    every = fx.spans(spark, d)
    kind = lambda t: every.where(F.col("event_type") == t).select("user_id", "begin", "end")
    found = events.coincidences(kind("click"), kind("view"), ["user_id"])
    return found.select("user_id", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"))


@query(SQL["event_coincidence"].replace("b1 - 1", "b1 - 43200").replace("e1 + 1", "e1 + 43200"))
def event_coincidence_wide(spark, d):
    """Clicks and views of a user within twelve hours of each other."""
    every = fx.spans(spark, d)
    kind = lambda t: every.where(F.col("event_type") == t).select("user_id", "begin", "end")
    found = events.coincidences(kind("click"), kind("view"), ["user_id"], 43200.0, 86400.0)
    return found.select("user_id", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"))


@query(_SPANS + ", x as (select user_id, epoch_us(ts) / 1000000 as t, value from events) select x.user_id, round(e.b, 3) as begin, round(e.f, 3) as \"end\", count(*) as n, round(sum(x.value), 4) as total from e join x on x.user_id = e.user_id and x.t between e.b - 900 and e.f + 900 where e.event_type = 'error' group by x.user_id, e.b, e.f")
def event_trim(spark, d):
    """Samples from 15 minutes before each error to 15 minutes after it."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    samples = fx.table(spark, d, "events").select("user_id", at.alias("t"), "value")
    errors = fx.spans(spark, d).where("event_type = 'error'").select("user_id", "begin", "end")
    found = events.trim_around(samples, errors, ["user_id"], 900.0, 4096.0).groupBy("user_id", "begin", "end").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return found.select("user_id", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "n", F.round("total", 4).alias("total"))


# --- catalog, windows, bins

_HEADERS = "with h as (select o_orderkey as trace_id, o_orderkey % 8 as k, o_orderdate as t from orders)"


@query(_HEADERS + """ select trace_id, cast(1024 * (k + 1) as varchar) as flag_q, cast(k as varchar) as flag_s, true as low_rate, 1e7 / (1 + k) as fs, epoch_us(t) * 1000 - 28800000000000 as start_ns, cast(28800 as int) as utc_offset_s,
epoch_us(t) * 1000 - 28800000000000 + 1000 * (k + 1) * 100 * (k + 1) as end_ns, 1024.0 * (k + 1) * (k + 1) / 1e7 as expected_s, round(1000.0 / 1024, 6) as complete from h""")
def trace_catalog(spark, d):
    rows = catalogs.catalog(fx.headers(spark, d))
    return rows.select("trace_id", F.col("flags")["q"].alias("flag_q"), F.col("flags")["s"].alias("flag_s"), F.map_contains_key("flags", F.lit("l")).alias("low_rate"), "fs", "start_ns", "utc_offset_s", "end_ns", "expected_s", F.round("complete", 6).alias("complete"))


@query(_HEADERS + """ select trace_id, case k when 7 then 'no recording start' when 5 then 'bytes left over' when 4 then 'not a trace' else 'rate not valid' end as problem from h where k in (0, 4, 5, 7)""")
def trace_validate(spark, d):
    """Of eight headers one has lost its second line, one tells a rate of 20 MHz, two come from bad files; only those are put aside."""
    k = F.col("trace_id") % 8
    text = F.when(k == 7, F.regexp_replace("header", "# recording start.*", "")).when(k == 0, F.regexp_replace("header", " -l ", " ")).when(k == 4, None).otherwise(F.col("header"))
    rows = fx.headers(spark, d).withColumn("header", text).withColumn("error", F.when(k == 5, "bytes left over").when(k == 4, "not a trace"))
    return catalogs.validated(rows)[1].select("trace_id", "problem")


@query(_HEADERS + " select trace_id, t as recorded_local, k as tag_s, 1024 * (k + 1) as tag_q, 'laser2_20km' as rest from h")
def file_meta(spark, d):
    rows = catalogs.file_meta(fx.headers(spark, d))
    return rows.select("trace_id", "recorded_local", F.col("tags")["s"].alias("tag_s"), F.col("tags")["q"].alias("tag_q"), "rest")


_FROM, _LONG = 820454400 * SECOND, 366 * 86400 * SECOND


@query(_CATALOG + f""", v as (select *, least(greatest({_FROM}, start_ns), end_ns) as a, least(greatest({_FROM + _LONG}, start_ns), end_ns) as b from c)
select trace_id, (a - start_ns) // interval_ns as start_idx, (a - start_ns) // interval_ns + (b - a) // interval_ns as end_idx from v""")
def time_window(spark, d):
    """The samples of every trace in 1996."""
    return times.window_bounds(fx.catalog(spark, d), _FROM, duration=_LONG).select("trace_id", "start_idx", "end_idx")


_WEEK, _GRID0, _GRID1 = 7 * 86400 * SECOND, 694224000 * SECOND, 915148800 * SECOND
_BINS = f"b as (select {_GRID0} + k * {_WEEK} as bin_start_ns from (select unnest(range(0, {-(-(_GRID1 - _GRID0) // _WEEK)})) as k) x)"


@query(_CATALOG + f", {_BINS} select bin_start_ns, trace_id, row_number() over (partition by bin_start_ns order by trace_id) as position from b join c on bin_start_ns between start_ns and end_ns or bin_start_ns + {_WEEK} between start_ns and end_ns")
def bin_files(spark, d):
    return bins.bin_files(fx.catalog(spark, d), _GRID0, _GRID1, _WEEK).withColumn("position", F.col("position").cast("long"))


@query(_CATALOG + f", {_BINS} select bin_start_ns from b where bin_start_ns not in (select {_GRID0} + (start_ns - {_GRID0}) // {_WEEK} * {_WEEK} from c where trace_id % 64 = 0)")
def bins_left(spark, d):
    """Weeks in which no trace with an id divisible by 64 begins."""
    done = fx.catalog(spark, d).where("trace_id % 64 = 0").select((_GRID0 + F.expr(f"(start_ns - {_GRID0}) div {_WEEK}") * _WEEK).alias("bin_start_ns"))
    return bins.bins_left(bins.time_bins(spark, _GRID0, _GRID1, _WEEK), done)


_SPECTRUM = "with s as (select time_bucket(interval '15 minutes', ts) as bin_start, cast(user_id % 8 as int) as freq_idx, avg(value / 10) as m, stddev_pop(value / 10) as d from events group by 1, 2)"


@query(_SPECTRUM + """, o as (select *, cast(bin_start as date) as day, row_number() over (partition by cast(bin_start as date) order by bin_start desc) as r from s where freq_idx = 3)
select bin_start, day, cast(hour(bin_start) * 3600 + minute(bin_start) * 60 + second(bin_start) as int) as second_of_day, round(pow(10, m / 20), 6) as value, round(pow(10, (m - d) / 20), 6) as low, round(pow(10, (m + d) / 20), 6) as high
from o where day <> (select max(day) from o) or r > 9""")
def diurnal_profile(spark, d):
    found = bins.diurnal_profile(fx.spectrum(spark, d), 3)
    return found.select("bin_start", "day", "second_of_day", *[F.round(c, 6).alias(c) for c in ("value", "low", "high")])


@query(_SPECTRUM + ", o as (select *, row_number() over (partition by freq_idx order by bin_start desc) as r from s) select bin_start, freq_idx, round(m, 9) as mean_db from o where r = 39")
def spectrum_at(spark, d):
    return bins.nth_from_end(fx.spectrum(spark, d), 39, ["freq_idx"]).select("bin_start", "freq_idx", F.round("mean_db", 9).alias("mean_db"))


@query(_SPECTRUM + """, o as (select *, row_number() over (partition by freq_idx order by bin_start) as position from s)
select bin_start, freq_idx, position, round(pow(10, m / 20), 6) as value from o where freq_idx in (2, 5)""")
def stored_profile(spark, d):
    """A collated store written and read back, two frequencies in the order of time."""
    from fringeworks.sources.sinks import write_bins

    path = work_path(spark, "store")
    write_bins(fx.spectrum(spark, d).withColumn("bin_start_ns", times.epoch_ns(F.col("bin_start"))), path)
    found = bins.collated(spark, path, [2, 5])
    return found.select("bin_start", "freq_idx", F.col("position").cast("long").alias("position"), F.round("value", 6).alias("value"))


@query(_HEADERS + " , x as (select trace_id, 0.0001 * 1e7 / (1 + k) * (1 + trace_id % 5) as x from h), y as (select *, pow(2, floor(log2(x))) as low from x) select trace_id, cast(case when x - low <= 2 * low - x then low else 2 * low end as bigint) as nfft from y")
def window_lengths(spark, d):
    """The power of two nearest to a window of 0.1 to 0.5 ms of each capture."""
    rows = catalogs.catalog(fx.headers(spark, d))
    return rows.select("trace_id", spectral.power_of_two_near(F.col("fs") * 0.0001 * (1 + F.col("trace_id") % 5)).alias("nfft"))


@query("select event_id, ts + interval '8 hours' as local, ts as utc, cast(hour(ts + interval '8 hours') * 3600 + minute(ts) * 60 + second(ts) as int) as second_of_day from events")
def local_time(spark, d):
    local = times.local_time(F.col("ts"), "Asia/Singapore")
    rows = fx.table(spark, d, "events").select("event_id", local.alias("local"))
    return rows.select("event_id", "local", times.instant(F.col("local"), "Asia/Singapore").alias("utc"), times.second_of_day(F.col("local")).alias("second_of_day"))


def _bin_spectra(spark, d):
    """Traces of one sample a second that begin one after the other, in bins of 256 s."""
    samples = stored(_samples(spark, d).select("trace_id", "sample_idx", F.col("radius").alias("x")), "samples")
    sizes = samples.groupBy("trace_id").agg((F.max("sample_idx") + 1).alias("n"))
    found = sizes.select("trace_id", (F.col("trace_id") * 1000 * SECOND).alias("start_ns"), ((F.col("trace_id") * 1000 + F.col("n")) * SECOND).alias("end_ns"), F.lit(SECOND).cast("long").alias("interval_ns"))
    last = found.agg(F.max("end_ns")).first()[0] or SECOND
    placed = bins.bin_files(found, 0, last, 256 * SECOND, "overlap")
    plan = bins.batches(placed, found, 256 * SECOND, 128 * SECOND, 32 * SECOND)
    return bins.averaged_spectrum(bins.decimated_batches(samples, plan, (2,)), 32.0, 0.9, 0.01, 0.2, least_s=32.0)


# seconds and tenths of them: batches of 128 s are 99.2 s apart; traces lie further apart than a bin is long
_BIN_SPECTRA = _DECODED + """, c as (select trace_id, count(*) as n, trace_id * 1000 as st, trace_id * 1000 + count(*) as en from p group by trace_id),
b as (select *, unnest(range(st // 256, (en + 255) // 256)) as bin from c), f as (select *, greatest(bin * 256, st + 1) as fr, least(en, bin * 256 + 256) as til from b),
g as (select *, unnest(range(0, case when til > fr then cast(ceil((til - fr) * 10 / 992.0) as bigint) else 0 end)) as batch from f),
h as (select trace_id, bin, batch, st, fr * 10 + batch * 992 as bb, least(fr * 10 + batch * 992 + 1280, en * 10) as ee from g),
i as (select trace_id, bin, batch, (bb - st * 10) // 10 as i0, (bb - st * 10) // 10 + (ee - bb) // 10 as i1 from h),
x as (select i.trace_id, bin, batch, i1 - i0 as len, p.sample_idx - i0 as j, p.radius as x from i join p on p.trace_id = i.trace_id and p.sample_idx >= i0 and p.sample_idx < i1),
t0 as (select k, case when k = 20 then 0.5 else sin(pi() * (k - 20) / 2.0) / (pi() * (k - 20) / 2.0) / 2 end * (0.54 - 0.46 * cos(2 * pi() * k / 40.0)) as h from (select unnest(range(0, 41)) as k) a),
t as (select k - 20 as k, h / (select sum(h) from t0) as h from t0),
dd as (select trace_id, bin, batch, (len + 1) // 2 as m, (j - k) // 2 as o, sum(x * h) as y from x, t where j >= k and (j - k) % 2 = 0 and (j - k) // 2 < (len + 1) // 2 group by trace_id, bin, batch, len, (j - k) // 2),
ww as (select *, unnest(range(0, (m - 16) // 2 + 1)) as w from (select distinct trace_id, bin, batch, m from dd where m >= 16) y),
v as (select ww.trace_id, ww.bin, ww.batch, w, o - 2 * w as n, y from ww join dd on dd.trace_id = ww.trace_id and dd.bin = ww.bin and dd.batch = ww.batch and o >= 2 * w and o < 2 * w + 16),
l as (select *, avg(y) over win as mean, sum((n - 7.5) * y) over win / 340.0 as slope from v window win as (partition by trace_id, bin, batch, w)),
u0 as (select bin, trace_id, batch, w, n, (y - mean - slope * (n - 7.5)) * (0.5 - 0.5 * cos(2 * pi() * n / 15.0)) as x0 from l), k as (select unnest(range(0, 16)) as k),
z as (select bin, trace_id, batch, w, k, sum(x0 * cos(2 * pi() * (0.01 + k * 0.19 / 16) * n / 0.5)) as re, sum(x0 * sin(2 * pi() * (0.01 + k * 0.19 / 16) * n / 0.5)) as im from u0, k group by bin, trace_id, batch, w, k),
e as (select bin, k, 10 * log10(greatest((re * re + im * im) / 0.5 / (select sum(pow(0.5 - 0.5 * cos(2 * pi() * n / 15.0), 2)) from (select unnest(range(0, 16)) as n) q) * case when k in (0, 15) then 1 else 2 end, 1e-300)) as db from z)
select bin * 256 * 1000000000 as bin_start_ns, cast(k as int) as freq_idx, round(0.01 + k * 0.19 / 16, 9) as freq_hz, round(0.01 + k * 0.19 / 15, 9) as freq_label_hz, count(*) as n_windows, round(avg(db), 5) as mean_db, round(stddev_pop(db), 4) as std_db"""


def _rounded(found):
    places = {"freq_hz": 9, "freq_label_hz": 9, "mean_db": 5, "std_db": 4}
    return found.select(*[F.round(c, places[c]).alias(c) if c in places else c for c in found.columns])


@query(_BIN_SPECTRA + " from e group by bin, k")
def bin_spectrum(spark, d):
    return _rounded(_bin_spectra(spark, d))


@query(_BIN_SPECTRA + ", cast(epoch_ms(bin * 256 * 1000) as date) as date from e group by bin, k")
def bin_spectrum_sink(spark, d):
    """Written twice: the second run finds nothing left to add."""
    from fringeworks.sources.sinks import append_bins, read_bins

    spectra, path = stored(_bin_spectra(spark, d), "spectra"), work_path(spark, "bins")
    append_bins(spectra, path)
    append_bins(spectra, path)
    return _rounded(read_bins(spark, path))


# --- sweeps


@query("select cast(i as int) as i, cast(j as int) as j, round(sqrt(0.04 + i * (100 - 0.04) / (p - 1)), 9) as vpp from (select max(l_linenumber) as p, count(distinct l_suppkey % 5) as r from lineitem) x, (select unnest(range(0, 1000)) as i) y, (select unnest(range(0, 1000)) as j) z where i < p and j < r")
def sweep_axis(spark, d):
    size = fx.sweep(spark, d).agg(F.max("i").alias("p"), F.count_distinct("j").alias("r")).first()
    return sweep.sweep_axis(spark, size["p"], size["r"], 0.2, 10.0).withColumn("vpp", F.round("vpp", 9))


_SWEEP = f"with s as ({fx.SWEEP.format(lineitem='lineitem')})"


@query(_SWEEP + " select distinct i, j from s where i > 3")
def sweep_left(spark, d):
    cells = fx.sweep(spark, d)
    return sweep.sweep_left(cells.select("i", "j").distinct(), cells.where("i <= 3"))


@query(_SWEEP + " select i, j, count(*) as n, round(avg(x), 4) as mean, round(stddev_pop(x), 4) as std_dev, round(min(x), 4) as min from s group by i, j")
def sweep_upsert(spark, d):
    """A store of wrong cells up to i = 3, then all cells upserted."""
    from fringeworks.sources.sinks import upsert_cells

    path = work_path(spark, "sweep")
    cells = stats.summary(fx.sweep(spark, d), ["i", "j"])
    cells.where("i <= 3").withColumn("mean", F.lit(0.0)).write.partitionBy("i").parquet(path)
    upsert_cells(cells, path, work_path(spark, "staged"))
    return spark.read.parquet(path).select(F.col("i").cast("int").alias("i"), "j", "n", *[F.round(c, 4).alias(c) for c in ("mean", "std_dev", "min")])


# --- files and streams


def _trace_files(spark, d) -> str:
    from fringeworks.sources.phase_trace import write_traces

    path = work_path(spark, "traces")
    write_traces(fx.words(spark, d).withColumn("header", F.lit("# command line: ./board -q 1024 -s 249 -l -b\n# recording start: 2024-01-19 00:34:36 +0800\n")), path)
    return path


_SUMS = "count(*) as n, cast(sum(i) as bigint) as sum_i, cast(sum(q) as bigint) as sum_q, cast(sum(m) as bigint) as sum_m"


@query(_DECODED + f"select cast(trace_id as varchar) as trace_id, {_SUMS}, cast(sum(case when sample_idx >= 10 and sample_idx < 200 then i end) as bigint) as part_i, count(*) filter (sample_idx >= 10 and sample_idx < 200) as part_n from d group by trace_id")
def src_words(spark, d):
    """Captures written to files and read back: whole, and for a range of samples that is pushed into the scan."""
    path = _trace_files(spark, d)
    words = spark.read.format("phase_trace").option("block", 1 << 14).load(path)
    whole = decode.decode(words).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "iqm"])
    words = spark.read.format("phase_trace").option("block", 1 << 14).option("pushdown", "true").load(path)
    part = decode.decode(words.where("sample_idx >= 10 and sample_idx < 200")).groupBy("trace_id").agg(F.sum("i").alias("part_i"), F.count(F.lit(1)).alias("part_n"))
    return whole.join(part, "trace_id")


@query(_DECODED + f", e as (select d.*, count(*) over (partition by trace_id) as c from d) select cast(trace_id as varchar) as trace_id, {_SUMS} from e where sample_idx >= c // 4 and sample_idx < c // 2 and cast(trace_id as varchar)[1] in ('1', '2', '7') group by trace_id")
def src_windows(spark, d):
    """The second quarter of the traces that two globs name: windows of a catalog go to the files as ranges."""
    from fringeworks.sources import captures

    files = captures.list_captures(spark, _trace_files(spark, d), ["[12]*.bin", "7*.bin"])
    about = captures.read_headers(files).select("trace_id", F.expr("n_samples div 4").alias("start_idx"), F.expr("n_samples div 2").alias("end_idx"))
    named = files.withColumn("trace_id", F.regexp_extract("path", "([^/]+)[.]bin$", 1)).join(about, "trace_id")
    words = captures.read_ranges(named, 100)
    return decode.decode(words).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"sum_{c}") for c in "iqm"])


@query(SQL["unwrap_window"].replace("select trace_id, sample_idx, mu as by_trace", "select cast(trace_id as varchar) as trace_id, sample_idx, mu as by_trace"))
def src_indexed_windows(spark, d):
    """The middle third of each capture by a stored index of blocks of 100 samples: only these bytes are read."""
    from fringeworks.sources import captures, index

    files = captures.list_captures(spark, _trace_files(spark, d))
    path = work_path(spark, "index")
    index.add_captures(files, path, 100)
    index.add_captures(files, path, 100)  # nothing is left to add
    known = index.read_index(spark, path)
    bounds = known.groupBy("trace_id").agg(F.sum("n").alias("n")).select("trace_id", F.expr("n div 3").alias("start_idx"), F.expr("2 * n div 3").alias("end_idx"))
    by_trace, by_window = (index.read_windows(files, known, bounds, anchor, 100).select("trace_id", "sample_idx", F.col("m_unwrapped").alias(f"by_{anchor}")) for anchor in ("trace", "window"))
    return by_trace.join(by_window, ["trace_id", "sample_idx"])


@query(_DECODED + """, f as (select trace_id, timestamp '1995-01-01' + to_hours(cast(7 * trace_id as bigint)) as t, trace_id % 4 as k, count(*) as n from d group by trace_id)
select strftime(t, '%Y-%m-%dT%H:%M:%S') || '_s' || k || '_' || trace_id as trace_id, t as recorded_local, n as n_samples from f where t >= timestamp '1995-01-02' and t < timestamp '1995-06-01' and k in (1, 3)""")
def src_dated_captures(spark, d):
    """Captures named by their time and skip, seven hours apart: those of two globs and five months."""
    from fringeworks.sources import captures
    from fringeworks.sources.phase_trace import write_traces

    path, k = work_path(spark, "dated"), F.col("trace_id")
    stamp = F.date_format(F.expr("timestamp_ntz'1995-01-01' + make_interval(0, 0, 0, 0, int(7 * trace_id))"), "yyyy-MM-dd'T'HH:mm:ss")
    name = F.concat(stamp, F.lit("_s"), (k % 4).cast("string"), F.lit("_"), k.cast("string"))
    write_traces(fx.words(spark, d).select(name.alias("trace_id"), F.lit("# recording\n").alias("header"), "sample_idx", "word"), path)
    files = captures.list_captures(spark, path, ["*_s1_*.bin", "*_s3_*.bin"], "1995-01-02", "1995-06-01")
    found = captures.read_headers(files)
    named = files.withColumn("trace_id", F.url_decode(F.regexp_replace(F.regexp_extract("path", "([^/]+)[.]bin$", 1), "[+]", "%2B")))
    return named.join(found, "trace_id").select("trace_id", "recorded_local", "n_samples")


@query(_DECODED + "select cast(trace_id as varchar) as trace_id, cast(40000 as double) as fs, count(*) as n_samples, true as ok from d group by trace_id")
def src_headers(spark, d):
    path = _trace_files(spark, d)
    return catalogs.catalog(spark.read.format("phase_trace").option("mode", "header").load(path)).select("trace_id", "fs", "n_samples", "ok")


@query(_SIGNAL + " select trace_id, count(*) as n, round(avg(x), 6) as mean, round(var_pop(x), 4) as var from g group by trace_id")
def stream_welford(spark, d):
    from fringeworks.streaming import stream

    chunks, out = work_path(spark, "chunks"), work_path(spark, "welford")
    fx.signal(spark, d).repartition(4, "trace_id").write.parquet(chunks)
    source = spark.readStream.schema("trace_id long, sample_idx long, x double").option("maxFilesPerTrigger", 2).parquet(chunks)
    stream.run_available(stream.running_moments(source, ["trace_id"]), work_path(spark, "checkpoint"), lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(out), mode="update")
    latest = spark.read.parquet(out).groupBy("trace_id").agg(F.max_by(F.struct("n", "mean", "var"), "batch").alias("s"))
    return latest.select("trace_id", "s.n", F.round("s.mean", 6).alias("mean"), F.round("s.var", 4).alias("var"))


@query(_DECODED + "select trace_id, sample_idx, mu as m_unwrapped from u")
def stream_unwrap(spark, d):
    """Chunks of 128 samples that arrive out of order, a batch each: the first, fourth, seventh, third, sixth, second and fifth."""
    from fringeworks.streaming import stream

    chunks, out = work_path(spark, "chunks"), work_path(spark, "unwrapped")
    rows = _iqm(spark, d).select("trace_id", "sample_idx", "m", F.expr("sample_idx div 128 * 3 % 7").cast("int").alias("arrival"))
    rows.repartition("arrival").write.partitionBy("arrival").parquet(chunks)
    stream.feed_by_name(spark, chunks)
    source = spark.readStream.schema("trace_id long, sample_idx long, m long, arrival int").option("maxFilesPerTrigger", 1).parquet(chunks)
    stream.run_available(stream.unwrapped(source.drop("arrival")), work_path(spark, "checkpoint"), path=out, rocks=True)
    return spark.read.schema("trace_id long, sample_idx long, m_unwrapped long").parquet(out)


@query(_DECODED + f"select cast(trace_id as varchar) as trace_id, count(*) as n, round(avg(radius), 3) as mean, round(stddev_pop(radius), 3) as std_dev, round(min(radius), 3) as min {_KEEP}")
def stream_captures(spark, d):
    """Captures as they arrive, into a store that takes each batch once; all files come again to a second stream, whose rows take the place of the first's."""
    from fringeworks.sources import store
    from fringeworks.streaming import stream

    path, out = _trace_files(spark, d), work_path(spark, "captured")
    made = lambda w: stats.summary(stats.skip_first(decode.decode(w), DROP).withColumn("x", decode.radius()), ["trace_id"])
    for source in ("first", "second"):
        stream.captures(spark, path, work_path(spark, "checkpoint"), made, lambda b, k, s=source: store.apply_batch(b, out, k, s))
    return store.latest(spark, out, ["trace_id"]).select("trace_id", "n", *[F.round(c, 3).alias(c) for c in ("mean", "std_dev", "min")])


@query("select time_bucket(interval '15 minutes', ts) as bin_start, count(*) as n, round(avg(value), 6) as mean from events group by 1")
def stream_bins(spark, d):
    """All bins of all events: files arrive in any order, so the last update of a bin stands."""
    from fringeworks.streaming import stream

    chunks, out = work_path(spark, "chunks"), work_path(spark, "binned")
    fx.table(spark, d, "events").select("ts", "value").withColumn("ts", F.col("ts").cast("timestamp")).repartitionByRange(4, "ts").write.parquet(chunks)
    source = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(chunks)
    stream.run_available(stream.binned(source, "ts"), work_path(spark, "checkpoint"), lambda b, k: b.withColumn("batch", F.lit(k)).write.mode("append").parquet(out), mode="update")
    latest = spark.read.parquet(out).groupBy("bin_start").agg(F.max_by(F.struct("n", "mean"), "batch").alias("s"))
    return latest.select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "s.n", F.round("s.mean", 6).alias("mean"))


@query(_SPANS + """, p as (select *, case when b > max(f) over (partition by user_id order by b, f rows between unbounded preceding and 1 preceding) + 600 then 1 else 0 end as fresh from e),
g as (select *, sum(fresh) over (partition by user_id order by b, f rows unbounded preceding) as k from p)
select user_id, round(min(b), 3) as begin, round(max(f), 3) as "end", count(*) as n from g group by user_id, k having max(f) + 600 <= (select max(b) from e) - 3600""")
def stream_sessions(spark, d):
    """Events of a user that begin within ten minutes of the end of all before them, as they arrive: those that are final an hour later."""
    from fringeworks.streaming import stream

    chunks, out = work_path(spark, "chunks"), work_path(spark, "sessions")
    spans = fx.spans(spark, d).select("user_id", "begin", "end", F.timestamp_micros(F.round(F.col("begin") * 1000000).cast("long")).alias("at"))
    spans.repartitionByRange(4, "at").write.parquet(chunks)  # parts by name are parts of time
    stream.feed_by_name(spark, chunks)
    source = spark.readStream.schema("user_id long, begin double, end double, at timestamp").option("maxFilesPerTrigger", 1).parquet(chunks)
    stream.run_available(stream.sessions(source, ["user_id"], 600.0, "1 hour"), work_path(spark, "checkpoint"), path=out)
    rows = spark.read.schema("user_id long, begin double, end double, n long").parquet(out)
    return rows.select("user_id", F.round("begin", 3).alias("begin"), F.round("end", 3).alias("end"), "n")


#: Events come in nine parts: eight of the order of time, then every 97th of them all.
_LATE = """with e as (select *, time_bucket(interval '15 minutes', ts) as bin_start, event_id % 97 = 0 as tardy from events), w as (select max(ts) filter (not tardy) - interval '1 hour' as w0, max(ts) - interval '1 hour' as w1 from e),
b as (select e.*, w1, tardy and bin_start + interval '15 minutes' <= w0 as late from e, w) """


def _late_store(spark, d) -> str:
    from fringeworks.streaming import stream

    staged, chunks, path = (work_path(spark, name) for name in ("staged", "chunks", "late"))
    rows = fx.table(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "value")
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("a"), F.max(F.unix_micros("ts")).alias("b")).first()
    eighth = F.least(F.expr(f"(unix_micros(ts) - {ends['a'] or 0}) * 8 div {(ends['b'] or 0) - (ends['a'] or 0) + 1}"), F.lit(7))
    rows = rows.withColumn("arrival", F.when(F.col("event_id") % 97 == 0, 8).otherwise(eighth).cast("int"))
    rows.write.partitionBy("arrival").parquet(staged)  # a part has a file of each task
    checkpoint = work_path(spark, "checkpoint")
    for _ in stream.arrivals(spark, staged, chunks):
        source = spark.readStream.schema("event_id long, ts timestamp, value double, arrival int").parquet(chunks)
        stream.run_available(source.drop("arrival"), checkpoint, lambda b, k: stream.split_late(b, k, path, "ts", "15 minutes", 3600.0))
    return path


@query(_LATE + "select bin_start, count(*) as n, round(avg(value), 6) as mean from b where not late and bin_start + interval '15 minutes' <= w1 group by bin_start")
def stream_bins_final(spark, d):
    """Bins that are final an hour after their end, each once; state of the others alone is kept."""
    from fringeworks.streaming import stream

    path, out = _late_store(spark, d), work_path(spark, "final")
    stream.feed_by_name(spark, f"{path}/timely")
    parts = spark.sparkContext.defaultParallelism
    source = spark.readStream.schema("event_id long, ts timestamp, value double, part int").option("maxFilesPerTrigger", parts).parquet(f"{path}/timely")
    stream.run_available(stream.binned(source, "ts", late="1 hour"), work_path(spark, "checkpoint"), path=out, parts=parts)
    return spark.read.schema("bin_start timestamp, n long, mean double").parquet(out).select(F.col("bin_start").cast("timestamp_ntz").alias("bin_start"), "n", F.round("mean", 6).alias("mean"))


@query(_LATE + "select event_id, ts from b where late")
def stream_late_rows(spark, d):
    """Events that came when their bin was final."""
    from fringeworks.sources import store

    rows = store.read(spark, f"{_late_store(spark, d)}/late", "event_id long, ts timestamp, value double")
    return rows.select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each trace: samples, radius mean, deviation and least after the first ones, and the range of its phase."""
    samples = _samples(spark, sf_dir).where(F.col("sample_idx") >= DROP)
    return samples.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.avg("radius").alias("mean"), F.stddev_pop("radius").alias("std_dev"), F.min("radius").alias("min"), (F.max("cycles") - F.min("cycles")).alias("span"))
