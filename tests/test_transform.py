"""Whole-trace spectra against numpy, for any block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.operators import transform as m


def test_grids():
    for n in [*range(17, 400), 2**28, 2**28 - 57, 3**17, 10**9 + 7]:
        block = 1 << 20 if n > 1000 else 64
        g = m.grid(n, block)
        assert g.rows * g.columns == g.length and max(g.rows, g.columns) <= block and g.length >= (n if g.direct else 2 * n - 1)
        assert g.rows * g.width <= block and g.columns * g.height <= block
    with pytest.raises(ValueError):
        m.grid(2**41 - 21, 1 << 20)


def test_chirp_is_exact():
    n, i = 2**33 + 17, np.array([1, 12345678901, 2**33 + 16])
    want = np.exp(-1j * np.pi * np.array([(k * k % (2 * n)) / n for k in i.tolist()]))
    assert np.allclose(m._chirp(i, n), want, atol=1e-9)


@pytest.mark.parametrize("block", [16, 64, 1024])
def test_lengths(spark, block):
    """Lengths that factor, primes and short ones; one trace has a gap."""
    r = np.random.default_rng(block)
    lengths = [n for n in (1, 2, 15, 17, 36, 64, 97, 100, 128, 131, 240, 255, 256, 1021, 2000) if 2 * n - 1 <= block * block]
    traces = {f"t{n}": r.normal(size=n) + 5 for n in lengths}
    rows = [(k, i, float(v)) for k, x in traces.items() for i, v in enumerate(x) if (k, i) != ("t64", 7)]
    traces["t64"][7] = 0
    found = m.whole_transform(spark.createDataFrame(rows, "trace_id string, sample_idx long, x double").repartition(5), centred=False, block=block).collect()
    assert len(found) == sum(n // 2 + 1 for n in lengths)
    got = {(row.trace_id, row.freq_idx): complex(row.re, row.im) for row in found}
    for k, x in traces.items():
        assert np.allclose([got[k, i] for i in range(len(x) // 2 + 1)], np.fft.rfft(x), atol=1e-8)


def test_long_trace(spark):
    """2**22 samples in blocks of 2**12 and 2**15."""
    n = 1 << 22
    x = F.sin(F.col("id") * 0.37) + F.cos(F.col("id") * F.col("id") * 1e-7) + 3
    df = spark.range(0, n, 1, 8).select(F.lit(1).alias("trace_id"), F.col("id").alias("sample_idx"), x.alias("x"))
    i = np.arange(n, dtype=float)
    x = np.sin(i * 0.37) + np.cos(i * i * 1e-7) + 3
    want = np.abs(np.fft.rfft(x - x.mean())) ** 2 / (n * 100.0)
    want[1:-1] *= 2
    for block in (1 << 12, 1 << 15):
        got = m.whole_periodogram(df, 100.0, block=block).where("freq_idx % 16 = 3 or value > 1").select("freq_idx", "value").toPandas().sort_values("freq_idx")
        assert len(got) > n // 33 and got["freq_idx"].is_unique
        assert np.allclose(got["value"], want[got["freq_idx"]], rtol=1e-5, atol=1e-12)
        assert (want > 1).sum() == (got["value"] > 1).sum()


def test_nothing(spark):
    empty = spark.createDataFrame([], "trace_id long, sample_idx long, x double")
    assert m.whole_periodogram(empty, 1.0).collect() == []
    nulls = spark.createDataFrame([(1, 0, None), (1, 1, 2.0)], "trace_id long, sample_idx long, x double")
    assert [(r.freq_idx, r.re) for r in m.whole_transform(nulls, centred=False).orderBy("freq_idx").collect()] == [(0, 2.0), (1, -2.0)]


@pytest.mark.parametrize("lot", [1, 1 << 23])
def test_tiles_together(monkeypatch, lot):
    """Tiles of many traces take a few transforms; a lot ends with a tile, wherever batches do."""
    import pyarrow as pa

    r, block, calls = np.random.default_rng(1), 256, []
    for name in ("fft", "ifft", "rfft"):
        monkeypatch.setattr(np.fft, name, lambda *a, f=getattr(np.fft, name), **b: (calls.append(1), f(*a, **b))[1])
    monkeypatch.setattr(m, "LOT", lot)
    traces = {f"t{k}": r.normal(size=n) for k, n in enumerate([40, 521, 600, 613] * 10)}
    rows = []
    for k, x in traces.items():
        g = m.grid(len(x), block)
        rows += [(k, len(x), 0 if len(x) <= block else i % g.columns // g.width, i, v) for i, v in enumerate(x.tolist())]

    def dealt(table, *order):
        table = table.sort_by([(c, "ascending") for c in ("n", "tile", "trace_id", *order)])
        return iter(table.to_batches(max_chunksize=100))

    table = pa.table(dict(zip(("trace_id", "n", "tile", "sample_idx", "x"), map(list, zip(*rows, strict=True)), strict=True)))
    tiles = len({row[:3] for row in rows})
    down = pa.Table.from_batches(m._down_columns("trace_id", block)(dealt(table)))
    assert lot == 1 or len(calls) < tiles / 10
    along = pa.Table.from_batches(m._along_rows("trace_id", block)(dealt(down, "at")))
    found = pa.Table.from_batches(m._up_columns("trace_id", block)(dealt(along, "at"))).to_pylist()
    assert lot == 1 or len(calls) < tiles / 4
    assert len(found) == sum(len(x) // 2 + 1 for x in traces.values())
    got = {(row["trace_id"], row["freq_idx"]): complex(row["re"], row["im"]) for row in found}
    for k, x in traces.items():
        assert np.allclose([got[k, i] for i in range(len(x) // 2 + 1)], np.fft.rfft(x), atol=1e-8)
