"""Spectra of whole traces of any length: a distributed FFT over blocks.

A trace of n samples is a grid of n1 rows and n2 columns, filled row by row. Columns are transformed, turned by a twiddle factor, dealt by row and
transformed again (the four-step FFT), so a tile has at most ``block`` samples, and what moves between the two is packed tiles of the grid.
Samples are real: only rows up to n1 / 2 are kept, from which all frequencies up to n / 2 follow.

A length without two factors of at most ``block`` (a large prime, say) goes by Bluestein's chirp: a circular convolution over a power of two, whose kernel each task
makes for its own columns. The transform over rows of the one way and over columns of the way back are the same task, so that costs one more shuffle.

Tiles come to Python many at a time, in the order of n, and those of one grid are one array: a trace of a few tiles costs no calls of its own. What is found before the
last step (short traces, direct grids) goes through it as it is, so samples are read and dealt once.

The samples are written once. Traces of at most ``block`` samples are one tile. Samples that are missing count as the mean (or as zero where it isn't taken off). Every trace of up to
``block ** 2 / 2`` samples will do.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20


class Grid(NamedTuple):
    length: int  # of the transform: n, or the chirp's power of two
    rows: int
    columns: int
    width: int  # columns of a task
    height: int  # rows of a task
    direct: bool


@lru_cache(1 << 12)
def grid(n: int, block: int) -> Grid:
    """How a trace of ``n`` samples is cut."""
    low = np.arange(1, min(int(np.sqrt(n)) + 1, block) + 1)
    low = low[(n % low == 0) & (low * low <= n)]
    rows = n // int(low[-1])
    if direct := rows <= block:
        length = n
    else:
        length = 1 << (2 * n - 2).bit_length()
        rows = 1 << (length.bit_length() // 2)
        if rows > block:
            raise ValueError(f"a trace of {n} samples needs blocks of {rows}")
    columns = length // rows
    return Grid(length, rows, columns, max(1, block // rows), max(1, block // columns), direct)


def _chirp(i: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """exp(-i pi i**2 / n), the square taken modulo 2 n exactly."""
    i = np.asarray(i, np.int64) % (2 * n)
    if np.max(n, initial=0) < 1 << 31:
        square = i * i % (2 * n)
    else:  # the product in two parts that fit
        square = ((i >> 16) * i % (2 * n) * 65536 + (i & 65535) * i) % (2 * n)
    return np.exp(-1j * np.pi * (square / n))


#: Tiles that come to Python together: of about so many bytes, or one.
LOT = 1 << 23
#: Frequencies that are found wait in a piece of this tile.
_DONE = -1
_FOUND = np.dtype([("k", "<i8"), ("re", "<f8"), ("im", "<f8")])


def _lots(batches, key: str) -> Iterator:
    """Tables of whole tiles, with the row that each tile begins at; rows come in the order of n, tile, key."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def begins(table):
        names = table.column(key).combine_chunks()
        fresh = pc.not_equal(names.slice(1), names.slice(0, len(names) - 1)).to_numpy(zero_copy_only=False).astype(bool)
        for c in ("n", "tile"):
            fresh |= np.diff(table.column(c).to_numpy()) != 0
        return np.r_[0, np.flatnonzero(fresh) + 1]

    held, size, most = [], 0, LOT
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most:
            table = pa.Table.from_batches(held).combine_chunks()
            at = begins(table)
            if len(at) > 1:  # the last tile may go on
                yield table.slice(0, int(at[-1])), at[:-1]
                held = table.slice(int(at[-1])).to_batches()
            size = sum(b.nbytes for b in held)
            most = max(LOT, 2 * size)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, begins(table)


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """Where rows that agree in all columns begin and end."""
    fresh = np.zeros(max(len(columns[0]) - 1, 0), bool)
    for c in columns:
        fresh |= np.diff(c) != 0
    cuts = np.r_[0, np.flatnonzero(fresh) + 1, len(columns[0])].tolist() if len(columns[0]) else [0]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def _alike(n: np.ndarray, size: np.ndarray, block: int) -> Iterator:
    """Tiles of one grid and size, begin and end: those of a direct grid have one n, chirped ones share a power of two."""
    last = None
    for a, b in _runs(n, size):
        g = grid(int(n[a]), block)
        if last and last[0] == g and size[last[1]] == size[a]:
            last = (g, last[1], b)
        else:
            if last:
                yield last
            last = (g, a, b)
    if last:
        yield last


def _sizes(n: np.ndarray, tile: np.ndarray, block: int, of) -> np.ndarray:
    """Of each tile ``of(grid, tile)``."""
    out = np.empty(len(n), np.int64)
    for a, b in _runs(n):
        out[a:b] = of(grid(int(n[a]), block), tile[a:b])
    return out


def _once(values: np.ndarray, made) -> np.ndarray:
    """``made`` of the distinct values, for each."""
    distinct, which = np.unique(values, axis=0, return_inverse=True)
    return made(distinct)[which.reshape(-1)]


def _turns(rows: np.ndarray, columns: np.ndarray, length: int) -> np.ndarray:
    """Twiddle factors of tiles, whose rows and columns are a row each."""
    return np.exp(-2j * np.pi * ((rows[:, :, None] * columns[:, None, :]) % length / length))


def _packed(key: str, table, out: list[tuple]):
    """Rows of pieces; ``out`` has rows of the table, tiles, places and data."""
    import pyarrow as pa

    at, tile, place, data = (list(c) for c in zip(*out, strict=True)) if out else ([], [], [], [])
    rows = pa.array(at, pa.int64())
    return pa.RecordBatch.from_arrays(
        [table.column(key).combine_chunks().take(rows), table.column("n").combine_chunks().take(rows), pa.array(tile, pa.int64()), pa.array(place, pa.int64()), pa.array(data, pa.binary())], names=[key, "n", "tile", "at", "data"]
    )


def _found(at: np.ndarray, k: np.ndarray, z: np.ndarray, kept: np.ndarray) -> Iterator[tuple]:
    """A piece of found frequencies for each tile."""
    found = np.empty(int(kept.sum()), _FOUND)
    found["k"], found["re"], found["im"] = k[kept], z.real[kept], z.imag[kept]
    ends = np.cumsum(kept.reshape(len(at), -1).sum(1)).tolist()
    for row, a, b in zip(at.tolist(), [0, *ends[:-1]], ends, strict=True):
        yield row, _DONE, 0, found[a:b].tobytes()


def _down_columns(key: str, block: int):
    """Tiles of columns: transformed, turned, and cut by rows; short traces are done here."""

    def run(batches):
        for table, at in _lots(batches, key):
            i, x = table.column("sample_idx").to_numpy(), table.column("x").to_numpy(zero_copy_only=False)
            n, tile = table.column("n").to_numpy()[at], table.column("tile").to_numpy()[at]
            ends = np.r_[at[1:], len(i)]
            out: list[tuple] = []

            def placed(a, b):
                """The tiles' samples: their tile, number and value."""
                rows = slice(int(at[a]), int(ends[b - 1]))
                own = np.repeat(np.arange(b - a), ends[a:b] - at[a:b])
                some = i[rows] >= 0  # the others only name the tile
                return own[some], i[rows][some], x[rows][some]

            short = int(np.searchsorted(n, block, "right"))
            for a, b in _runs(n[:short]):
                own, k, v = placed(a, b)
                cells = np.zeros((b - a, int(n[a])))
                cells[own, k] = v
                z = np.fft.rfft(cells, axis=1)
                out += _found(at[a:b], np.broadcast_to(np.arange(z.shape[1]), z.shape), z, np.ones(z.shape, bool))
            for g, a, b in _alike(n[short:], np.zeros(len(n) - short), block):
                a, b = a + short, b + short
                own, k, v = placed(a, b)
                columns = tile[a:b, None] * g.width + np.arange(g.width)
                cells = np.zeros((b - a, g.rows, g.width), float if g.direct else complex)
                cells[own, k // g.columns, k % g.columns - columns[own, 0]] = v if g.direct else v * _chirp(k, n[a:b][own])
                if g.direct:
                    made = [np.fft.rfft(cells, axis=1)]
                else:

                    def kernel(about, g=g):
                        place = np.arange(g.rows)[:, None] * g.columns + (about[:, 1, None] * g.width + np.arange(g.width))[:, None, :]
                        away, own_n = np.minimum(place, g.length - place), about[:, 0, None, None]
                        return np.fft.fft(np.where(away < own_n, np.conj(_chirp(away, own_n)), 0), axis=1)

                    made = [np.fft.fft(cells, axis=1), _once(np.stack([n[a:b], tile[a:b]], 1), kernel)]
                height = made[0].shape[1]
                turns = _once(tile[a:b], lambda t, g=g, r=height: _turns(np.arange(r)[None, :], t[:, None] * g.width + np.arange(g.width), g.length))
                made = [y * turns for y in made]
                widths = np.minimum(g.width, g.columns - columns[:, 0]).tolist()
                firsts = range(0, height, g.height)
                for t, (row, width, first) in enumerate(zip(at[a:b].tolist(), widths, columns[:, 0].tolist(), strict=True)):
                    out += [(row, r // g.height, first, b"".join(y[t, r : r + g.height, :width].tobytes() for y in made)) for r in firsts]
            yield _packed(key, table, out)

    return run


def _assembled(data: list, tiles: int, parts: int, along: int, other: int) -> list[np.ndarray]:
    """The tiles of ``data``, their pieces in order, put together along an axis; ``other`` is their size on the other."""
    each, found = len(data) // tiles, []
    for p in range(each):
        values = np.frombuffer(b"".join(data[p::each]), complex).reshape(tiles, parts, -1)
        found.append(values.reshape((tiles, parts, other, -1) if along else (tiles, parts, -1, other)))
    whole = np.concatenate(found, 3 if along else 2)
    return [whole[:, k] for k in range(parts)]


def _pieces_of(table, at: np.ndarray):
    """n and tile of each tile, where it ends, and all rows' data."""
    return table.column("n").to_numpy()[at], table.column("tile").to_numpy()[at], np.r_[at[1:], table.num_rows], table.column("data").to_pylist()


def _along_rows(key: str, block: int):
    """Tiles of rows. Of a direct grid: the frequencies up to n / 2 that they have or mirror. Of a chirped one: transformed, times the kernel's, and on the way back."""

    def run(batches):
        for table, at in _lots(batches, key):
            n, tile, ends, data = _pieces_of(table, at)
            out = [(row, _DONE, 0, data[row]) for a, e in zip(at[tile == _DONE].tolist(), ends[tile == _DONE].tolist(), strict=True) for row in range(a, e)]
            left = tile != _DONE
            n, tile, ends, begin = n[left], tile[left], ends[left], at[left]
            heights = _sizes(n, tile, block, lambda g, t: np.minimum(g.height, (g.rows // 2 + 1 if g.direct else g.rows) - t * g.height))
            for g, a, b in _alike(n, heights, block):
                rows = tile[a:b, None] * g.height + np.arange(heights[a])
                own = [d for s, e in zip(begin[a:b].tolist(), ends[a:b].tolist(), strict=True) for d in data[s:e]]
                if g.direct:
                    (cells,) = _assembled(own, b - a, 1, 1, rows.shape[1])
                    z, m = np.fft.fft(cells, axis=2), int(n[a])
                    k = rows[:, :, None] + g.rows * np.arange(g.columns)
                    below = 2 * k <= m
                    mirrored = ((rows == 0) | (2 * rows == g.rows))[:, :, None]  # these rows mirror themselves
                    out += _found(begin[a:b], np.where(below, k, m - k), np.where(below, z, np.conj(z)), below | ~mirrored)
                else:
                    cells, kernel = _assembled(own, b - a, 2, 1, rows.shape[1])
                    z = np.fft.ifft(np.fft.fft(cells, axis=2) * np.fft.fft(kernel, axis=2), axis=2)
                    z *= np.conj(_once(rows, lambda r, g=g: _turns(r, np.arange(g.columns)[None, :], g.length)))
                    for t, (row, first) in enumerate(zip(begin[a:b].tolist(), rows[:, 0].tolist(), strict=True)):
                        out += [(row, c // g.width, first, z[t, :, c : c + g.width].tobytes()) for c in range(0, g.columns, g.width)]
            yield _packed(key, table, out)

    return run


def _up_columns(key: str, block: int):
    """Tiles of columns on the way back, and what has been found before."""

    def run(batches):
        import pyarrow as pa

        for table, at in _lots(batches, key):
            n, tile, ends, data = _pieces_of(table, at)
            done = [row for a, e in zip(at[tile == _DONE].tolist(), ends[tile == _DONE].tolist(), strict=True) for row in range(a, e)]
            known = np.frombuffer(b"".join(data[row] for row in done), _FOUND)
            out = [(np.repeat(np.array(done, np.int64), [len(data[row]) // _FOUND.itemsize for row in done]), known["k"], known["re"], known["im"])]
            left = tile != _DONE
            n, tile, ends, begin = n[left], tile[left], ends[left], at[left]
            widths = _sizes(n, tile, block, lambda g, t: np.minimum(g.width, g.columns - t * g.width))
            for g, a, b in _alike(n, widths, block):
                columns = tile[a:b, None] * g.width + np.arange(widths[a])
                own = [d for s, e in zip(begin[a:b].tolist(), ends[a:b].tolist(), strict=True) for d in data[s:e]]
                (cells,) = _assembled(own, b - a, 1, 0, columns.shape[1])
                z = np.fft.ifft(cells, axis=1)
                k = (np.arange(g.rows) * g.columns)[None, :, None] + columns[:, None, :]
                kept = 2 * k <= n[a:b, None, None]
                of = np.nonzero(kept)[0]
                z = z[kept] * _chirp(k[kept], n[a:b][of])
                out.append((begin[a:b][of], k[kept], z.real, z.imag))
            rows, k, re, im = (pa.array(np.concatenate(c)) for c in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([table.column(key).combine_chunks().take(rows), table.column("n").combine_chunks().take(rows), k, re, im], names=[key, "n", "freq_idx", "re", "im"])

    return run


def _cut(sizes: DataFrame, key: str, kind: str, block: int) -> DataFrame:
    """Of each trace: columns, width and tiles; a short one is a tile."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            cuts = [(n, n, 1) if n <= block else (g.columns, g.width, -(-g.columns // g.width)) for n in b.column("n").to_pylist() for g in [n > block and grid(n, block)]]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([c[k] for c in cuts], pa.int64()) for k in range(3))], names=[key, "n", "mean", "columns", "width", "tiles"])

    return sizes.mapInArrow(run, f"{key} {kind}, n long, mean double, columns long, width long, tiles long")


def whole_transform(df: DataFrame, key: str = "trace_id", value: str = "x", centred: bool = True, block: int = BLOCK) -> DataFrame:
    """key, n, freq_idx, re, im: the transform of each whole trace at freq_idx / n of the rate, up to the half; of the trace without its mean if ``centred``."""
    from fringeworks.sources.work import stored

    kind = dict(df.dtypes)[key]
    samples = stored(df.select(key, F.col("sample_idx").cast("long").alias("sample_idx"), F.col(value).cast("double").alias("x")).where("x is not null"), "samples")
    sizes = samples.groupBy(key).agg((F.max("sample_idx") + 1).alias("n"), (F.avg("x") if centred else F.lit(0.0)).alias("mean"))
    cut = stored(_cut(sizes, key, kind, block), "sizes")
    tiles = samples.join(cut.hint("shuffle_hash"), key).withColumn("x", F.col("x") - F.col("mean")).withColumn("tile", F.expr("(sample_idx % columns) div width"))
    names = cut.select(key, "n", F.explode(F.expr("sequence(0l, tiles - 1)")).alias("tile"), F.lit(-1).cast("long").alias("sample_idx"), F.lit(None).cast("double").alias("x"))
    tiles = tiles.select(names.columns).unionByName(names)
    pieces = f"{key} {kind}, n long, tile long, at long, data binary"
    together = lambda rows, *order: rows.repartition(key, "n", "tile").sortWithinPartitions("n", "tile", key, *order)
    down = together(tiles).mapInArrow(_down_columns(key, block), pieces)
    along = together(down, "at").mapInArrow(_along_rows(key, block), pieces)
    return together(along, "at").mapInArrow(_up_columns(key, block), f"{key} {kind}, n long, freq_idx long, re double, im double")


def whole_periodogram(df: DataFrame, fs: float, key: str = "trace_id", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, n, freq_idx, freq_hz, value: one-sided power density of each whole trace without its mean, no taper; a row for each (trace, frequency)."""
    k, n = F.col("freq_idx"), F.col("n")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (n * fs) * F.when((k == 0) | (2 * k == n), 1.0).otherwise(2.0)
    return whole_transform(df, key, value, True, block).select(key, "n", "freq_idx", (k * fs / n).alias("freq_hz"), power.alias("value"))


def whole_amplitude(df: DataFrame, fs: float, low: float, high: float, key: str = "trace_id", value: str = "x", block: int = BLOCK) -> DataFrame:
    """key, n, freq_idx, freq_hz, value: unscaled amplitude of each whole trace's transform at frequencies from ``low`` to ``high``."""
    made = whole_transform(df, key, value, False, block).withColumn("freq_hz", F.col("freq_idx") * fs / F.col("n")).where(F.col("freq_hz").between(low, high))
    return made.select(key, "n", "freq_idx", "freq_hz", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("value"))
