"""User functions per trace: as a whole, or by blocks and merged."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from math import comb
from typing import Any, NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 17


def analyse(df: DataFrame, fn: Callable, schema: str, key: str = "trace_id") -> DataFrame:
    """``fn`` (Arrow table -> Arrow table) on each trace, of which one task holds all samples; ``reduce_traces`` is for longer ones."""
    return df.groupBy(key).applyInArrow(fn, schema)


class Reduction(NamedTuple):
    """What is known of a stretch of a trace, as a state that can be pickled.

    ``merge(update(begin(), a), update(begin(), b))`` must be what ``update`` gives for a and b in a row: states are merged in the order of their stretches,
    in whatever grouping.
    """

    begin: Callable[[], Any]
    update: Callable[[Any, Any], Any]  # (state, Arrow table of a block, in order) -> state
    merge: Callable[[Any, Any], Any]
    finish: Callable[[Any], dict]
    schema: str


def reduce_traces(df: DataFrame, hook: Reduction, key: str = "trace_id", block: int = BLOCK, fan: int = 256) -> DataFrame:
    """key and ``hook.schema``: one row for each trace, of any length.

    Blocks of ``block`` samples become states in as many tasks; ``fan`` neighbouring states at a time become one, until each trace has one.
    """
    from fringeworks.sources.work import stored

    kind = dict(df.dtypes)[key]
    schema = f"{key} {kind}, block long, state binary"

    def table(source, number: int, state):
        import pyarrow as pa

        return pa.table({key: source.column(key)[:1], "block": pa.array([number], pa.int64()), "state": pa.array([pickle.dumps(state)], pa.binary())})

    def partial(rows):
        rows = rows.sort_by("sample_idx")
        return table(rows, rows.column("block")[0].as_py(), hook.update(hook.begin(), rows.drop_columns(["block"])))

    def merged(rows):
        rows = rows.sort_by("block")
        state, *others = map(pickle.loads, rows.column("state").to_pylist())
        for other in others:
            state = hook.merge(state, other)
        return table(rows, rows.column("block")[0].as_py() // fan, state)

    def finished(batches):
        import pyarrow as pa

        names = [x.strip().split(" ")[0] for x in hook.schema.split(",")]
        for b in batches:
            rows = [hook.finish(pickle.loads(s)) for s in b.column("state").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([r[n] for r in rows]) for n in names)], names=[key, *names])

    states = df.withColumn("block", F.expr(f"sample_idx div {block}")).groupBy(key, "block").applyInArrow(partial, schema)
    states = stored(states, "states")
    left = states.agg(F.max("block")).first()[0] or 0
    while left:
        states = states.groupBy(key, F.expr(f"block div {fan}").alias("_next")).applyInArrow(merged, schema)
        left //= fan
    return states.select(key, "state").mapInArrow(finished, f"{key} {kind}, {hook.schema}")


def moments_hook(value: str = "x", orders: tuple[int, ...] = (3, 4, 5, 6)) -> Reduction:
    """n, mean, std_dev and the standardised central moments of ``orders``: sums of powers about each part's own mean, which merge by the binomial formula."""
    top = max(orders, default=2)

    def update(state, table):
        x = table.column(value).to_numpy().astype(float)
        if not len(x):
            return state
        mean = float(x.mean())
        return merge(state, (len(x), mean, [float(((x - mean) ** k).sum()) for k in range(top + 1)]))

    def merge(a, b):
        if not a[0] or not b[0]:
            return a if a[0] else b
        n, apart = a[0] + b[0], b[1] - a[1]
        shifted = lambda s, by: [sum(comb(k, j) * s[2][k - j] * by**j for j in range(k + 1)) for k in range(top + 1)]
        sums = [x + y for x, y in zip(shifted(a, -apart * b[0] / n), shifted(b, apart * a[0] / n), strict=True)]
        return n, a[1] + apart * b[0] / n, sums

    def finish(state):
        n, mean, sums = state
        spread = np.sqrt(sums[2] / n) if n else 0.0
        return {"n": n, "mean": mean if n else None, "std_dev": float(spread) if n else None, **{f"m{k}": float(sums[k] / n / spread**k) if spread else None for k in orders}}

    schema = "n long, mean double, std_dev double" + "".join(f", m{k} double" for k in orders)
    return Reduction(lambda: (0, 0.0, [0.0] * (top + 1)), update, merge, finish, schema)


def range_hook(value: str = "x") -> Reduction:
    """least, most, last_idx."""

    def update(state, table):
        x = table.column(value).to_numpy()
        return merge(state, (float(x.min()), float(x.max()), int(table.column("sample_idx").to_numpy().max())))

    def merge(a, b):
        return b if a is None else a if b is None else (min(a[0], b[0]), max(a[1], b[1]), max(a[2], b[2]))

    return Reduction(lambda: None, update, merge, lambda s: {"least": s[0], "most": s[1], "last_idx": s[2]}, "least double, most double, last_idx long")


def histogram_hook(bins: int = 100, value: str = "x") -> Reduction:
    """counts (an array of ``bins``) between the columns least and most of the samples' rows, the last bin with its upper edge."""

    def update(state, table):
        x, low, high = (table.column(c).to_numpy() for c in (value, "least", "most"))
        width = (high[0] - low[0]) / bins
        place = np.minimum(np.floor((x - low) / width).astype(np.int64), bins - 1) if width else np.zeros(len(x), np.int64)
        return state + np.bincount(place, minlength=bins)

    return Reduction(lambda: np.zeros(bins, np.int64), update, lambda a, b: a + b, lambda s: {"counts": s.tolist()}, "counts array<long>")
