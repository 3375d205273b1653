"""Packing of documents into windows of at most ``window`` tokens by multiway Karmarkar-Karp differencing.

A document is its ids and then the end id. Whole windows are cut off its front; the rest, under one window, is cut into
pieces of ``piece`` tokens and a remainder: small against a window, and of many sizes, so differencing can even them out.
Pieces go to groups of about ``windows_per_group`` windows by a hash of their number in the table of pieces (so null or repeated ids make no large group), and each group is one task's work: partial
partitions with the largest imbalance are merged, the fullest window of one with the emptiest of the other, until one
partition is left. If a window then exceeds its capacity the group takes one window more and starts again.

Ids are made once and never shuffled: a piece's row holds its place, length and checksum. Windows are nearly even, so a
group's padding is about what the rounding up to whole windows leaves, half a window in ``windows_per_group``.

Cases: null and empty texts are the end id alone; texts of any length are cut; null doc_ids are packed like others; repeated rows as often as they
occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import written

WINDOW, PIECE, WINDOWS_PER_GROUP, END_ID = 2048, 256, 256, 1
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def cuts(n: int, window: int, piece: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens."""
    whole = n // window
    found = [(k * window, window) for k in range(whole)]
    found += [(at, min(piece, n - at)) for at in range(whole * window, n, piece)]
    return found


def pieces(docs: DataFrame, vocabulary: str, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID) -> DataFrame:
    """One row per piece of each text, from one pass over the texts."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.tokens import id_bytes, piece_ids

        ids, end = piece_ids(vocabulary, True), id_bytes([end_id])
        for batch in batches:
            out: list[list] = [[] for _ in range(5)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = memoryview(ids.of(text or "") + end)
                n = len(data) // 4
                for start, length in cuts(n, window, piece):
                    for column, value in zip(out, (doc_id, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, PIECE_SCHEMA)


def differencing(sizes: list[int], windows: int) -> list[int]:
    """The window of each piece by largest differencing over ``windows``-way partial partitions.

    A partial partition keeps only its windows that are not empty: (sums, one tree of pieces for each), fullest first.
    """
    import numpy as np

    if windows == 1:
        return [0] * len(sizes)
    trees: list[tuple] = [(k,) for k in range(len(sizes))]  # a leaf, or two trees that share a window
    heap = [(-s, k, np.array([s], np.int64), [k]) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, a, at = heapq.heappop(heap)
        _, _, b, bt = heapq.heappop(heap)
        both = len(a) + len(b) - windows
        if both <= 0:  # the fullest of each meet empty windows of the other
            sums, roots = np.concatenate([a, b]), at + bt
        else:  # a's emptiest windows take b's fullest: a descends, b's last ``both`` are its smallest
            meet_a, meet_b = a[len(a) - both :], b[len(b) - both :][::-1]
            roots = at[: len(a) - both] + bt[: len(b) - both]
            for x, y in zip(at[len(a) - both :], bt[len(b) - both :][::-1], strict=True):
                trees.append((x, y))
                roots.append(len(trees) - 1)
            sums = np.concatenate([a[: len(a) - both], b[: len(b) - both], meet_a + meet_b])
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], [roots[k] for k in order.tolist()]
        spread = int(sums[0]) - (int(sums[-1]) if len(sums) == windows else 0)
        heapq.heappush(heap, (-spread, fresh, sums, roots))
        fresh += 1
    window_of = [0] * len(sizes)
    for w, root in enumerate(heap[0][3] if heap else []):
        todo = [root]
        while todo:
            tree = trees[todo.pop()]
            if len(tree) == 1:
                window_of[tree[0]] = w
            else:
                todo += tree
    return window_of


def even_windows(sizes: list[int], window: int) -> list[int]:
    """The window of each piece; the number of windows rises until none holds more than ``window``."""
    count = -(-sum(sizes) // window)
    while sizes:
        window_of, held = differencing(sizes, count), [0] * count
        for w, s in zip(window_of, sizes, strict=True):
            held[w] += s
        if max(held) <= window:
            return window_of
        count += 1
    return []


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, piece: int = PIECE, end_id: int = END_ID, windows_per_group: int = WINDOWS_PER_GROUP) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece."""
    made = written(pieces(docs, vocabulary, window, piece, end_id).withColumn("piece", F.monotonically_increasing_id()), "pieces")
    total = made.agg(F.sum("length").alias("n")).first()["n"] or 0
    groups = max(1, round(total / (window * windows_per_group)))

    def place(table):
        import numpy as np
        import pyarrow as pa

        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        length = table.column("length").to_numpy()
        whole = length == window
        sequence = np.empty(len(length), np.int64)
        rest = np.flatnonzero(~whole)
        sequence[rest] = even_windows(length[rest].tolist(), window)
        first = int(sequence[rest].max()) + 1 if len(rest) else 0
        sequence[whole] = first + np.arange(int(whole.sum()))
        order = np.argsort(sequence, kind="stable")
        lengths, sequences = length[order], sequence[order]
        before = np.cumsum(lengths) - lengths
        starts = np.r_[True, sequences[1:] != sequences[:-1]]
        offset = np.empty(len(length), np.int64)
        offset[order] = before - np.maximum.accumulate(np.where(starts, before, 0))
        group = table.column("group").to_numpy() << 32
        return table.drop_columns(["group"]).append_column("sequence_id", pa.array(group + sequence)).append_column("offset", pa.array(offset))

    group = F.pmod(F.xxhash64("piece"), F.lit(groups)).alias("group")
    return made.select(*[c for c in made.columns if c != "piece"], group).groupBy("group").applyInArrow(place, f"{PIECE_SCHEMA}, sequence_id long, offset long")
