"""Language identification by a byte convolutional network, trained and applied in numpy.

Filters of several widths run over the bytes of fixed-length windows; each filter keeps its largest response, and a
softmax layer turns the responses into language probabilities. A document's probabilities are the mean over all windows of
its whole text, weighted by their bytes. Training needs a bounded sample: at most ``per_lang`` labelled documents for each
label (those with the smallest hash of doc_id), at most ``most`` over all labels in equal shares, and at most ``WINDOWS`` windows spread over each; only
these windows reach the driver, 16 MB at most. Of more than ``most`` labels the most frequent are learned, ties by name. The trained filters are folded into tables over byte pairs, so a window costs five table rows for each byte.

Cases: ``und`` with score 0 if a text is null or has no letter, or if there was nothing to learn from; empty and very long
texts, repeated rows and an empty table need nothing special, and of rows with the same doc_id one is learned from; null doc_ids are
never learned from and not held out. ``keep_identified`` refuses columns that start with ``_fw_``; others pass through.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.llm.common import ROW, numbered, temporaries, written

#: Bytes in a window, filters for each width, and the bounds of the training sample: documents of a label and in all, windows of a document.
WINDOW, WIDTHS, FILTERS, PER_LANG, MOST_SAMPLED, WINDOWS = 256, (2, 3, 4), 16, 400, 16_000, 4
UNKNOWN = "und"


@dataclass
class Network:
    langs: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    dense: np.ndarray  # (widths * FILTERS, langs)
    bias: np.ndarray

    def tables(self) -> list[tuple[np.ndarray, np.ndarray | None]]:
        """For each width the responses to the first byte pair, and to what follows it: a byte or a pair."""
        pair = lambda f: (f[0][:, None, :] + f[1][None, :, :]).reshape(65536, -1).astype(np.float32)
        return [(pair(f), None if len(f) == 2 else f[2].astype(np.float32) if len(f) == 3 else pair(f[2:])) for f in self.filters]


def windows_of(data: bytes, window: int) -> np.ndarray:
    """The bytes as rows of ``window``, the last filled with zeros."""
    rows = max(1, -(-len(data) // window))
    flat = np.zeros(rows * window, np.uint8)
    flat[: len(data)] = np.frombuffer(data, np.uint8)
    return flat.reshape(rows, window)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(rows: list[tuple[str, bytes]], window: int = WINDOW, epochs: int = 12, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Adam on the cross entropy; a filter's gradient goes only to the bytes under its largest response."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for lang, _ in rows})
    filters = [rng.normal(0, 0.1, (w, 256, FILTERS)) for w in WIDTHS]
    net = Network(langs, filters, rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))), np.zeros(len(langs)))
    if len(langs) < 2:
        return net
    x = np.concatenate([windows_of(data[:window], window) for _, data in rows])
    y = np.array([langs.index(lang) for lang, _ in rows])
    # rare labels count as much as frequent ones; every third window is cut short, as the last of a text is
    weight = (len(y) / len(langs) / np.bincount(y, minlength=len(langs)))[y]
    values = [*filters, net.dense, net.bias]
    first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            k = order[at : at + batch]
            xb = x[k].copy()
            for r in range(0, len(k), 3):
                xb[r, rng.integers(8, window) :] = 0
            pooled, where = [], []
            for f in filters:
                width = len(f)
                out = sum(f[j][xb[:, j : window - width + 1 + j]] for j in range(width))
                where.append(out.argmax(1))
                pooled.append(np.maximum(out.max(1), 0))
            h = np.concatenate(pooled, 1)
            p = _softmax(h @ net.dense + net.bias)
            p[np.arange(len(k)), y[k]] -= 1
            p *= weight[k][:, None] / len(k)
            back = (p @ net.dense.T) * (h > 0)
            grads = []
            for i, f in enumerate(filters):
                g, part = np.zeros_like(f), back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(len(f)):
                    np.add.at(g[j], (xb[np.arange(len(k))[:, None], where[i] + j], np.arange(FILTERS)[None, :]), part)
                grads.append(g)
            grads += [h.T @ p + 1e-4 * net.dense, p.sum(0)]
            step += 1
            for v, g, m, s in zip(values, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def probabilities(net: Network, tables, x: np.ndarray) -> np.ndarray:
    """Of the windows ``x``: (windows, langs)."""
    pooled = np.empty((len(x), len(net.dense)), np.float32)
    for at in range(0, len(x), 64):
        part = x[at : at + 64]
        pairs = (part[:, :-1].astype(np.int32) << 8) | part[:, 1:]
        for i, (head, tail) in enumerate(tables):
            n = x.shape[1] - WIDTHS[i] + 1
            out = head.take(pairs[:, :n], 0)
            if tail is not None:
                out += tail.take(part[:, 2:] if len(tail) == 256 else pairs[:, 2:], 0)
            pooled[at : at + 64, i * FILTERS : (i + 1) * FILTERS] = out.max(1)
    return _softmax(np.maximum(pooled, 0) @ net.dense + net.bias)


def sample(docs: DataFrame, train_rows, per_lang: int = PER_LANG, window: int = WINDOW, most: int = MOST_SAMPLED) -> list[tuple[str, bytes]]:
    """At most ``per_lang`` documents of each label under the condition ``train_rows``, and ``most`` in all, as at most WINDOWS windows each."""
    labelled = docs.where(train_rows & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    # counts first, sent to all tasks: then only some more rows of a label than are wanted meet in a task, whatever its share
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)
    counts = written(labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("_li_n")), "labels")
    labels = counts.count()
    if labels > most:
        counts = counts.orderBy(F.desc("_li_n"), "lang").limit(most)
    per_lang = max(1, min(per_lang, most // max(1, labels)))
    few = labelled.select("doc_id", "lang", draw.alias("draw")).join(F.broadcast(counts), "lang").where(F.col("draw") * F.col("_li_n") < 4 * per_lang + 16)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id"))
    chosen = few.groupBy("lang", "doc_id").agg(F.min("draw").alias("draw")).withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id").distinct()

    def spread(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], [], []]
            for doc_id, lang, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                data = (text or "").encode()
                room = max(0, len(data) - window)
                for k, start in enumerate(sorted({room * k // max(1, WINDOWS - 1) for k in range(WINDOWS)})):
                    for column, value in zip(out, (doc_id, k, lang, data[start : start + window]), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.string(), pa.binary()), strict=True)], names=["doc_id", "k", "lang", "data"])

    rows = labelled.select("doc_id", "lang", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(spread, "doc_id long, k int, lang string, data binary")
    rows = rows.groupBy("doc_id", "k").agg(F.min(F.struct("lang", "data")).alias("one"))  # however often an id is repeated
    return [(r["lang"], bytes(r["data"])) for r in rows.select("one.lang", "one.data", "doc_id", "k").orderBy("lang", "doc_id", "k").collect()]


def predict(docs: DataFrame, net: Network, key: str, window: int = WINDOW) -> DataFrame:
    """``key`` (a column of ``docs``), lang_pred, score: nothing but the key and the text goes to the workers."""
    sent, mark = docs.sparkSession.sparkContext.broadcast(net), uuid.uuid4().hex
    kind = dict(docs.dtypes)[key]

    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        net = sent.value
        tables = kept(mark, net.tables)
        for b in batches:
            lang, score = [UNKNOWN] * b.num_rows, [0.0] * b.num_rows
            held: list[tuple[int, bytes]] = []

            def settle(held, lang, score):
                parts = [windows_of(data, window) for _, data in held]
                p = probabilities(net, tables, np.concatenate(parts))
                sizes = np.concatenate([[window] * (len(x) - 1) + [len(d) - window * (len(x) - 1)] for x, (_, d) in zip(parts, held, strict=True)])
                begins = np.cumsum([0, *[len(x) for x in parts[:-1]]])
                mean = np.add.reduceat(p * sizes[:, None], begins) / np.add.reduceat(sizes, begins)[:, None]
                for (row, _), m in zip(held, mean, strict=True):
                    best = int(m.argmax())
                    lang[row], score[row] = net.langs[best], float(min(1.0, m[best]))

            size = 0
            if net.langs:
                for row, (text, letter) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                    if letter:
                        held.append((row, text.encode()))
                        size += len(held[-1][1])
                    if size > 1 << 20:
                        settle(held, lang, score)
                        held, size = [], 0
                if held:
                    settle(held, lang, score)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[key, "lang_pred", "score"])

    rows = docs.select(key, "text", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter"))
    return rows.mapInArrow(run, f"{key} {kind}, lang_pred string, score double")


def held_out(column: str = "doc_id", fold: int = 2):
    """Documents that are never learned from: crc32 of the id as text, modulo 4."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 4 == fold, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    net = train(sample(docs, ~held_out()))
    return predict(docs, net, "doc_id").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """``docs`` without those whose language is unknown or less likely than ``least``; columns as given."""
    rows = numbered(docs)
    with temporaries(docs.sparkSession):
        net = train(sample(rows, ~held_out()))
    unknown = written(predict(rows, net, ROW).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least)).select(ROW), "unknown")
    return rows.join(unknown, ROW, "left_anti").drop(ROW)
