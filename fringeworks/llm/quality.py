"""Quality of documents: classifier evidence combined with host- and path-level posteriors by hierarchical empirical Bayes.

1. A logistic regression on shares of byte classes and word statistics of the whole text gives each document's evidence
   p. It is fitted in numpy on at most ``most_labels`` labelled documents (smallest hash of doc_id).
2. Grouped sums of p and p squared give each host's posterior mean, shrunk toward the global mean, and each path's, shrunk toward its
   host's. How strongly is estimated by moments: a prior is worth k = within / between documents, the variance of p within sites over that
   of the sites' means beyond it (analysis of variance with unequal group sizes). The less sites differ, the stronger.
3. A document's sites are taken without itself, so its evidence counts once; its log-odds swap the global prior for its path's
   posterior: logit q = logit p - logit global + logit path.

Sums leave one partial row per task and site, so a host with a third of all rows is no hot group; its posterior is joined
back (Spark broadcasts or splits that join by size).

Cases: null and empty texts have features of an empty text; null hosts and paths are sites of their own; labels without a
document or value are ignored, and a doc_id labelled twice counts by its mean; with fewer than two classes of labels p is
their rate, or 0.5; repeated rows are scored each (and learned from once); a path without other documents has its host's posterior, a host without others the
global one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import temporaries, written

MOST_LABELS, LEAST_QUALITY = 20_000, 0.5
#: Byte classes: upper, lower, digits, blanks, line feeds, not ASCII, and each ASCII mark.
_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def _classes() -> np.ndarray:
    kind = np.zeros(256, np.int64)
    for b in range(256):
        c = chr(b)
        kind[b] = 5 if b > 127 else 0 if c.isupper() else 1 if c.islower() else 2 if c.isdigit() else 4 if b == 10 else 6 + _MARKS.index(b) if b in _MARKS else 3
    return kind


def text_features(column) -> np.ndarray:
    """(texts, features) of an Arrow string column."""
    from fringeworks.llm.words import NOT_BLANK, numbered_words, slices

    kind, n_kinds = _classes(), 6 + len(_MARKS)
    out = np.zeros((len(column), n_kinds + 6))
    for row, data, bounds in slices(column):
        texts = len(bounds) - 1
        size = np.diff(bounds)
        text = np.repeat(np.arange(texts), size)
        shares = np.bincount(text * n_kinds + kind[data], minlength=texts * n_kinds).reshape(texts, n_kinds) / np.maximum(size, 1)[:, None]
        word, first = numbered_words(data, bounds, NOT_BLANK)
        n = np.diff(first)
        owner = np.repeat(np.arange(texts), n)
        order = np.lexsort((word, owner))
        distinct = np.bincount(owner[order][np.r_[True, (word[order][1:] != word[order][:-1]) | (owner[order][1:] != owner[order][:-1])]] if len(word) else owner, minlength=texts)
        twice = np.bincount(owner[1:][(word[1:] == word[:-1]) & (owner[1:] == owner[:-1])], minlength=texts)
        some = np.maximum(n, 1)
        own = out[row : row + texts]
        own[:, :n_kinds] = np.sqrt(shares)
        own[:, n_kinds:] = np.stack([distinct / some, twice / some, size / some / 10, np.log1p(n) / 5, distinct / np.sqrt(some) / 10, n == 0], 1)
    return out


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30):
    """(centre, scale, weights, bias) by Newton's method; weights 0 if the labels are all alike."""
    if not len(y) or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        width = x.shape[1]
        return np.zeros(width), np.ones(width), np.zeros(width), float(np.log(rate / (1 - rate)))
    centre, scale = x.mean(0), x.std(0) + 1e-3
    z = np.c_[np.clip((x - centre) / scale, -8, 8), np.ones(len(x))]
    w = np.zeros(z.shape[1])
    penalty = np.r_[np.full(len(w) - 1, ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(penalty), z.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return centre, scale, w[:-1], float(w[-1])


def _mapped(docs: DataFrame, columns: list[str], schema: str, made) -> DataFrame:
    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = text_features(b.column(len(columns)))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in range(len(columns))], made(x)], names=[c.split(" ")[0] for c in schema.split(", ")])

    return docs.select(*columns, "text").mapInArrow(run, schema)


def document_evidence(docs: DataFrame, labels: DataFrame, label: str = "quality", most_labels: int = MOST_LABELS) -> DataFrame:
    """doc_id, host, path, p: ``docs`` has host and path; ``labels`` has doc_id and ``label`` (0 or 1)."""
    import pyarrow as pa

    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.avg(label).alias("y"))
    chosen = known.join(docs.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labels)
    rows = docs.join(F.broadcast(chosen), "doc_id").withColumn("host", F.lit(None).cast("string"))
    listed = _mapped(rows, ["doc_id", "y"], "doc_id long, y double, x array<double>", lambda x: pa.array(list(x), pa.list_(pa.float64())))
    listed = listed.groupBy("doc_id").agg(F.first("y").alias("y"), F.min("x").alias("x")).toPandas().sort_values("doc_id")  # one row an id
    width = 12 + len(_MARKS)
    x = np.array(listed["x"].tolist()).reshape(-1, width)
    centre, scale, weights, bias = fit(x, (listed["y"].to_numpy(float) >= 0.5).astype(float))

    def probability(x):
        z = np.clip((x - centre) / scale, -8, 8) @ weights + bias
        return pa.array(1 / (1 + np.exp(-np.clip(z, -12, 12))))

    return _mapped(docs, ["doc_id", "host", "path"], "doc_id long, host string, path string, p double", probability)


def _strength(sites: DataFrame, group, total, n, prior) -> DataFrame:
    """One row, ``k``: how many documents the prior is worth; sites are rows with ``total`` and ``squares`` of p over n documents."""
    mean = total / n
    within = F.sum(F.col("squares") - total * mean) / F.greatest(F.sum(n) - F.count(F.lit(1)), F.lit(1))
    groups = F.count(F.lit(1)) - F.count_distinct(group)  # each group's prior takes one site's freedom
    spread = F.sum(n * (mean - prior) ** 2)
    weight = F.sum(n) - F.sum(n * n / F.col("of"))
    found = sites.agg(within.alias("within"), groups.alias("free"), spread.alias("spread"), weight.alias("weight"))
    between = (F.col("spread") - F.col("free") * F.col("within")) / F.col("weight")
    k = F.when((F.col("weight") > 0) & (between > 0), F.col("within") / between)
    return found.select(F.greatest(F.lit(0.01), F.least(F.lit(1e6), F.coalesce(k, F.lit(1e6)))).alias("k"))


def posteriors(evidence: DataFrame) -> DataFrame:
    """A row per path: host, path, overall, host_total, host_n, host_k, total, n, k."""
    paths = written(evidence.groupBy("host", "path").agg(F.sum("p").alias("total"), F.sum(F.col("p") * F.col("p")).alias("squares"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    overall = paths.agg((F.sum("total") / F.sum("n")).alias("overall"), F.sum("n").alias("of"))
    hosts = paths.groupBy("host").agg(*[F.sum(c).alias(c) for c in ("total", "squares", "n")]).crossJoin(F.broadcast(overall))
    host_k = _strength(hosts, F.lit(1), F.col("total"), F.col("n"), F.col("overall")).withColumnRenamed("k", "host_k")
    hosts = hosts.select(F.col("host").alias("_host"), "overall", F.col("total").alias("host_total"), F.col("n").alias("host_n"))
    joined = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host").withColumn("of", F.col("host_n"))
    k = _strength(joined, F.struct("host"), F.col("total"), F.col("n"), F.col("host_total") / F.col("host_n"))
    return joined.crossJoin(F.broadcast(host_k)).crossJoin(F.broadcast(k)).drop("squares", "of")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", least: float = LEAST_QUALITY) -> DataFrame:
    """doc_id, host, path, p, host_posterior, path_posterior, quality, keep: one row per document."""
    with temporaries(docs.sparkSession) as kept:
        evidence = kept(document_evidence(docs, labels, label), "evidence")
    return combined(evidence, least).select("doc_id", "host", "path", "p", "host_posterior", "path_posterior", "quality", "keep")


def combined(evidence: DataFrame, least: float = LEAST_QUALITY) -> DataFrame:
    """``evidence`` (host, path, p and others) with the posteriors of its sites without the row itself, quality and keep."""
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    sites = posteriors(evidence).withColumnsRenamed({"host": "_host", "path": "_path"})
    joined = evidence.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")))
    without = lambda total, n, k, prior: F.least(F.greatest((F.col(total) - F.col("p") + F.col(k) * F.col(prior)) / (F.col(n) - 1 + F.col(k)), F.lit(1e-6)), F.lit(1 - 1e-6))
    found = joined.withColumn("host_posterior", without("host_total", "host_n", "host_k", "overall")).withColumn("path_posterior", without("total", "n", "k", "host_posterior"))
    found = found.withColumn("quality", 1 / (1 + F.exp(-(logit("p") - logit("overall") + logit("path_posterior")))))
    return found.select(*evidence.columns, "host_posterior", "path_posterior", "quality", (F.col("quality") >= least).alias("keep"))
