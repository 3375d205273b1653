"""Benchmark decontamination with a distributed positional inverted index.

The index is a table of postings (term, document, ascending positions), written once to the shared folder in the order of
its terms, and a table of the documents with their numbers of words. For the contract query only those words are stored that a phrase
can need: words of the benchmark's vocabulary in unbroken runs as long as the shortest window; any occurrence of a window is such
a run. The vocabulary is broadcast only up to ``MOST_TERMS`` numbers of 8 bytes; beyond it every word is stored.

Search, from the rarest terms on: each window nominates its rarest term (by occurrences in the index); that term's postings, adjusted
by its offset, give alignments (item, document, first position). They are intersected with the lists of the window's second-rarest
term, and only what is left with those of the other words of these windows, by a join on (document, term). Ten matches in a row, or the
whole of a shorter item, are an occurrence. Nothing is done for each pair of items and documents. A hot term's postings lie in several
partitions of the index, and joins on them are split by Spark.

Words are compared as 64-bit numbers without structure (``words``): of 10 thousand item words and ten billion different words of
documents one pair in a hundred thousand such corpora is expected to share a number, and a window needs all its words to match.

Cases: null and empty texts have no words and no hits; an item without words is never found; items with a null id hit
words but are not listed; repeated document rows and null doc_ids each get their result; repeated items count once; empty tables work;
other columns are ignored, and one whose name starts with ``_fw_`` is refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fringeworks.llm.common import ROW, numbered, refuse_own, temporaries, written

#: Words of a window, terms of a vocabulary that is broadcast, probes that are broadcast.
WINDOW, MOST_TERMS, MOST_PROBES = 10, 4_000_000, 1_000_000
_INDEX = "row long, doc_id long, n_words long, terms array<long>, positions array<array<int>>"


@dataclass
class Index:
    docs: DataFrame  # row, doc_id, n_words
    postings: DataFrame  # term, row, positions


def item_words(items: DataFrame, id_column: str = "item_id") -> DataFrame:
    """item (number of the row), item_id, q, term, n: one row per word of each item."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from fringeworks.llm.words import LETTERS_DIGITS, numbered_words, slices

        for b in batches:
            for row, data, bounds in slices(b.column(2)):
                term, first = numbered_words(data, bounds, LETTERS_DIGITS)
                count = np.diff(first)
                take = pa.array(np.repeat(np.arange(row, row + len(count)), count))
                q = np.arange(len(term)) - np.repeat(first[:-1], count)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(take), b.column(1).take(take), pa.array(q.astype(np.int32)), pa.array(term.view(np.int64)), pa.array(np.repeat(count, count))],
                    names=["item", "item_id", "q", "term", "n"],
                )

    rows = items.select(F.monotonically_increasing_id().alias("item"), F.col(id_column).cast("string").alias("item_id"), "text")
    return written(rows.mapInArrow(run, "item long, item_id string, q int, term long, n long"), "items")


def vocabulary_of(items: DataFrame, most: int = MOST_TERMS):
    """The sorted numbers of all item words, or None if there are more than ``most``."""
    import numpy as np

    terms = items.select("term").distinct()
    if terms.count() > most:
        return None
    return np.sort(terms.toArrow().column("term").to_numpy().astype(np.int64).view(np.uint64))


def build_index(docs: DataFrame, vocabulary=None, run: int = 1) -> Index:
    """The index of ``docs``, numbered by their column ``_fw_row`` or else here. With a vocabulary only its terms are stored, and only in runs of at least ``run`` of them."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def index(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from fringeworks.llm.words import LETTERS_DIGITS, numbered_words, slices
        from fringeworks.llm.worker import kept

        kept("postings")
        known = sent.value
        if known is not None:
            maybe = np.zeros(1 << 20, bool)
            maybe[known & np.uint64((1 << 20) - 1)] = True
        for b in batches:
            for row, data, bounds in slices(b.column(2)):
                term, first = numbered_words(data, bounds, LETTERS_DIGITS)
                count = np.diff(first)
                doc = np.repeat(np.arange(len(count)), count)
                if known is None:
                    at = np.arange(len(term))
                else:
                    has = maybe[term & np.uint64((1 << 20) - 1)]
                    at = np.flatnonzero(has)
                    place = np.searchsorted(known, term[at])
                    at = at[known[np.minimum(place, len(known) - 1)] == term[at]] if len(known) else at[:0]
                    broken = np.r_[True, (np.diff(at) != 1) | (np.diff(doc[at]) != 0)] if len(at) else np.empty(0, bool)
                    start = np.flatnonzero(broken)
                    long_enough = np.diff(np.r_[start, len(at)]) >= run
                    at = at[np.repeat(long_enough, np.diff(np.r_[start, len(at)]))]
                order = np.lexsort((at, term[at], doc[at]))
                at = at[order]
                d, t = doc[at], term[at]
                new = np.r_[True, (d[1:] != d[:-1]) | (t[1:] != t[:-1])] if len(at) else np.empty(0, bool)
                heads = np.flatnonzero(new)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[heads, len(at)].astype(np.int32)), pa.array((at - first[d]).astype(np.int32)))
                ends = pa.array(np.searchsorted(d[heads], np.arange(len(count) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(row, len(count)), b.column(1).slice(row, len(count)), pa.array(count), pa.ListArray.from_arrays(ends, pa.array(t[heads].view(np.int64))), pa.ListArray.from_arrays(ends, lists)],
                    names=[x.split(" ")[0] for x in _INDEX.split(", ")],
                )

    rows = docs if ROW in docs.columns else docs.withColumn(ROW, F.monotonically_increasing_id())
    made = written(rows.select(ROW, "doc_id", "text").mapInArrow(index, _INDEX), "terms")
    lists = made.select("row", F.explode(F.arrays_zip("terms", "positions")).alias("p")).select(F.col("p.terms").alias("term"), "row", F.col("p.positions").alias("positions"))
    # by term, and within a hot term by document
    return Index(made.select("row", "doc_id", "n_words"), written(lists.repartitionByRange("term", "row").sortWithinPartitions("term", "row"), "postings"))


def _known(index: Index, items: DataFrame) -> DataFrame:
    """term, known: occurrences in the index of the items' terms."""
    wanted = items.select("term").distinct()
    return written(index.postings.join(wanted, "term", "left_semi").groupBy("term").agg(F.sum(F.size("positions")).alias("known")), "known")


def _few(probes: DataFrame) -> DataFrame:
    probes = written(probes, "probes")
    return F.broadcast(probes) if probes.count() <= MOST_PROBES else probes


def alignments(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item, row, d, low, high: where the two rarest terms of windows put the item's first word in a document; the windows' words are low to high."""
    ahead = Window.partitionBy("item").orderBy("q").rowsBetween(0, window - 1)
    here = F.struct(F.coalesce("known", F.lit(0)).alias("known"), F.col("q").alias("at"), "term")
    probes = items.join(_known(index, items), "term", "left").withColumn("rarest", F.sort_array(F.collect_list(here).over(ahead)))
    probes = probes.where(F.col("q") <= F.greatest(F.col("n") - window, F.lit(0))).where("rarest[0].known > 0")
    probes = probes.select("item", "q", "n", F.col("rarest")[0].alias("one"), F.get("rarest", F.lit(1)).alias("two"))
    probes = probes.groupBy("item", F.col("one.term").alias("term"), F.col("one.at").alias("at"), F.col("two.term").alias("term2"), F.col("two.at").alias("at2"))
    probes = _few(probes.agg(F.min("q").alias("low"), F.least(F.max("q") + window, F.max("n")).alias("high")))
    first = index.postings.join(probes, "term").select("item", "row", "at", "term2", "at2", "low", "high", F.explode("positions").alias("p"))
    first = first.select("item", "row", (F.col("p") - F.col("at")).alias("d"), "term2", "at2", "low", "high").where("d + low >= 0")
    alone = first.where("term2 is null")
    second = first.where("term2 is not null").join(index.postings.withColumnRenamed("term", "term2"), ["row", "term2"])
    second = second.where(F.array_contains("positions", (F.col("d") + F.col("at2")).cast("int")))
    columns = ["item", "row", "d", "low", "high"]
    return alone.select(*columns).unionByName(second.select(*columns)).distinct()


def phrase_matches(index: Index, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, item, item_id, begin, length: every longest stretch in which windows of the item occur."""
    expected = alignments(index, items, window).join(items, "item").where("q >= low and q < high").select("item", "item_id", "row", "d", "q", "term", "n").distinct()
    found = expected.join(index.postings, ["row", "term"]).where(F.array_contains("positions", (F.col("q") + F.col("d")).cast("int")))
    along = Window.partitionBy("row", "item", "d").orderBy("q")
    runs = found.withColumn("run", F.col("q") - F.row_number().over(along)).groupBy("row", "item", "d", "run")
    runs = runs.agg(F.min("q").alias("q"), F.count(F.lit(1)).alias("length"), F.first("n").alias("n"), F.first("item_id").alias("item_id"))
    return runs.where(F.col("length") >= F.least("n", F.lit(window))).select("row", "item", "item_id", (F.col("q") + F.col("d")).alias("begin"), "length")


def near_alignments(index: Index, items: DataFrame, slop: int, share: float) -> DataFrame:
    """item, row, d: every place of the item's first word at which ``share`` of its words can lie within ``slop`` of theirs.

    Of n words at most n - ceil(share n) may be away, so one of the rarest n - ceil(share n) + 1 is there; those that the index doesn't know are the rarest.
    """
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.coalesce("known", F.lit(0)), "q"))
    probes = items.join(_known(index, items), "term", "left").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1)
    at = _few(probes.where("known > 0").select("item", "q", "term")).join(index.postings, "term").select("item", "row", "q", F.explode("positions").alias("p"))
    return at.select("item", "row", F.explode(F.sequence(F.col("p") - F.col("q") - slop, F.col("p") - F.col("q") + slop)).alias("d")).distinct()


def proximity_matches(index: Index, items: DataFrame, slop: int = 5, share: float = 0.8) -> DataFrame:
    """row, item, item_id, d, n_terms: all alignments at which ``share`` (above 0) of the item's words lie within ``slop`` of their place.

    It needs an index with all positions of the vocabulary (``run=1``).
    """
    expected = near_alignments(index, items, slop, share).join(items, "item").select("item", "item_id", "row", "d", "q", "term", "n")
    near = F.exists("positions", lambda p: F.abs(p - F.col("q") - F.col("d")) <= slop)
    found = expected.join(index.postings, ["row", "term"]).where(near).groupBy("row", "item", "d")
    found = found.agg(F.count(F.lit(1)).alias("n_terms"), F.first("n").alias("n"), F.first("item_id").alias("item_id"))
    return found.where(F.col("n_terms") >= share * F.col("n")).drop("n")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """row, doc_id, n_words, n_hit, n_items, items_sha256, contaminated: one row per document."""
    with temporaries(docs.sparkSession) as kept:
        return kept(_contamination(refuse_own(docs), benchmark, window), "contamination")


def _contamination(rows: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    items = item_words(benchmark)
    shortest = items.agg(F.min("n")).first()[0]
    index = build_index(rows, vocabulary_of(items), min(window, shortest or window))
    found = written(phrase_matches(index, items, window), "matches")
    hits = found.select("row", F.explode(F.sequence("begin", F.col("begin") + F.col("length") - 1)).alias("p")).distinct()
    hits = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_hit"))
    named = found.groupBy("row").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    none = F.array().cast("array<string>")
    result = index.docs.join(hits, "row", "left").join(named, "row", "left")
    return result.select(
        "row", "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("ids", none), ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` without the documents in which a window of a benchmark item occurs; columns as given."""
    rows = numbered(docs)
    with temporaries(docs.sparkSession) as kept:
        hit = kept(_contamination(rows, benchmark, window).where("contaminated").select(F.col("row").alias(ROW)), "contaminated")
    return rows.join(hit, ROW, "left_anti").drop(ROW)
