"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. One narrow pass over the texts writes (row, doc_id, SHA-256) to the shared folder; later steps never touch text. Where rows
   are to be dropped, the table is first written once with the numbers of its rows, so no second job can number them anew.
2. ``DataFrame.stat.freqItems`` (the Misra-Gries summary of Karp, Shenker and Papadimitriou, merged over tasks) proposes
   at most ``1 / support`` frequent digests; an exact count verifies them. Its partial sums leave one row a task.
3. The verified winners, at most ``1 / support`` rows of known width, are broadcast: rows of frequent digests are
   settled in the map task that reads them and never shuffled.
4. All other digests, none above ``support`` of the rows, take an ordinary partial aggregation and a join.

Cases: a null text counts as empty; of equal texts the row with the largest doc_id stays (null ids rank lowest), and of
rows repeated with the same id exactly one; an empty table gives an empty result; other columns are left alone, and a
column of the input whose name starts with ``_fw_`` is refused.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import ROW, numbered, refuse_own, temporaries, text_or_empty, written

#: A digest is frequent above this share of the rows; 1 / SUPPORT bounds what is broadcast.
SUPPORT = 0.001


def decisions(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """One row per document: _fw_row, doc_id, keep_id, group_size, kept, text_sha256."""
    return _decided(refuse_own(docs).withColumn(ROW, F.monotonically_increasing_id()), support)


def _decided(rows: DataFrame, support: float) -> DataFrame:
    narrow = written(rows.select(ROW, "doc_id", F.sha2(text_or_empty(), 256).alias("text_sha256")), "digests")
    last = F.max(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id", ROW)).alias("last")
    size = F.count(F.lit(1)).alias("group_size")

    frequent = narrow.stat.freqItems(["text_sha256"], support).select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    rows = narrow.agg((F.count(F.lit(1)) * support).alias("least"))
    winners = written(
        narrow.join(F.broadcast(frequent), "text_sha256").groupBy("text_sha256").agg(last, size)
        .crossJoin(F.broadcast(rows)).where("group_size >= least and group_size > 1").drop("least"),
        "frequent",
    )
    hot = narrow.join(F.broadcast(winners), "text_sha256")
    cold = narrow.join(F.broadcast(winners.select("text_sha256")), "text_sha256", "left_anti")
    cold = cold.join(cold.groupBy("text_sha256").agg(last, size), "text_sha256")
    return hot.unionByName(cold).select(
        ROW, "doc_id", F.col("last.doc_id").alias("keep_id"), "group_size", (F.col(ROW) == F.col(f"last.{ROW}")).alias("kept"), "text_sha256",
    )


def drop_exact_copies(docs: DataFrame, support: float = SUPPORT) -> DataFrame:
    """``docs`` with one row of each group of equal texts, columns as given."""
    rows = numbered(docs)
    with temporaries(docs.sparkSession) as kept:
        dropped = kept(_decided(rows, support).where(~F.col("kept")).select(ROW), "copies")
    return rows.join(dropped, ROW, "left_anti").drop(ROW)
