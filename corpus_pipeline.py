"""The corpus pipeline: language ID, exact dedup, near dedup, decontamination, packing, each on what the one before kept.

A stage is ``f(spark, docs, sf_dir) -> DataFrame``. All but the last return the columns of ``documents``; what a stage
drops is gone for the next:

1. ``language``: documents without a letter, or whose best language is less likely than 0.5, go.
2. ``exact``: of equal texts the one with the largest doc_id stays.
3. ``near``: of documents linked by a Jaccard similarity of 0.8 or more on five-word shingles the one with the smallest
   doc_id stays.
4. ``benchmark``: documents in which ten words of a benchmark item stand in a row (or a whole shorter item) go.
5. ``pack``: one row per piece of a document in windows of 2048 tokens.

Each stage's table is written as Parquet to the shared folder and read again; a stage reads its input once into a table of numbered
rows, so that what it decides and what it keeps are the same rows.

Cases: null texts are empty and go with the language stage, as do those without a letter; rows with a null doc_id are kept or dropped like others
(of equal or near texts a row with an id is preferred); repeated rows are equal texts, of which one stays; further columns pass through all
stages but the last, and one whose name starts with ``_fw_`` is refused; an empty table passes through as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fringeworks.llm.common import table, temporaries
from fringeworks.llm.decontamination import drop_contaminated
from fringeworks.llm.exact_dedup import drop_exact_copies
from fringeworks.llm.jaccard_join import drop_near_copies
from fringeworks.llm.language_id import keep_identified
from fringeworks.llm.packing import pack
from fringeworks.llm.queries import vocabulary


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5, num=80, den=100)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [("language", language), ("exact", exact), ("near", near), ("benchmark", benchmark), ("pack", packing)]

#: Learned predictions and subword ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporaries(spark) as kept:  # what the stage has written goes when its result stands
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
