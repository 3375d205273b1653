"""Captures as tables of ranges: many files by globs and dates, read in bounded ranges of samples that Spark deals out.

Files are listed by Spark's ``binaryFile`` source without their content, so any of its file systems will do and no file is
too long. What is to be read is a table (path, length and perhaps start_idx and end_idx); each row becomes ranges of
``block`` samples, and only these bytes are read. Windows of a catalog go to the files that way: nothing outside them is read.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.sources.catalog import file_meta
from fringeworks.sources.phase_trace import BLOCK, HEADERS_A_TASK, header_words, name_of
from fringeworks.sources.work import stored

_WORDS = "trace_id string, sample_idx long, word long"
_HEADERS = "trace_id string, header string, n_samples long, error string"
#: Ranges that a task reads at most, and words of a batch: short captures share both.
RANGES_A_TASK, BATCH = 1000, 1 << 17


def listed(files: DataFrame) -> DataFrame:
    """path and length of a ``binaryFile`` scan, listed once: Spark deals it a few files a task, of which there is nothing to read."""
    tasks = 2 * files.sparkSession.sparkContext.defaultParallelism
    return stored(files.select("path", "length").coalesce(tasks), "files")


def dealt(ranges: DataFrame, words: Column) -> DataFrame:
    """``ranges`` dealt out evenly, whatever file they are of: about BLOCK ``words`` and at most RANGES_A_TASK ranges a task, so long ones are a task each and short ones share it."""
    number, total = ranges.agg(F.count(F.lit(1)), F.sum(words)).first()
    return ranges.repartition(max(1, -(-number // RANGES_A_TASK), -(-(total or 0) // BLOCK)))


def list_captures(spark: SparkSession, folders: str | list[str], globs: str | list[str] = "*.bin", recorded_from: str | None = None, recorded_to: str | None = None) -> DataFrame:
    """path, length, recorded_local of the files under ``folders`` whose name matches any of ``globs``, recorded from (included) to (not included) by their names.

    Names are matched here, as Hadoop's own globs don't take the colons of a recording time. Without dates files whose name has none are listed too.
    The folders are listed once, now.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders)
    files = listed(files).distinct()
    name = F.regexp_extract(F.url_decode(F.regexp_replace("path", "[+]", "%2B")), "[^/]*$", 0)
    patterns = [fnmatch.translate(g) for g in ([globs] if isinstance(globs, str) else globs)]
    found = file_meta(files.where(reduce(Column.__or__, [name.rlike(f"^{p}") for p in patterns]))).select("path", "length", "recorded_local")
    if recorded_from is not None:
        found = found.where(F.col("recorded_local") >= F.lit(recorded_from).cast("timestamp_ntz"))
    if recorded_to is not None:
        found = found.where(F.col("recorded_local") < F.lit(recorded_to).cast("timestamp_ntz"))
    return found


def _open(path: str):
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))
    return system.open_input_file(name)


def read_headers(files: DataFrame) -> DataFrame:
    """trace_id, header, n_samples, error: a row per file of ``files`` (path, length), many files a task."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for path, length in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with _open(path) as f:
                    head = header_words(f.read_at(min(8, length), 0))
                    text = f.read_at(8 * head - 8, 8).rstrip(b"\0").decode("utf-8", "replace") if head else None
                error = "not a trace" if head is None else "bytes left over" if length % 8 else None
                for column, value in zip(out, (name_of(path), text, length // 8 - head if head else None, error), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], names=[x.split(" ")[0] for x in _HEADERS.split(", ")])

    tasks = max(1, -(-files.count() // HEADERS_A_TASK))
    return files.select("path", "length").repartition(tasks).mapInArrow(run, _HEADERS)


def read_ranges(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """trace_id, sample_idx, word of ``files``: whole, or from start_idx to end_idx (not included) where they have these columns.

    Files that are no traces give no rows; ``read_headers`` tells them.
    """
    bounded = {"start_idx", "end_idx"} <= set(files.columns)
    low = F.greatest(F.col("start_idx"), F.lit(0)) if bounded else F.lit(0)
    words = F.expr("length div 8")
    high = F.least(F.col("end_idx"), words) if bounded else words
    spans = files.select("path", "length", low.cast("long").alias("low"), high.cast("long").alias("high")).where("low < high")
    ranges = spans.select("path", "length", "high", F.explode(F.sequence("low", F.col("high") - 1, F.lit(block).cast("long"))).alias("first"))
    ranges = ranges.select("path", "length", "first", F.least(F.col("first") + block, F.col("high")).alias("end"))

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def table(found):
            names = pa.DictionaryArray.from_arrays(pa.array(np.repeat(np.arange(len(found), dtype=np.int32), [len(x[2]) for x in found])), pa.array([x[0] for x in found])).cast(pa.string())
            return pa.RecordBatch.from_arrays([names, pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))], names=["trace_id", "sample_idx", "word"])

        held, room = [], BATCH
        for b in batches:
            for path, length, first, end in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                with _open(path) as f:
                    head = header_words(f.read_at(min(8, length), 0))
                    end = min(end, length // 8 - (head or 0))
                    while head is not None and first < end:
                        n = min(room, end - first)
                        held.append((name_of(path), np.arange(first, first + n), np.frombuffer(f.read_at(8 * n, 8 * (head + first)), "<i8")))
                        first, room = first + n, room - n
                        if not room:
                            yield table(held)
                            held, room = [], BATCH
        if held:
            yield table(held)

    return dealt(ranges, F.col("end") - F.col("first")).mapInArrow(run, _WORDS)
