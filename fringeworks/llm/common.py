"""What the training-data operators share: the shared work folder, written tables, numbered rows."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of this prefix are the operators' own; an input that has one is refused.
OWN = "_fw_"
ROW = OWN + "row"
#: Bytes of text behind one bucket of a shuffle that a Python worker reads as a whole.
BUCKET_TEXT = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``; where it is unset, a temporary one, but only on a local master."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-fringeworks-")
        spark.conf.set("spark.checkpoint.dir", known)
    return known.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


class _Open(threading.local):
    def __init__(self):
        self.made: list[list[str]] = []  # for each open ``temporaries`` of the thread, what was written in it


_OPEN = _Open()


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    if _OPEN.made:
        _OPEN.made[-1].append(path)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def temporaries(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables written inside are deleted at the end, but for those written by the function that this gives."""

    def kept(df: DataFrame, name: str) -> DataFrame:
        out = written(df, name)
        path = _OPEN.made[-1].pop()
        if len(_OPEN.made) > 1:  # a step's result goes when what it is a step of has ended
            _OPEN.made[-2].append(path)
        return out

    _OPEN.made.append([])
    try:
        yield kept
    finally:
        for path in _OPEN.made.pop():
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def refuse_own(docs: DataFrame) -> DataFrame:
    if own := [c for c in docs.columns if c.lower().startswith(OWN)]:
        raise ValueError(f"columns that start with {OWN} are reserved: {own}")
    return docs


def numbered(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` (or its ``columns``) with a number for each row, written once.

    Whatever joins on the number later reads this table, so all jobs see the same numbers, however the input is planned
    or recomputed.
    """
    refuse_own(docs)
    rows = docs.select(*columns) if columns else docs
    return written(rows.withColumn(ROW, F.monotonically_increasing_id()), "numbered")


def text_size(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def buckets_of(spark: SparkSession, size: int, share: float = 1.0) -> int:
    """Buckets of a shuffle of ``size`` bytes of text: one for each BUCKET_TEXT / ``share``, at least ``spark.sql.shuffle.partitions``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(share * size / BUCKET_TEXT))


def buckets_for(docs: DataFrame, share: float = 1.0) -> int:
    return buckets_of(docs.sparkSession, text_size(docs), share)


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col), F.lit(""))
