"""The folder that all executors share, and tables kept there between steps."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; a temporary one only on a local master without it."""
    known = spark.conf.get("spark.checkpoint.dir", None)
    if not known:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        known = "file://" + tempfile.mkdtemp(prefix="spark-fringeworks-")
    return f"{known.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Rows that a task sorts at once, about.
ROWS_A_TASK = 1 << 18


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of about ``rows`` rows, dealt by ``keys`` to tasks of about ROWS_A_TASK rows: what a task sorts doesn't grow with the input.

    Without the number of tasks Spark brings parts together by their compressed size, and sorted indices and counters shrink to a few bytes a row.
    """
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_A_TASK)), *keys)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: its lineage ends here, and a lost executor costs a read."""
    path = work_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
