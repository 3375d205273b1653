"""Stand-ins for traces, catalogs and spectra on the driver's tables: the same SQL text in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.sources.work import spread

#: ``{lineitem}`` and so on are the tables.
WORDS = """
select trace_id, sample_idx, m_true, m16*281474976710656 + (i & 16777215)*16777216 + (q & 16777215) as word
from (select *, ((m_true+32768) % 65536) - 32768 as m16
      from (select cast(l_suppkey as bigint) as trace_id, k as sample_idx, k*3000 as m_true,
                   cast(round((l_quantity-25.5)*200000) as bigint) as i, cast(round(l_extendedprice*100) as bigint) - 5250000 as q
            from (select *, cast(row_number() over (partition by l_suppkey order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as bigint) as k
                  from {lineitem}) a) b) c
"""
SIGNAL = "select user_id as trace_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as sample_idx, value as x from {events}"
SWEEP = "select cast(l_linenumber as int) as i, cast(l_suppkey % 5 as int) as j, l_extendedprice as x from {lineitem}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _by(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` dealt by the key that the SQL numbers them by, as many tasks as they need."""
    return spread(rows, rows.count(), key)


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(WORDS, lineitem=_by(table(spark, sf_dir, "lineitem"), "l_suppkey"))


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SIGNAL, events=_by(table(spark, sf_dir, "events"), "user_id"))


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SWEEP, lineitem=table(spark, sf_dir, "lineitem"))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label, n, x: a vector is a frame of 64 samples."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("n", "x")).withColumn("x", F.col("x").cast("double"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("samples"))


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, start_ns, end_ns, interval_ns: an order lasts as many seconds as it cost."""
    start = F.unix_micros(F.col("o_orderdate").cast("timestamp")) * 1000
    orders = table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("trace_id"), start.alias("start_ns"), (start + F.round(F.col("o_totalprice") * 1000).cast("long") * 1000000).alias("end_ns"), F.lit(1000000000).cast("long").alias("interval_ns"))


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """trace_id, header, n_samples, path: captures of 1024 (k + 1) words at skip k, k = order key mod 8."""
    k = F.col("o_orderkey") % 8
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    text = F.concat(F.lit("# command line: ./board -q "), (1024 * (k + 1)).cast("string"), F.lit(" -s "), k.cast("string"), F.lit(" -l -b -v 3\n# recording start: "), stamp, F.lit(" +0800\n"))
    path = F.concat(F.lit("/captures/"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("_s"), k.cast("string"), F.lit("_q"), (1024 * (k + 1)).cast("string"), F.lit("_laser2_20km.bin"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trace_id"), text.alias("header"), (1000 * (k + 1)).alias("n_samples"), path.alias("path"))


def spectrum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bin_start, freq_idx, mean_db, std_db: 15-minute bins of events."""
    start = F.window(F.col("ts").cast("timestamp"), "15 minutes")["start"].cast("timestamp_ntz")
    rows = table(spark, sf_dir, "events").select(start.alias("bin_start"), (F.col("user_id") % 8).cast("int").alias("freq_idx"), (F.col("value") / 10).alias("db"))
    return rows.groupBy("bin_start", "freq_idx").agg(F.avg("db").alias("mean_db"), F.stddev_pop("db").alias("std_db"))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, event_type, begin, end in seconds: an event lasts as many seconds as its value."""
    at = F.unix_micros(F.col("ts").cast("timestamp")) / 1000000
    return table(spark, sf_dir, "events").select("user_id", "event_type", at.alias("begin"), (at + F.col("value")).alias("end"))
