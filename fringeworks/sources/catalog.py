"""The catalog of traces: header text or file name to one row of parameters and time bounds, all by column expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.functions.decode import base_rate, rate, valid_rate
from fringeworks.functions.times import SECOND, epoch_ns


def flag_map(text):
    """The flags of a command line: first letter -> the rest, from ``... -q 5 -l``."""
    parts = F.slice(F.split(text, " -"), 2, 1 << 20)
    pair = lambda p: F.struct(F.substring(p, 1, 1).alias("k"), F.trim(p.substr(F.lit(2), F.length(p))).alias("v"))
    pairs = F.transform(F.filter(parts, lambda p: p != ""), pair)
    # the last of equal flags counts, as in a dictionary
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def catalog(headers: DataFrame) -> DataFrame:
    """``headers`` (trace_id, header, n_samples) with flags, recorded (UTC), utc_offset_s, fs, start_ns, end_ns, interval_ns, expected_s, complete, ok, problem."""
    line = F.regexp_extract("header", "command line: ([^\\n]*)", 1)
    stamp = F.regexp_extract("header", "recording start: (\\d{4}-\\d\\d-\\d\\d \\d\\d:\\d\\d:\\d\\d [+-]\\d{4})", 1)
    zone = F.regexp_extract(stamp, "([+-])(\\d\\d)(\\d\\d)$", 0)
    offset = F.when(F.substring(zone, 1, 1) == "-", -1).otherwise(1) * (F.substring(zone, 2, 2).try_cast("int") * 3600 + F.substring(zone, 4, 2).try_cast("int") * 60)
    rows = headers.withColumn("flags", flag_map(line)).withColumn("recorded", F.try_to_timestamp(stamp, F.lit("yyyy-MM-dd HH:mm:ss Z"))).withColumn("utc_offset_s", offset)
    rows = rows.withColumn("fs", rate()).withColumn("interval_ns", F.round(SECOND / F.col("fs")).cast("long")).withColumn("start_ns", epoch_ns(F.col("recorded")))
    rows = rows.withColumn("end_ns", F.col("start_ns") + F.col("n_samples") * F.col("interval_ns"))
    asked = F.expr("try_cast(flags['q'] as double)")
    rows = rows.withColumn("expected_s", asked * (1 + F.coalesce(F.expr("try_cast(flags['s'] as double)"), F.lit(0.0))) / base_rate()).withColumn("complete", F.col("n_samples") / asked)
    given = F.col("error") if "error" in headers.columns else F.lit(None).cast("string")
    problem = F.coalesce(given, F.when(F.col("recorded").isNull(), "no recording start"), F.when(~valid_rate(F.col("fs")), "rate not valid"))
    return rows.withColumn("problem", problem).withColumn("ok", F.col("problem").isNull())


def validated(headers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conforming traces, quarantine): the second with the reason in ``problem``."""
    rows = catalog(headers)
    return rows.where("ok").drop("problem"), rows.where("not ok")


def file_meta(files: DataFrame, path: str = "path") -> DataFrame:
    """``files`` with recorded_local, tags (letter -> number) and rest, from ``<isotime>_s499_q268435456_F0_laser2_3674mA_20km.bin``."""
    stem = F.regexp_extract(path, "([^/]+?)(\\.[A-Za-z0-9]+)?$", 1)
    parts = F.split(stem, "_")
    tagged = F.filter(parts, lambda p: p.rlike("^[a-zA-Z]\\d+$"))
    others = F.filter(F.slice(parts, 2, 1 << 20), lambda p: ~p.rlike("^[a-zA-Z]\\d+$"))
    tags = F.map_from_entries(F.transform(tagged, lambda p: F.struct(F.substring(p, 1, 1), p.substr(F.lit(2), F.length(p)).cast("long"))))
    return files.withColumn("recorded_local", F.try_to_timestamp(F.element_at(parts, 1)).cast("timestamp_ntz")).withColumn("tags", tags).withColumn("rest", F.array_join(others, "_"))
