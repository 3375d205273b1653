"""A store that several writers may add to at once, and that a writer may leave at any moment.

A store is a folder with ``data`` (a folder of Parquet files for each commit, written before it), ``keys`` (likewise) and ``commits`` (a small JSON file each). A file in
``commits`` appears at once and whole, and only if none has its name; until then nobody reads what was written. So a writer that
dies leaves files that no one reads, and of two writers that want the same name one finds it taken.

* ``append_new``: commits are numbered. A writer names the table of the keys that it brings; if its number is taken, it drops those keys that have been
  committed meanwhile and tries the next. No key is stored twice, and nobody waits for a lock.
* ``apply_batch``: commits are named by a stream's batch. A batch that comes again after a restart finds its name taken.
* ``latest``: of rows with the same key those of the last batch; ``compact`` makes a store of these alone, staged and swapped by one commit.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TRIES = 100


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _put_if_absent(spark: SparkSession, folder: str, name: str, text: str) -> bool:
    """The file ``folder/name`` with ``text``, at once and whole; False if there is one."""
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    fs, _ = _fs(spark, folder)
    final, draft = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}") for n in (name, f"_{uuid.uuid4().hex}"))
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        if fs.getUri().getScheme() == "file":  # a local rename would replace the file; a link doesn't
            paths = [jvm.java.nio.file.Path.of(p.toUri().getPath(), gateway.new_array(jvm.java.lang.String, 0)) for p in (final, draft)]
            jvm.java.nio.file.Files.createLink(*paths)
        else:
            kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
            options = gateway.new_array(kind, 1)
            options[0] = kind.NONE
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Exception as e:
        if "AlreadyExists" not in str(e):
            raise
        return False
    finally:
        fs.delete(draft, False)
    return True


def commits(spark: SparkSession, path: str) -> list[dict]:
    """What has been committed, in the order of names; each has its name, folder and what else its writer said. A folder that isn't there has none."""
    fs, at = _fs(spark, f"{path}/commits")
    if not fs.exists(at):
        return []
    found = sorted(s.getPath().getName() for s in fs.listStatus(at))
    names = [n for n in found if n.endswith(".json")]
    out = []
    for n in names:
        stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/commits/{n}"))
        text = spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream)
        stream.close()
        out.append({"name": n.removesuffix(".json"), **json.loads(bytes(text).decode())})
    gone = {x for c in out for x in c.get("replaces", [])}
    return [c for c in out if c["name"] not in gone]


def _written(rows: DataFrame, path: str, by: str | None, kind: str = "data") -> str:
    """``rows`` in a new folder; those of a value of ``by`` are brought together first (large values in parts), or each task would write a file for each value that it meets."""
    folder = f"{kind}/{uuid.uuid4().hex}"
    writer = rows.hint("rebalance", by).write.partitionBy(by) if by else rows.write
    writer.parquet(f"{path}/{folder}")
    return folder


def committed_keys(spark: SparkSession, path: str, schema, among: list[dict] | None = None) -> DataFrame:
    """The keys of the commits of ``append_new``, of all or of those ``among`` them; ``schema`` has the key's column."""
    folders = [f"{path}/{c['keys']}" for c in (commits(spark, path) if among is None else among)]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """All committed rows, with ``commit_name``; a store without commits needs the ``schema`` of its rows, with which Spark looks into no file to plan."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    parts = [reader.parquet(f"{path}/{c['folder']}").withColumn("commit_name", F.lit(c["name"])) for c in commits(spark, path) if c.get("rows", 1)]
    if not parts:
        if schema is None:
            raise ValueError(f"nothing is committed at {path}")
        return spark.createDataFrame([], schema).withColumn("commit_name", F.lit(""))
    found = parts[0]
    for other in parts[1:]:
        found = found.unionByName(other)
    return found


def append_new(rows: DataFrame, path: str, key: str, by: str | None = None) -> int:
    """Adds the rows whose ``key`` the store hasn't got; how many keys that were. ``by`` is a column to partition each commit's files by.

    The keys of a commit are a table beside its data that its file names, so a conflict is found without reading data, and no number of keys goes through the driver.
    """
    spark = rows.sparkSession
    kind = rows.select(key).schema
    seen: set[str] = set()
    folder = keys = None
    for _ in range(_TRIES):
        known = commits(spark, path)
        fresh = [c for c in known if c["name"] not in seen]
        seen |= {c["name"] for c in fresh}
        gone = committed_keys(spark, path, kind, fresh)
        if folder is None or fresh and not mine.join(gone, key, "left_semi").isEmpty():  # first, or keys of ours have been committed by another
            source = rows if folder is None else spark.read.schema(rows.schema).parquet(f"{path}/{folder}")
            folder = _written(source.join(gone, key, "left_anti").select(rows.columns) if fresh else source, path, by)
            keys = _written(spark.read.schema(rows.schema).parquet(f"{path}/{folder}").select(key).distinct(), path, None, "keys")
            mine = spark.read.schema(kind).parquet(f"{path}/{keys}")
            number_of = mine.count()
        if not number_of:
            return 0
        number = max([int(c["name"]) for c in known], default=-1) + 1
        if _put_if_absent(spark, f"{path}/commits", f"{number:012d}.json", json.dumps({"folder": folder, "keys": keys})):
            return number_of
    raise RuntimeError(f"{path}: others have committed {_TRIES} times meanwhile")


def apply_batch(rows: DataFrame, path: str, batch: int, source: str = "stream") -> bool:
    """For ``foreachBatch``: the rows of a batch, once, however often it comes; False if it has been there. ``source`` tells streams into one store apart."""
    spark, name = rows.sparkSession, f"{source}-{batch:012d}"
    if any(name in (c["name"], *c.get("batches", [])) for c in commits(spark, path)):
        return False
    folder = _written(rows, path, None)
    return _put_if_absent(spark, f"{path}/commits", f"{name}.json", json.dumps({"folder": folder, "batch": batch}))


def latest(spark: SparkSession, path: str, keys: list[str], schema=None) -> DataFrame:
    """Of the rows with the same ``keys`` those of the last batch: an upsert, taken when read."""
    rows = read(spark, path, schema)
    values = [c for c in rows.columns if c not in (*keys, "commit_name")]
    found = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "commit_name").alias("_row"))
    return found.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in values])


def compact(spark: SparkSession, path: str, keys: list[str]) -> None:
    """The ``latest`` rows as one commit in place of those it is made of: they are staged, and one file swaps them in. Batches that were applied stay known."""
    known = commits(spark, path)
    if len(known) < 2:
        return
    folder = _written(latest(spark, path, keys), path, None)
    last = known[-1]["name"]  # after it and before the next batch by name
    about = {"folder": folder, "replaces": [c["name"] for c in known], "batches": sorted({x for c in known for x in (c["name"], *c.get("batches", []))})}
    _put_if_absent(spark, f"{path}/commits", f"{last}~{uuid.uuid4().hex}.json", json.dumps(about))
