"""Commits of several writers, of writers that die, and of batches that come again."""

import threading

import pytest
from pyspark.sql import functions as F

from fringeworks.sources import store
from fringeworks.streaming import stream

KIND = "bin_start_ns long, who string"


def bins(spark, low, high, who):
    return spark.range(low, high).select(F.col("id").alias("bin_start_ns"), F.lit(who).alias("who"))


def held(spark, path):
    return sorted((r.bin_start_ns, r.who) for r in store.read(spark, path).collect())


def test_two_writers_at_once(spark, tmp_path):
    """Threads with overlapping bins: each bin once, whoever was first."""
    path, errors = f"file://{tmp_path}/s", []

    def write(k):
        try:
            store.append_new(bins(spark, 5 * k, 5 * k + 20, f"w{k}"), path, "bin_start_ns")
        except Exception as e:
            errors.append(e)

    threads = [threading.Thread(target=write, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors and [b for b, _ in held(spark, path)] == list(range(35))


def test_a_conflict_at_the_last_moment(spark, tmp_path, monkeypatch):
    """Another commits between reading and committing: what is left goes in with the next number."""
    path, old, done = f"file://{tmp_path}/s", store._put_if_absent, []

    def late(spark_, folder, name, text):
        if not done:
            done.append(name)
            assert store.append_new(bins(spark, 3, 8, "other"), path, "bin_start_ns") == 5
        return old(spark_, folder, name, text)

    monkeypatch.setattr(store, "_put_if_absent", late)
    assert store.append_new(bins(spark, 0, 6, "me"), path, "bin_start_ns") == 3
    assert held(spark, path) == [(k, "me") for k in range(3)] + [(k, "other") for k in range(3, 8)]
    assert [c["name"] for c in store.commits(spark, path)] == ["000000000000", "000000000001"]


def test_commits_stay_small(spark, tmp_path):
    """A commit names the table of its keys, not each key; parts of a table that all hold the same dates become a file for each date."""
    path = f"file://{tmp_path}/s"
    rows = spark.range(0, 4000, 1, 16).select(F.col("id").alias("bin_start_ns"), (F.col("id") % 5).alias("date"))
    assert store.append_new(rows, path, "bin_start_ns", "date") == 4000 and store.append_new(rows, path, "bin_start_ns", "date") == 0
    assert store.append_new(rows.union(rows.selectExpr("bin_start_ns + 2000", "date")), path, "bin_start_ns", "date") == 2000
    assert store.read(spark, path).select("bin_start_ns").distinct().count() == 6000 == store.read(spark, path).count()
    (first, second) = store.commits(spark, path)
    assert len((tmp_path / "s" / "commits" / f"{first['name']}.json").read_text()) < 300
    assert len(list((tmp_path / "s" / first["folder"]).rglob("*.parquet"))) == 5
    assert store.committed_keys(spark, path, "bin_start_ns long").count() == 6000 and second["folder"] != first["folder"]


def test_a_writer_that_dies(spark, tmp_path, monkeypatch):
    """Data without a commit is never read, and doesn't hinder the next run."""
    path = f"file://{tmp_path}/s"
    with monkeypatch.context() as patch, pytest.raises(KeyboardInterrupt):
        patch.setattr(store, "_put_if_absent", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        store.append_new(bins(spark, 0, 6, "dead"), path, "bin_start_ns")
    assert store.commits(spark, path) == []
    assert store.read(spark, path, KIND).count() == 0
    with pytest.raises(ValueError):
        store.read(spark, path)
    assert store.append_new(bins(spark, 0, 6, "me"), path, "bin_start_ns") == 6 and {w for _, w in held(spark, path)} == {"me"}


@pytest.mark.parametrize("scheme", ["file", "other"])
def test_a_name_is_given_once(spark, tmp_path, scheme):
    """By a link on a local disk, by a rename that refuses elsewhere."""
    folder = f"file://{tmp_path}/c"
    if scheme == "other":
        (tmp_path / "c").mkdir()
        spark.sparkContext._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.put.link./c", folder)
        folder = "viewfs://put/c"
    assert store._put_if_absent(spark, folder, "a.json", "{}") and not store._put_if_absent(spark, folder, "a.json", "no")
    assert [p.read_text() for p in (tmp_path / "c").glob("*.json")] == ["{}"] and not list((tmp_path / "c").glob("_*"))


def test_batches_once_and_upserts(spark, tmp_path):
    path, row = f"file://{tmp_path}/s", lambda k, v: spark.createDataFrame([(k, v)], "k int, v string")
    assert store.apply_batch(row(1, "a"), path, 0) and store.apply_batch(row(1, "b"), path, 1) and store.apply_batch(row(2, "c"), path, 2)
    assert not store.apply_batch(row(1, "again"), path, 0)
    want = [(1, "b"), (2, "c")]
    assert sorted(map(tuple, store.latest(spark, path, ["k"]).collect())) == want
    store.compact(spark, path, ["k"])
    assert len(store.commits(spark, path)) == 1 and sorted(map(tuple, store.latest(spark, path, ["k"]).collect())) == want
    assert not store.apply_batch(row(1, "again"), path, 1)  # what was compacted stays known
    assert store.apply_batch(row(1, "d"), path, 3) and sorted(map(tuple, store.latest(spark, path, ["k"]).collect())) == [(1, "d"), (2, "c")]
    store.compact(spark, path, ["k"])
    assert not store.apply_batch(row(1, "again"), path, 0) and sorted(map(tuple, store.latest(spark, path, ["k"]).collect())) == [(1, "d"), (2, "c")]


def test_killed_between_write_and_checkpoint(spark, tmp_path):
    """A stream that dies after its batch was stored and before the checkpoint knows it, started again: no row twice."""
    path, source = f"file://{tmp_path}/s", f"{tmp_path}/in"
    for k in range(4):
        spark.createDataFrame([(k, f"v{k}")], "k int, v string").coalesce(1).write.mode("append").parquet(source)
    arriving = lambda: spark.readStream.schema("k int, v string").option("maxFilesPerTrigger", 1).parquet(source)
    applied = []

    def each(rows, k, dies):
        applied.append((k, store.apply_batch(rows, path, k)))
        if k == 2 and dies:
            raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        stream.run_available(arriving(), f"{tmp_path}/ck", lambda rows, k: each(rows, k, True))
    stream.run_available(arriving(), f"{tmp_path}/ck", lambda rows, k: each(rows, k, False))
    assert [a for a in applied if a[0] == 2] == [(2, True), (2, False)] and applied[-1] == (3, True)
    assert sorted((r.k, r.v) for r in store.read(spark, path).collect()) == [(k, f"v{k}") for k in range(4)]
