"""Trace files, headers, sinks and streams."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.functions import decode
from fringeworks.plans.queries import QUERIES
from fringeworks.operators import unwrap
from fringeworks.sources import captures, store
from fringeworks.sources import catalog as catalogs
from fringeworks.sources.phase_trace import register, write_traces
from fringeworks.sources.sinks import append_bins, read_bins, upsert_cells, write_bins
from fringeworks.streaming import stream

HEADER = "# command line: ./board -U /dev/x -q 268435456 -s 249 -l -b -v 3\n# recording start: 2023-11-23 17:03:08 +0800\n"


@pytest.fixture
def folder(spark, tmp_path):
    words = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 1000)
    rows = [(f"t{k % 2}", HEADER, k // 2, int(w)) for k, w in enumerate(words)]
    write_traces(spark.createDataFrame(rows, "trace_id string, header string, sample_idx long, word long"), str(tmp_path))
    return tmp_path, {(f"t{k % 2}", k // 2): int(w) for k, w in enumerate(words)}


@pytest.mark.parametrize("block", [50, 1 << 22])
def test_files_read_back(spark, folder, block):
    path, words = folder
    found = spark.read.format("phase_trace").option("block", block).load(str(path))
    assert {(r.trace_id, r.sample_idx): r.word for r in found.collect()} == words
    pushed = spark.read.format("phase_trace").option("block", block).option("pushdown", "true").load(str(path))
    both = found.where("sample_idx < 7").groupBy("trace_id").count().join(found.groupBy("trace_id").agg(F.count("*").alias("n")), "trace_id")
    assert {(r["count"], r.n) for r in both.collect()} == {(7, 500)}  # one DataFrame used twice
    part = pushed.where("sample_idx >= 100 and sample_idx < 150 and trace_id = 't1'")
    assert {(r.trace_id, r.sample_idx): r.word for r in part.collect()} == {k: w for k, w in words.items() if k[0] == "t1" and 100 <= k[1] < 150}
    assert "PushedFilters" in part._jdf.queryExecution().toString() or part.count() == 50


def test_names_that_exclude_each_other(spark, folder):
    found = spark.read.format("phase_trace").option("pushdown", "true").load(str(folder[0]))
    assert found.where("trace_id = 't0' and trace_id = 't1'").count() == 0
    found = spark.read.format("phase_trace").option("pushdown", "true").load(str(folder[0]))
    assert found.where("trace_id = 't0' and trace_id in ('t1', 't2') and trace_id = 't1'").count() == 0


@pytest.mark.parametrize("block", [7, 100, 1 << 22])
def test_ranges_of_windows(spark, folder, block):
    path, words = folder
    (path / "bad.bin").write_bytes(b"not a trace at all")
    (path / "short.bin").write_bytes(b"abc")
    files = captures.list_captures(spark, str(path), ["t*.bin", "*.bin"])
    assert files.count() == 4
    whole = captures.read_ranges(files, block)
    assert {(r.trace_id, r.sample_idx): r.word for r in whole.collect()} == words
    bounds = spark.createDataFrame([("t0", 0, 9), ("t1", 450, 9999), ("bad", 0, 5)], "trace_id string, start_idx long, end_idx long")
    name = F.regexp_extract("path", "([^/]+)[.]bin$", 1)
    part = captures.read_ranges(files.withColumn("trace_id", name).join(bounds, "trace_id"), block)
    assert {(r.trace_id, r.sample_idx): r.word for r in part.collect()} == {k: w for k, w in words.items() if (k[1] < 9 if k[0] == "t0" else k[1] >= 450)}
    assert {r.trace_id: r.error for r in captures.read_headers(files).collect()} == {"t0": None, "t1": None, "bad": "not a trace", "short": "not a trace"}


def test_short_ranges_share_tasks(spark, tmp_path, monkeypatch):
    """Tasks grow with samples and ranges, not with the block: 600 ranges of 5 samples are one, and of at most 100 ranges six; listing 60 files isn't a task each few files."""
    from fringeworks.sources import index

    rows = spark.range(3000).selectExpr("id div 50 as trace_id", "'# x' as header", "id % 50 as sample_idx", "id as word")
    write_traces(rows, str(tmp_path / "t"))
    tasks = lambda df: df.rdd.getNumPartitions()
    files = captures.list_captures(spark, str(tmp_path / "t"))
    assert tasks(files) <= 2 * spark.sparkContext.defaultParallelism and files.count() == 60
    assert tasks(captures.read_ranges(files, 5)) == 1 and tasks(index.scan_blocks(files, 5)) == 1
    monkeypatch.setattr(captures, "RANGES_A_TASK", 100)
    monkeypatch.setattr(captures, "BATCH", 64)  # a batch holds parts of several files
    bounds = files.withColumns({"start_idx": F.lit(0), "end_idx": F.lit(50)})
    found = captures.read_ranges(bounds, 5)
    assert tasks(found) == 6 and {(int(r.trace_id), r.sample_idx, r.word) for r in found.collect()} == {(k // 50, k % 50, k) for k in range(3000)}
    assert tasks(index.scan_blocks(files, 5)) <= 7 and index.scan_blocks(files, 5).agg(F.sum("n")).first()[0] == 3000


def test_captures_by_glob_and_date(spark, tmp_path):
    for name in ("2024-01-19T00:34:36_s1_q8_a", "2024-01-20T00:00:00_s1_q8_a", "2024-02-01T00:00:00_s1_q8_b", "undated"):
        rows = spark.createDataFrame([(name, HEADER, k, k) for k in range(8)], "trace_id string, header string, sample_idx long, word long")
        write_traces(rows, str(tmp_path))
    listed = lambda *a: sorted(r.path.rsplit("/", 1)[1][:10] for r in captures.list_captures(spark, *a).collect())
    assert listed(str(tmp_path), ["*_a.bin", "*_b.bin"]) == ["2024-01-19", "2024-01-20", "2024-02-01"]
    assert listed(str(tmp_path), "*.bin", "2024-01-20", "2024-02-01") == ["2024-01-20"]
    assert len(listed(str(tmp_path))) == 4


def test_headers(spark, folder):
    path, _ = folder
    (path / "bad.bin").write_bytes(b"not a trace at all")
    (path / "odd.bin").write_bytes((path / "t0.bin").read_bytes() + b"abc")
    register(spark)
    rows = catalogs.catalog(spark.read.format("phase_trace").option("mode", "header").load(str(path)))
    found = {r.trace_id: r for r in rows.collect()}
    r = found["t0"]
    assert (r.ok, r.n_samples, r.fs, r.interval_ns, r.utc_offset_s) == (True, 500, 40000.0, 25000, 28800)
    assert r.start_ns == 1700730188 * 10**9 and r.end_ns - r.start_ns == 500 * 25000
    assert (r.flags["q"], r.flags["U"], r.flags["l"]) == ("268435456", "/dev/x", "") and abs(r.expected_s - 6710.8864) < 1e-6
    good, put_aside = catalogs.validated(spark.read.format("phase_trace").option("mode", "header").load(str(path)))
    assert {r.trace_id: r.problem for r in put_aside.collect()} == {"bad": "not a trace", "odd": "bytes left over"} and good.count() == 2


@pytest.mark.parametrize(("flags", "fs", "ok"), [("-s 4 -l", 2e6, True), ("-h", 2e7, False), ("-s 1", 1e7, True), ("-s 6 -l", 1e7 / 7, True), ("-s 2 -l", 1e7 / 3, True), ("-l", 1e7, True)])
def test_rates(spark, flags, fs, ok):
    text = f"# command line: board -q 8 {flags}\n# recording start: 2023-11-23 17:03:08 -0130\n"
    r = catalogs.catalog(spark.createDataFrame([(1, text, 8)], "trace_id long, header string, n_samples long")).first()
    assert abs(r.fs - fs) < 1 and (r.ok == ok or not (2e7 / fs).is_integer()) and r.utc_offset_s == -5400


def test_file_names(spark):
    df = spark.createDataFrame([("/x/2023-07-06T14:01:02_s499_q268435456_F0_laser2_3674mA_20km.bin",)], "path string")
    r = catalogs.file_meta(df).first()
    assert str(r.recorded_local) == "2023-07-06 14:01:02" and r.tags == {"s": 499, "q": 268435456, "F": 0} and r.rest == "laser2_3674mA_20km"


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(0, 1, 2.0), (86400 * 10**9, 1, 3.0)], "bin_start_ns long, freq_idx int, mean_db double")
    assert append_bins(one, f"{tmp_path}/a") == 2
    assert append_bins(one.unionByName(spark.createDataFrame([(5, 1, 9.0)], one.schema)), f"{tmp_path}/a") == 1
    assert append_bins(one, f"{tmp_path}/a") == 0 and read_bins(spark, f"{tmp_path}/a").count() == 3
    write_bins(one, f"{tmp_path}/b")
    write_bins(one.limit(1).withColumn("mean_db", F.lit(7.0)), f"{tmp_path}/b")
    assert spark.read.parquet(f"{tmp_path}/b").count() == 2
    cells = spark.createDataFrame([(i, j, 1.0) for i in range(3) for j in range(2)], "i int, j int, mean double")
    cells.write.partitionBy("i").parquet(f"{tmp_path}/c")
    upsert_cells(cells.where("i = 1 and j = 0").withColumn("mean", F.lit(5.0)), f"{tmp_path}/c", f"{tmp_path}/staged")
    assert sorted(r["mean"] for r in spark.read.parquet(f"{tmp_path}/c").collect()) == [1.0] * 5 + [5.0]


def test_captures_arrive(spark, folder, tmp_path):
    path, words = folder
    (path / "bad.bin").write_bytes(b"no trace")
    made, put_aside = [], []
    count = lambda w: decode.decode(w).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("s"))
    for _ in range(2):  # the second start finds nothing new
        stream.captures(spark, str(path), f"{tmp_path}/ck-captures", count, lambda b, k: made.extend(b.collect()), lambda b, k: put_aside.extend(b.collect()), block=64)
    assert [(r.trace_id, r.error) for r in put_aside] == [("bad", "not a trace")]
    assert sorted((r.trace_id, r.n) for r in made) == [("t0", 500), ("t1", 500)]
    assert os.path.isdir(f"{tmp_path}/ck-captures") and len(words) == 1000


def test_index_of_captures(spark, tmp_path):
    """Windows by the stored index against the whole trace repaired: wraps at blocks' edges and at windows' first samples, dense ones, none."""
    from fringeworks.sources import index

    r, rows = np.random.default_rng(11), []
    traces = {"dense": np.cumsum(r.integers(-9000, 9000, 500)) * 3, "ramp": np.arange(500) * 3000, "still": r.integers(-50, 50, 500), "one": np.array([5])}
    for name, m in traces.items():
        m16 = (m + 32768) % 65536 - 32768
        rows += [(name, HEADER, k, int(v) << 48 | int(r.integers(0, 1 << 48))) for k, v in enumerate(m16)]
    write_traces(spark.createDataFrame(rows, "trace_id string, header string, sample_idx long, word long"), str(tmp_path / "t"))
    files = captures.list_captures(spark, str(tmp_path / "t"))
    whole = unwrap.unwrap(spark.createDataFrame(rows, "trace_id string, header string, sample_idx long, word long").select("trace_id", "sample_idx", F.shiftright("word", 48).alias("m")), 64)
    whole = {(x.trace_id, x.sample_idx): x.m_unwrapped for x in whole.collect()}
    for block in (7, 64, 1000):
        path = f"file://{tmp_path}/index{block}"
        assert index.add_captures(files.where("path like '%ramp%'"), path, block) == 1 and index.add_captures(files, path, block) == 3 and index.add_captures(files, path, block) == 0
        known = index.read_index(spark, path).cache()
        assert known.count() == 3 * -(-500 // block) + 1
        still = known.where("trace_id = 'still'").agg(F.min("least"), F.max("most"), F.max(F.size("wraps")), F.sum("n")).first()
        assert tuple(still) == (np.abs(traces["still"]).min(), np.abs(traces["still"]).max(), 0, 500)
        for low, high in ((0, 500), (63, 65), (64, 300), (21, 22), (499, 500), (126, 133)):
            bounds = spark.createDataFrame([(t, low, min(high, len(m))) for t, m in traces.items() if low < len(m)], "trace_id string, start_idx long, end_idx long")
            got = {(x.trace_id, x.sample_idx): x for x in index.read_windows(files, known, bounds, block=block).collect()}
            assert {at: x.m_unwrapped for at, x in got.items()} == {at: v for at, v in whole.items() if low <= at[1] < high}
            if block == 64:
                iqm = spark.createDataFrame([(t, k, x.m) for (t, k), x in got.items()], "trace_id string, sample_idx long, m long")
                wraps = unwrap.rollovers(spark.createDataFrame([(t, k, int((v + 32768) % 65536 - 32768)) for t, m in traces.items() for k, v in enumerate(m)], "trace_id string, sample_idx long, m long"))
                want = {(x.trace_id, x.sample_idx): x.m_unwrapped for x in unwrap.apply_rollovers(iqm, wraps, anchor="window", bounds=bounds).collect()}
                assert {(x.trace_id, x.sample_idx): x.m_unwrapped for x in index.read_windows(files, known, bounds, "window", block).collect()} == want


CHUNK = "trace_id long, sample_idx long, m long"


def _arrive(spark, folder, chunks):
    """A file each, in this order."""
    for k, rows in enumerate(chunks):
        spark.createDataFrame(rows, CHUNK).coalesce(1).write.parquet(f"{folder}/arrival={k:04d}")
    stream.feed_by_name(spark, folder)
    return spark.readStream.schema(CHUNK).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stream_of_shuffled_chunks(spark, tmp_path):
    """Chunks in any order, twice, and overlapping: each sample once, as from the whole trace."""
    r = np.random.default_rng(4)
    whole = {t: [(t, k, int((k * 3000 + t + 32768) % 65536) - 32768) for k in range(300)] for t in (1, 2)}
    chunks = [rows[a : a + 40] for rows in whole.values() for a in range(0, 300, 40)] + [whole[1][100:170], whole[2][0:5], whole[1][80:120]]
    chunks = [chunks[k] for k in r.permutation(len(chunks))]
    chunks = [sum(chunks[k : k + 3], []) for k in range(0, len(chunks), 3)]
    out = f"{tmp_path}/out"
    stream.run_available(stream.unwrapped(_arrive(spark, f"{tmp_path}/in", chunks)), f"{tmp_path}/ck", path=out, rocks=True)
    found = spark.read.parquet(out)
    want = unwrap.unwrap(spark.createDataFrame(whole[1] + whole[2], CHUNK), 50).select("trace_id", "sample_idx", "m_unwrapped")
    assert sorted(map(tuple, found.select("trace_id", "sample_idx", "m_unwrapped").collect())) == sorted(map(tuple, want.collect()))
    assert found.where("gap_until is not null").count() == 0 and stream.gaps(spark, f"{tmp_path}/ck").count() == 0


def test_stream_groups_share_state(spark, tmp_path, monkeypatch):
    """Sixty traces in three groups: a state for each group, parts of waiting chunks that go when all of a part is used, and the same samples."""
    monkeypatch.setattr(stream, "GROUPS", 3)
    r = np.random.default_rng(5)
    rows = [(t, k, int((k * 3000 * (t % 3) + t + 32768) % 65536) - 32768) for t in range(60) for k in range(40 + t)]
    chunks = [[x for x in rows if (x[1] // 10 * 3 + x[0]) % 7 == a] for a in range(7)] + [[x for x in rows if x[1] % 17 < 5]]
    chunks = [chunks[k] for k in r.permutation(len(chunks))]
    out = f"{tmp_path}/out"
    query = stream.run_available(stream.unwrapped(_arrive(spark, f"{tmp_path}/in", chunks)), f"{tmp_path}/ck", path=out, rocks=True)
    want = unwrap.unwrap(spark.createDataFrame(rows, CHUNK), 50).select("trace_id", "sample_idx", "m_unwrapped")
    assert sorted(map(tuple, spark.read.parquet(out).select("trace_id", "sample_idx", "m_unwrapped").collect())) == sorted(map(tuple, want.collect()))
    assert stream.gaps(spark, f"{tmp_path}/ck").count() == 0
    assert [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["numInputRows"]][-1] == 3


def test_stream_tells_gaps(spark, tmp_path):
    """A gap stops neither the stream nor other traces; filled later, the samples follow."""
    rows = lambda t, a, b: [(t, k, k) for k in range(a, b)]
    chunks, out = [rows(1, 0, 5) + rows(2, 0, 5), rows(1, 8, 10), rows(2, 5, 9) + rows(1, 20, 22)], f"{tmp_path}/out"
    read = _arrive(spark, f"{tmp_path}/in", chunks)
    stream.run_available(stream.unwrapped(read), f"{tmp_path}/ck", path=out, rocks=True)
    assert [tuple(r) for r in stream.gaps(spark, f"{tmp_path}/ck").collect()] == [(1, 5, 8, 2)]
    assert spark.read.parquet(out).groupBy("trace_id").count().orderBy("trace_id").collect() == [(1, 5), (2, 9)]
    spark.createDataFrame(rows(1, 5, 8), CHUNK).coalesce(1).write.parquet(f"{tmp_path}/in/arrival=0009")
    stream.run_available(stream.unwrapped(read), f"{tmp_path}/ck", path=out, rocks=True)
    assert [tuple(r) for r in stream.gaps(spark, f"{tmp_path}/ck").collect()] == [(1, 10, 20, 1)]
    assert sorted(r.sample_idx for r in spark.read.parquet(out).where("trace_id = 1").collect()) == list(range(10))


def test_stream_gap_by_timer(spark, tmp_path):
    """In a stream that goes on, an open gap becomes a row after a while."""
    import time

    read = _arrive(spark, f"{tmp_path}/in", [[(1, 0, 0), (1, 4, 4)], [(2, 0, 0)]])
    before = spark.conf.get(stream._PROVIDER)
    spark.conf.set(stream._PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    query = stream.unwrapped(read, 0.5).writeStream.option("checkpointLocation", f"{tmp_path}/ck").format("parquet").option("path", f"{tmp_path}/out").trigger(processingTime="1 second").start()
    spark.conf.set(stream._PROVIDER, before)
    try:
        for _ in range(60):
            time.sleep(1)
            assert query.exception() is None
            told = spark.read.schema(CHUNK + ", gap_until long").parquet(f"{tmp_path}/out").where("gap_until is not null").collect() if os.path.isdir(f"{tmp_path}/out/_spark_metadata") else []
            if told:
                break
    finally:
        query.stop()
    assert [(r.trace_id, r.sample_idx, r.gap_until) for r in told] == [(1, 1, 4)]


def test_stream_of_final_bins(spark, tmp_path):
    """A bin comes once, when the watermark has passed it; rows that come later are kept aside, and no state is left of it."""
    minute = lambda *at: [(f"2024-01-01 {m // 60:02d}:{m % 60:02d}:00", float(m)) for m in at]
    batches = [minute(1, 2, 20), minute(50, 3), minute(130), minute(4, 100, 131), minute(300)]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, "ts string, value double").selectExpr("cast(ts as timestamp) as ts", "value").coalesce(1).write.parquet(f"{tmp_path}/in/arrival={k}")
    stream.feed_by_name(spark, f"{tmp_path}/in")
    source = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in").drop("arrival")
    for _ in range(2):  # the second run has nothing to do
        stream.run_available(source, f"{tmp_path}/ck", lambda b, k: stream.split_late(b, k, f"{tmp_path}/s", "ts", "15 minutes", 3600.0))
    # before the fourth batch 70 is final: 4 is late, 100 isn't
    assert [r.value for r in store.read(spark, f"{tmp_path}/s/late").collect()] == [4.0]
    timely = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/timely")
    stream.feed_by_name(spark, f"{tmp_path}/s/timely")
    query = stream.run_available(stream.binned(timely, "ts", late="1 hour"), f"{tmp_path}/ck2", path=f"{tmp_path}/out")
    found = {r.bin_start.hour * 60 + r.bin_start.minute: (r.n, r["mean"]) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert found == {0: (3, 2.0), 15: (1, 20.0), 45: (1, 50.0), 90: (1, 100.0), 120: (2, 130.5)}
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5  # each once
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 1  # the bin of 300 alone
    again = [spark.createDataFrame([("2024-01-01 00:05:00", 5.0)], "ts string, value double").selectExpr("cast(ts as timestamp) as ts", "value")] * 2
    for rows in again:  # the same batch comes twice
        stream.split_late(rows, 5, f"{tmp_path}/s", "ts", "15 minutes", 3600.0)
    assert sorted(r.value for r in store.read(spark, f"{tmp_path}/s/late").collect()) == [4.0, 5.0]


def test_stream_of_final_bins_in_several_files(spark, tmp_path, monkeypatch):
    """A batch may have files in any order of time: no timely row is lost by a stream that takes the batch's files apart, and its state is dealt to as many stores as asked for."""
    monkeypatch.setattr(stream, "ROWS_A_TASK", 3)
    schema = "ts timestamp, value double"
    for k, minutes in enumerate([range(599, -1, -20), range(1200, 600, -20), [1999, 700]]):
        rows = spark.createDataFrame([(f"2024-01-01 {m // 60 % 24:02d}:{m % 60:02d}:00" if m < 1440 else "2024-01-02 09:19:00", float(m)) for m in minutes], "ts string, value double")
        rows.selectExpr("cast(ts as timestamp) as ts", "value").repartitionByRange(4, F.col("ts").desc()).write.parquet(f"{tmp_path}/staged/arrival={k}")  # the first file is the latest
    taken = []
    for name in stream.arrivals(spark, f"{tmp_path}/staged", f"{tmp_path}/in"):
        taken.append(name)
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").drop("arrival")
        stream.run_available(source, f"{tmp_path}/ck", lambda b, k: stream.split_late(b, k, f"{tmp_path}/s", "ts", "15 minutes", 3600.0))
    assert taken == ["arrival=0", "arrival=1", "arrival=2"] == sorted(os.listdir(f"{tmp_path}/in")) and len(store.commits(spark, f"{tmp_path}/s/marks")) == 3
    assert [r.value for r in store.read(spark, f"{tmp_path}/s/late").collect()] == [700.0]
    stream.feed_by_name(spark, f"{tmp_path}/s/timely")
    assert len([f for f in os.listdir(f"{tmp_path}/s/timely/part=000000000") if f.endswith(".parquet")]) > 3
    wanted = spark.conf.get("spark.sql.shuffle.partitions")
    timely = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/s/timely")
    query = stream.run_available(stream.binned(timely, "ts", late="1 hour"), f"{tmp_path}/ck2", path=f"{tmp_path}/out", parts=2)
    found = {(r.bin_start.day, r.bin_start.hour * 60 + r.bin_start.minute): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {}
    for m in [*range(599, -1, -20), *range(1200, 600, -20)]:
        want[1, m // 15 * 15] = want.get((1, m // 15 * 15), 0) + 1
    assert found == want
    assert query.recentProgress[-1]["stateOperators"][0]["numShufflePartitions"] == 2 and spark.conf.get("spark.sql.shuffle.partitions") == wanted


DATA = "/root/testdata/sf0.001"


def test_stream_bins_in_any_order(spark, tmp_path):
    """The latest range is read first, and what follows is far behind it."""
    for k in (2, 0, 1):
        rows = spark.range(100).selectExpr(f"timestamp_seconds({k} * 864000 + id * 60) as ts", "cast(id as double) as value")
        rows.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    part = next(f for f in sorted(os.listdir(f"{tmp_path}/in")) if f.endswith(".parquet"))
    spark.read.parquet(f"{tmp_path}/in/{part}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")  # bins that come again
    source = spark.readStream.schema("ts timestamp, value double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    last = {}
    stream.run_available(stream.binned(source, "ts"), f"{tmp_path}/ck", lambda b, k: last.update({r.bin_start: (r.n, r["mean"]) for r in b.collect()}), mode="update")
    want = spark.read.parquet(f"{tmp_path}/in").groupBy(F.window("ts", "15 minutes")["start"].alias("bin_start")).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    assert last == {r.bin_start: (r.n, r["mean"]) for r in want.collect()} and sum(n for n, _ in last.values()) == 400


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stream_bins_hold_all_events(spark):
    events = spark.read.parquet(f"{DATA}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    want = events.groupBy(F.window("ts", "15 minutes")["start"].cast("timestamp_ntz").alias("bin_start")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    got = QUERIES["stream_bins"](spark, DATA).select("bin_start", "n", F.round("mean", 6).alias("mean"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0 and got.agg(F.sum("n")).first()[0] == events.count()
