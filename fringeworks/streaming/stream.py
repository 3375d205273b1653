"""Running statistics, counter repair over arriving chunks, captures as they arrive, and time bins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from fringeworks.functions.decode import WRAP
from fringeworks.sources import store
from fringeworks.sources.captures import read_headers, read_ranges
from fringeworks.sources.phase_trace import BLOCK
from fringeworks.sources.work import ROWS_A_TASK


def running_moments(stream: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """n, mean, var (population) per key as rows arrive: Spark's own state."""
    return stream.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))


def binned(stream: DataFrame, ts: str, width: str = "15 minutes", late: str | None = None, value: str = "value") -> DataFrame:
    """bin_start, n, mean: fixed bins. In update mode a bin's row comes again as events reach it, in whatever order they arrive; state holds a row for each bin.

    With ``late``, in append mode, a bin comes once, when the watermark has passed its end, and its state is dropped; later events are lost (``split_late`` keeps them).
    """
    timed = stream if late is None else stream.withWatermark(ts, late)
    rows = timed.groupBy(F.window(ts, width).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
    return rows.select(F.col("w.start").alias("bin_start"), "n", "mean")


def sessions(stream: DataFrame, keys: list[str], gap_s: float, late: str, ts: str = "at") -> DataFrame:
    """keys, begin, end, n of a stream of events (begin and end in seconds, ``ts`` the time of begin), for append mode: an event that begins within ``gap_s`` of the end of
    any before it is of the same session, which is final when the watermark has passed its end and the gap.

    ``events.merge_events`` looks at the event before alone; the two differ where an event lies wholly in an earlier one.
    """
    lasts = F.concat(F.round((F.col("end") - F.col("begin") + gap_s) * 1000000).cast("long").cast("string"), F.lit(" microseconds"))
    held = stream.withWatermark(ts, late).groupBy(F.session_window(ts, lasts), *keys)
    return held.agg(F.min("begin").alias("begin"), F.max("end").alias("end"), F.count(F.lit(1)).alias("n")).drop("session_window")


#: Groups that the traces of a stream are dealt to: a call and its state are for a group.
GROUPS = 1024


class _Repair(StatefulProcessor):
    """The counters of a group of traces: what came last of each, and the chunks that wait for a gap to be filled.

    Each call on the state is a message to Spark, so there are a few for a group, however many traces it has. The chunks of a batch that wait are one part, which goes
    when none of them waits any more; which chunk lies where is known without reading parts.
    """

    def __init__(self, patience_ms: int | None):
        self.patience_ms = patience_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "traces array<struct<trace_id:bigint,last:bigint,turns:bigint,following:bigint>>, waits array<struct<trace_id:bigint,first:bigint,length:bigint,part:bigint>>, parts long")
        self.waiting = handle.getMapState("waiting", "part long", "chunks array<struct<trace_id:bigint,first:bigint,m:binary>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import numpy as np
        import pandas as pd

        traces, waits, parts = self.at.get() or ([], [], 0)
        at = {t: (last, turns, following) for t, last, turns, following in traces}
        held: dict = {}  # trace -> first -> length, part
        for t, first, length, part in waits:
            held.setdefault(t, {})[first] = (length, part)
        tables = list(rows)
        trace, index, m = (np.concatenate([t[c].to_numpy(np.int64) for t in tables]) for c in ("trace_id", "sample_idx", "m"))
        order = np.lexsort((index, trace))
        trace, index, m = trace[order], index[order], m[order]
        once = np.r_[True, (np.diff(trace) != 0) | (np.diff(index) != 0)]
        trace, index, m = trace[once], index[once], m[once]
        cuts = np.r_[0, np.flatnonzero((np.diff(trace) != 0) | (np.diff(index) != 1)) + 1, len(trace)]
        new: dict = {}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            new.setdefault(int(trace[a]), {})[int(index[a])] = m[a:b]
        used: dict = {}
        for t, runs in new.items():  # of chunks with the same first sample the longer
            known = held.setdefault(t, {})
            known |= {first: (len(x), None) for first, x in runs.items() if first not in known or len(x) >= known[first][0]}
            following, used[t] = at.get(t, (None, 0, 0))[2], []
            while usable := [k for k in known if k <= following]:
                for first in usable:
                    length, part = known.pop(first)
                    used[t].append((first, part))
                    following = max(following, first + length)
        read = {part: {(t, first): x for t, first, x in self.waiting.getValue((part,))[0]} for part in {p for u in used.values() for _, p in u if p is not None}}
        out: list[tuple] = []
        for t, firsts in used.items():
            last, turns, following = at.get(t, (None, 0, 0))
            for first, part in firsts:
                x = new[t][first] if part is None else np.frombuffer(read[part][t, first], "<i8")
                x = x[following - first :]  # samples that have come before are left out
                if len(x):
                    jump = np.diff(x, prepend=x[0] if last is None else last)
                    total = turns + np.cumsum((jump > WRAP).astype(np.int64) - (jump < -WRAP))
                    out.append((np.full(len(x), t), following + np.arange(len(x)), x - 65536 * total))
                    last, turns, following = int(x[-1]), int(total[-1]), following + len(x)
            if last is not None:
                at[t] = (last, turns, following)
        early = [(t, first, new[t][first].astype("<i8").tobytes()) for t in new for first, (_, part) in held[t].items() if part is None]
        if early:
            self.waiting.updateValue((parts,), (early,))
        left = [(t, first, length, parts if part is None else part) for t, known in held.items() for first, (length, part) in known.items()]
        for part in {w[3] for w in waits} - {w[3] for w in left}:
            self.waiting.removeKey((part,))
        self.at.update(([(t, *x) for t, x in at.items()], left, parts + bool(early)))
        if self.patience_ms is not None:
            timers = list(self.handle.listTimers())
            if left and not timers:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.patience_ms)
            elif not left:
                for t in timers:
                    self.handle.deleteTimer(t if isinstance(t, int) else t[0])
        if out:
            trace, index, m = (np.concatenate([x[k] for x in out]) for k in range(3))
            none = pd.arrays.IntegerArray(np.zeros(len(index), np.int64), np.ones(len(index), bool))
            yield pd.DataFrame({"trace_id": trace, "sample_idx": index, "m_unwrapped": m, "gap_until": none})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        """The gaps that are still open, a row each."""
        import pandas as pd

        traces, waits, _ = self.at.get() or ([], [], 0)
        at = {t: following for t, _, _, following in traces}
        firsts: dict = {}
        for t, first, _, _ in waits:
            firsts[t] = min(first, firsts.get(t, first))
        if firsts:
            yield pd.DataFrame({"trace_id": list(firsts), "sample_idx": [at.get(t, 0) for t in firsts], "m_unwrapped": pd.array([None] * len(firsts), "Int64"), "gap_until": pd.array(list(firsts.values()), "Int64")})

    def close(self) -> None:
        pass


def unwrapped(stream: DataFrame, patience_s: float | None = None) -> DataFrame:
    """trace_id, sample_idx, m_unwrapped, gap_until of a stream of (trace_id, sample_idx, m), whose chunks may come in any order, more than once or overlapping.

    State has the last counter, the turns so far and the next index of a trace, and the chunks that came early, which wait until what is missing has come; samples that
    have been given are not given again. ``gaps`` reads the open gaps from a checkpoint. With ``patience_s`` a gap that is open for so long is also told in the stream, once,
    as a row without m_unwrapped: the first sample that is missing and, in gap_until, the first that waits; the stream goes on, and the gap may
    still be filled. Timers run with a stream that goes on, not with ``run_available``, and each trace has its own; without them traces share the calls of one of GROUPS groups.
    Needs the RocksDB state store.
    """
    schema = "trace_id long, sample_idx long, m_unwrapped long, gap_until long"
    timed = patience_s is not None
    group = F.col("trace_id") if timed else F.pmod(F.xxhash64("trace_id"), F.lit(GROUPS))
    return stream.withColumn("_group", group).groupBy("_group").transformWithStateInPandas(_Repair(int(1000 * patience_s) if timed else None), schema, "append", "processingTime" if timed else "none")


def gaps(spark: SparkSession, checkpoint: str) -> DataFrame:
    """trace_id, first_missing, first_waiting, n_waiting: the traces of an ``unwrapped`` stream in which chunks wait, from its checkpoint."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "at").load().select("value.*")
    waiting = state.select(F.inline("waits")).groupBy("trace_id").agg(F.min("first").alias("first_waiting"), F.count(F.lit(1)).alias("n_waiting"))
    at = state.select(F.inline("traces")).select("trace_id", "following")
    return waiting.join(at, "trace_id", "left").select("trace_id", F.coalesce("following", F.lit(0)).alias("first_missing"), "first_waiting", "n_waiting")


def feed_by_name(spark: SparkSession, folder: str) -> None:
    """Gives the files under ``folder`` times in the order of their paths, so that a stream takes them in that order."""
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    listed, paths = fs.listFiles(spark._jvm.org.apache.hadoop.fs.Path(folder), True), []
    while listed.hasNext():
        paths.append(listed.next().getPath())
    begin = int(time.time()) * 1000 - 1000 * len(paths)
    for k, path in enumerate(sorted(paths, key=lambda p: p.toString())):
        fs.setTimes(path, begin + 1000 * k, -1)


def arrivals(spark: SparkSession, staged: str, folder: str) -> Iterator[str]:
    """Moves what lies under ``staged`` to ``folder``, a folder at a time in the order of names: its files appear at once, and a stream that has no limit of files takes them as one batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for name in sorted(s.getPath().getName() for s in fs.listStatus(path(staged)) if s.isDirectory()):
        if not fs.rename(path(f"{staged}/{name}"), path(f"{folder}/{name}")):
            raise OSError(f"{staged}/{name} can't be moved to {folder}")
        yield name


def split_late(rows: DataFrame, batch: int, path: str, ts: str, width: str, late_s: float) -> None:
    """For ``foreachBatch``: rows whose bin was final when they came go to the store ``path/late``, all others to the folder ``path/timely``, each once.

    A bin is final for a batch when its end is at most ``late_s`` before the latest time of all batches before it. A batch of any size is a folder of
    ``path/timely``, whose files are ranges of time in the order of their names. So a stream over them in that order (``feed_by_name``) with that watermark loses no row, however many files
    it takes at a time: its own watermark is ahead of this one only by rows of the same batch, and none of those that are to come is earlier than they are.
    """
    spark = rows.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    marks = store.read(spark, f"{path}/marks", "batch long, top timestamp").where(F.col("batch") < batch)
    final = F.lit(marks.agg(F.max("top")).first()[0]).cast("timestamp") - F.make_dt_interval(secs=F.lit(late_s))
    judged = rows.withColumn("_late", F.coalesce(F.window(ts, width)["end"] <= final, F.lit(False))).select(*rows.columns, "_late")
    store.apply_batch(judged.where("_late").drop("_late"), f"{path}/late", batch)
    done, draft = (spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}") for n in (f"timely/part={batch:09d}", f"_draft-{batch}"))
    if not fs.exists(done):
        timely = judged.where("not _late").drop("_late")
        timely.repartitionByRange(max(1, -(-timely.count() // ROWS_A_TASK)), ts).write.mode("overwrite").parquet(draft.toString())
        fs.mkdirs(done.getParent())
        fs.rename(draft, done)
    store.apply_batch(rows.agg(F.lit(batch).cast("long").alias("batch"), F.max(ts).alias("top")), f"{path}/marks", batch)


_PROVIDER, _PARTS = "spark.sql.streaming.stateStore.providerClass", "spark.sql.shuffle.partitions"


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None] | None = None, path: str | None = None, mode: str = "append", rocks: bool = False, parts: int | None = None) -> StreamingQuery:
    """Process what is there and stop: to ``each`` micro-batch, or appended to Parquet at ``path``. ``rocks``: state in RocksDB.

    ``parts``: into how many stores state is dealt, for the checkpoint's life; each is a task and a few files a batch, however little it holds, so few keys want few. Else it is the session's number of shuffle partitions.
    """
    spark = stream.sparkSession
    wanted = ({_PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"} if rocks else {}) | ({_PARTS: str(parts)} if parts else {})
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, x in wanted.items():
        spark.conf.set(name, x)
    try:
        writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query = (writer.foreachBatch(each) if each else writer.format("parquet").option("path", path)).start()
    finally:
        for name, x in before.items():
            spark.conf.set(name, x) if x else spark.conf.unset(name)
    query.awaitTermination()
    return query


def captures(spark: SparkSession, folder: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], each: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None] | None = None, block: int = BLOCK) -> None:
    """New capture files -> words -> ``transform`` -> ``each``; a restart goes on where the checkpoint says.

    Only paths and lengths are streamed; a batch's files are read in ranges of ``block`` samples, so a capture may be of any length.
    ``bad`` gets the batch's files that are no whole traces, with the reason.
    """
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.bin").load(folder)

    def batch(rows: DataFrame, k: int) -> None:
        each(transform(read_ranges(rows, block)), k)
        if bad is not None:
            bad(read_headers(rows).where("error is not null"), k)

    run_available(files.select("path", "length"), checkpoint, batch)
