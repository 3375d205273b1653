"""The ``phase_trace`` data source: binary captures, read in ranges of words and written one file per trace.

A file is header words and then samples, all little-endian 64-bit. The first word's upper 48 bits are a magic number, its
low 16 the number of header words; header text follows. Reading is split into ranges of ``block`` words, so a capture of many
GB is many tasks. With the option ``pushdown`` bounds on sample_idx and on trace_id go into the scan, and ranges outside them are never
read; it is off unless asked for, because Spark keeps what was pushed for all uses of one loaded DataFrame: load the folder anew for
each use then. Files are opened through pyarrow.fs, so any of its file systems will do.

    spark.dataSource.register(PhaseTraceSource)
    spark.read.format("phase_trace").load(folder)                        # trace_id, sample_idx, word
    spark.read.format("phase_trace").option("mode", "header").load(folder)   # trace_id, header, n_samples, error
    df.write.format("phase_trace").mode("append").save(folder)           # trace_id, header, sample_idx, word
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: The magic number above the low 16 bits, and its mask.
MAGIC, MAGIC_MASK = 0x123456ABCDEF0000, 0xFFFFFFFFFFFF0000
BLOCK = 1 << 22


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _files(path: str, glob: str) -> list[tuple[str, int]]:
    from pyarrow import fs

    system, root = _filesystem(path)
    found = system.get_file_info(root)
    infos = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((i.path, i.size) for i in infos if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, glob) and not i.base_name.startswith(("_", ".")))


def name_of(path: str) -> str:
    return path.rsplit("/", 1)[-1].rsplit(".", 1)[0]


def header_words(first: bytes) -> int | None:
    """The number of header words, or None if the first word isn't the magic one."""
    word = int.from_bytes(first, "little")
    return word & 0xFFFF if len(first) == 8 and word & MAGIC_MASK == MAGIC else None


@dataclass
class Ranges(InputPartition):
    parts: list[tuple[str, int, int, int]]  # path, its bytes, first word, words


#: Headers that a task reads.
HEADERS_A_TASK = 500


class PhaseTraceReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.glob = options["path"], options.get("glob", "*.bin")
        self.block, self.header = int(options.get("block", BLOCK)), options.get("mode") == "header"
        self.low, self.high, self.names, self.push = 0, 1 << 62, None, options.get("pushdown", "false").lower() == "true"

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = getattr(f, "attribute", None) if self.push else None
            if column == ("sample_idx",) and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif column == ("sample_idx",) and isinstance(f, GreaterThan):
                self.low = max(self.low, f.value + 1)
            elif column == ("sample_idx",) and isinstance(f, LessThan):
                self.high = min(self.high, f.value)
            elif column == ("sample_idx",) and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value + 1)
            elif column == ("trace_id",) and isinstance(f, EqualTo):
                self.names = {f.value} if self.names is None else self.names & {f.value}
            elif column == ("trace_id",) and isinstance(f, In):
                self.names = set(f.value) if self.names is None else self.names & set(f.value)
            yield f  # Spark filters again

    def partitions(self) -> list[Ranges]:
        files = [(p, n) for p, n in _files(self.path, self.glob) if self.names is None or name_of(p) in self.names]
        if self.header:
            return [Ranges([(p, n, 0, 0) for p, n in files[k : k + HEADERS_A_TASK]]) for k in range(0, len(files), HEADERS_A_TASK)] or [Ranges([])]
        # short files share a task, long ones are many; a sample lies behind at most 2**16 - 1 header words: ranges surely outside the bounds are left out
        out, room = [Ranges([])], self.block
        for p, n in files:
            words = n // 8
            for first in range(0, words, self.block):
                count = min(self.block, words - first)
                if first + self.block > self.low and first - 0xFFFF < self.high:
                    if count > room:
                        out.append(Ranges([]))
                        room = self.block
                    out[-1].parts.append((p, n, first, count))
                    room -= count
        return out

    def read(self, ranges: Ranges) -> Iterator:
        import numpy as np
        import pyarrow as pa

        system = _filesystem(self.path)[0]
        for path, size, first, count in ranges.parts:
            with system.open_input_file(path) as f:
                head = header_words(f.read_at(8, 0))
                if self.header:
                    text = f.read_at(8 * head - 8, 8).rstrip(b"\0").decode("utf-8", "replace") if head else None
                    error = "not a trace" if head is None else "bytes left over" if size % 8 else None
                    yield pa.RecordBatch.from_arrays([pa.array([name_of(path)]), pa.array([text], pa.string()), pa.array([size // 8 - head if head else None], pa.int64()), pa.array([error], pa.string())], names=["trace_id", "header", "n_samples", "error"])
                    continue
                if head is None:
                    continue
                begin = max(first, head, head + self.low)
                end = min(first + count, head + self.high)
                while begin < end:
                    n = min(1 << 17, end - begin)
                    word = np.frombuffer(f.read_at(8 * n, 8 * begin), "<i8")
                    name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(n, np.int32)), pa.array([name_of(path)])).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([name, pa.array(np.arange(begin - head, begin - head + n)), pa.array(word)], names=["trace_id", "sample_idx", "word"])
                    begin += n


class PhaseTraceWriter(DataSourceArrowWriter):
    """Rows (trace_id, header, sample_idx, word) that come sorted within a partition, each trace whole in one; written column by column."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, batches) -> WriterCommitMessage:
        import numpy as np
        from pyarrow import fs

        system, root = _filesystem(self.path)
        system.create_dir(root, recursive=True)
        name, out, made = None, None, []
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            code = names.indices.to_numpy()
            word = batch.column(3).to_numpy().astype("<i8")
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else []
            for i, j in zip(starts, [*starts[1:], len(code)], strict=True):
                if (new := names.dictionary[int(code[i])].as_py()) != name:
                    if out is not None:
                        out.close()
                    name = new
                    text = batch.column(1)[int(i)].as_py().encode()
                    words = 1 + -(-len(text) // 8)
                    made.append(f"{root}/{name}.bin")
                    out = system.open_output_stream(f"{root}/{name}.bin.part")
                    out.write((MAGIC | words).to_bytes(8, "little") + text.ljust(8 * words - 8, b"\0"))
                out.write(word[i:j].tobytes())
        if out is not None:
            out.close()
        for path in made:  # a name without .part is a whole file
            if system.get_file_info(path).type != fs.FileType.NotFound:
                system.delete_file(path)
            system.move(f"{path}.part", path)
        return WriterCommitMessage()


class PhaseTraceSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "phase_trace"

    def schema(self) -> str:
        return "trace_id string, header string, n_samples long, error string" if self.options.get("mode") == "header" else "trace_id string, sample_idx long, word long"

    def reader(self, schema) -> PhaseTraceReader:
        return PhaseTraceReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> PhaseTraceWriter:
        return PhaseTraceWriter(dict(self.options))


def register(spark) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PhaseTraceSource)


def write_traces(words, path: str) -> None:
    """(trace_id, header, sample_idx, word) as one file per trace."""
    from fringeworks.sources.work import spread

    register(words.sparkSession)
    whole = words.selectExpr("cast(trace_id as string) as trace_id", "header", "sample_idx", "word")
    spread(whole, words.count(), "trace_id").sortWithinPartitions("trace_id", "sample_idx").select("trace_id", "header", "sample_idx", "word").write.format("phase_trace").mode("append").save(path)
