"""Token ids on disk: fixed-size blocks, shuffled into byte or bit planes, each plane compressed with zstandard.

A store is a folder that Spark writes and reads (``chunks``, Parquet as the container, so writing is atomic and any file
system that Spark knows will do). One row is one block:

    part, chunk          the range partition and the block's number in it: the chunk index
    first                ids of the part before this block
    n_ids, bits          ids in the block, plane kind: 8 (byte planes) or 1 (bit planes)
    planes               array<binary>: the planes, lowest first, zstd frames; planes of zeros at the top are left out
    ordinals, doc_ids, lengths, begins
                         the documents in the block: number in the part, id, ids here, ids of the document before these

Documents lie in ascending doc_id order and run over block edges. A block is decoded alone, so a reader needs neither a
shuffle of ids nor more memory than a block; only the few documents that cross an edge are put together by their checksums.

Cases: null and empty texts are the end id alone; null doc_ids come first; repeated rows are stored as often as they
occur, each with its own ordinal; an empty table gives an empty store; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK, END_ID, LEVEL = 65536, 1, 1
CHUNK_SCHEMA = "part int, chunk int, first long, n_ids int, bits int, planes array<binary>, ordinals array<long>, doc_ids array<long>, lengths array<int>, begins array<long>"


def to_planes(ids, bits: int, level: int = LEVEL) -> list[bytes]:
    """The planes of little-endian uint32 ``ids``, lowest first, without the zero planes on top."""
    import numpy as np
    import zstandard

    ids = np.ascontiguousarray(ids, "<u4")
    used = max(1, int(ids.max(initial=0)).bit_length())
    wide = ids.view(np.uint8).reshape(-1, 4)
    planes = [np.ascontiguousarray(wide[:, k]) for k in range(-(-used // 8))]
    if bits == 1:
        planes = [np.packbits((planes[k // 8] >> (k % 8)) & 1) for k in range(used)]
    squeeze = zstandard.ZstdCompressor(level=level)
    return [squeeze.compress(p.tobytes()) for p in planes]


def from_planes(planes: list[bytes], bits: int, n: int):
    import numpy as np
    import zstandard

    plain = zstandard.ZstdDecompressor()
    wide = np.zeros((n, 4), np.uint8)
    for k, plane in enumerate(planes):
        data = np.frombuffer(plain.decompress(plane), np.uint8)
        if bits == 8:
            wide[:, k] = data
        else:
            wide[:, k // 8] |= np.unpackbits(data, count=n) << (k % 8)
    return wide.view("<u4").reshape(-1)


def write_ids(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID, block: int = BLOCK, bits: int = 8) -> None:
    """Write the ids of every text, in ascending doc_id order, as a store at ``path``."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        from fringeworks.llm.tokens import id_bytes, piece_ids

        ids, end = piece_ids(vocabulary, False), id_bytes([end_id])
        part, chunk, first, ordinal = TaskContext.get().partitionId(), 0, 0, 0
        held, size = [], 0  # (ordinal, doc_id, begin, bytes of ids)

        def flush(whole: bool):
            nonlocal chunk, first, held, size
            rows: list[list] = [[] for _ in range(10)]
            while size >= block or size and whole:
                here, room = [], block
                for k, (o, d, begin, data) in enumerate(held):
                    n = min(room, len(data) // 4)
                    here.append((o, d, begin, data[: 4 * n]))
                    room -= n
                    if 4 * n < len(data):
                        held = [(o, d, begin + n, data[4 * n :]), *held[k + 1 :]]
                        break
                    if not room:
                        held = held[k + 1 :]
                        break
                else:
                    held = []
                n_ids = block - room
                planes = to_planes(np.frombuffer(b"".join(x[3] for x in here), "<u4"), bits)
                for column, value in zip(rows, (part, chunk, first, n_ids, bits, planes, [x[0] for x in here], [x[1] for x in here], [len(x[3]) // 4 for x in here], [x[2] for x in here]), strict=True):
                    column.append(value)
                chunk, first, size = chunk + 1, first + n_ids, size - n_ids
            return rows

        types = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64())]
        names = [x.split(" ")[0] for x in CHUNK_SCHEMA.split(", ")]

        def table(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = memoryview(ids.of(text or "") + end)
                held.append((ordinal, doc_id, 0, data))
                ordinal, size = ordinal + 1, size + len(data) // 4
                if size >= 4 * block:
                    yield table(flush(False))
        yield table(flush(True))

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, CHUNK_SCHEMA).write.option("compression", "none").parquet(f"{path}/chunks")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(f"{path}/chunks")


def read_segments(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """part, ordinal, doc_id, at (ids of the part before), begin, length, ids_crc32 and, if asked for, ids: a row per document and block."""
    schema = "part int, ordinal long, doc_id long, at long, begin long, length int, ids_crc32 long" + ", ids array<int>" * with_ids

    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        kept("planes")
        for batch in batches:
            for row in batch.to_pylist():
                ids = from_planes(row["planes"], row["bits"], row["n_ids"])
                view, out, at = memoryview(ids).cast("B"), [[] for _ in range(7 + with_ids)], 0
                for o, d, begin, n in zip(row["ordinals"], row["doc_ids"], row["begins"], row["lengths"], strict=True):
                    values = [row["part"], o, d, row["first"] + at, begin, n, zlib.crc32(view[4 * at : 4 * (at + n)])]
                    for column, value in zip(out, values + [ids[at : at + n].view("<i4")] * with_ids, strict=True):
                        column.append(value)
                    at += n
                types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split(" ")[0] for x in schema.split(", ")])

    return read_chunks(spark, path).mapInArrow(run, schema)


def joined_crc(first: int, second: int, n_bytes: int) -> int:
    """The CRC-32 of two strings in a row, of which the second has ``n_bytes``: CRC is affine in what came before."""
    zeros = bytes(n_bytes)
    return second ^ zlib.crc32(zeros, first) ^ zlib.crc32(zeros)


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32: one row per stored document."""
    @F.pandas_udf("long")
    def crc_of(parts: pd.Series) -> pd.Series:
        def one(segments) -> int:
            value = 0
            for s in sorted(segments, key=lambda s: s["begin"]):
                value = joined_crc(value, s["ids_crc32"], 4 * s["length"])
            return value

        return parts.map(one)

    # one row a part, so the running sum in a single task stays small
    sizes = read_chunks(spark, path).groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = sizes.select("part", before.alias("before"))
    # a document lies in one part, and within it only those that cross a block edge have more than one segment
    segments = read_segments(spark, path, with_ids=False)
    documents = segments.groupBy("part", "ordinal").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("length").alias("n_tokens"), F.collect_list(F.struct("begin", "length", "ids_crc32")).alias("segments"),
    )
    whole = documents.where("size(segments) = 1").withColumn("ids_crc32", F.col("segments")[0]["ids_crc32"])
    split = documents.where("size(segments) > 1").withColumn("ids_crc32", crc_of("segments"))
    return whole.unionByName(split).join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
