"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

1. One pass over the texts makes blocks of documents. A block holds, for each distinct pre-token in it, the documents that
   have it and how often: an inverted list of per-document frequencies, a byte or two for each pair. A text is first cut
   into chunks at spaces, where a pre-token always begins, and only each distinct chunk of a block is cut into pre-tokens.
2. The lists are dealt to buckets by a hash of the pre-token, one for each 16 MB of text. A bucket meets every block's list of a pre-token, so each
   distinct pre-token is encoded exactly once in the whole job, and a frequent one arrives as one list per block.
3. Frequencies times piece counts, summed per document in the bucket, go back to the blocks as packed partial sums.

What moves is proportional to (document, distinct pre-token) pairs; no task holds more than a bucket or a block, and a block ends with the
text that reaches one of its bounds (documents, distinct chunks, chunks in all), so it is a bounded table and one text.

Cases: a null text is empty and has no tokens; special strings in a text count as the library counts them; repeated rows
are counted each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame

from fringeworks.llm.common import buckets_for

LIMIT = 512
#: A block ends at so many documents, so many distinct chunks, or so many chunks in all.
BLOCK_DOCS, BLOCK_CHUNKS, BLOCK_OCCURRENCES = 8192, 200_000, 2_000_000
_ROW = "bucket int, block long, docs binary, strings binary, lengths binary, df binary, doc binary, n binary"


def _small(values) -> bytes:
    """An array of non-negative integers in its narrowest width, named by the first byte."""
    import numpy as np

    top = int(values.max(initial=0))
    kind = next(k for k in "1248" if top < 1 << (8 * int(k)))
    return kind.encode() + values.astype(f"<u{kind}").tobytes()


def _wide(data: bytes):
    import numpy as np

    return np.frombuffer(data, f"<u{chr(data[0])}", offset=1).astype(np.int64)


class _Block:
    """The documents of a block as numbers of their chunks."""

    def __init__(self, spaced: bool, special: set[str]):
        from fringeworks.llm.tokens import chunks

        self.cut, self.spaced, self.special = chunks, spaced, special
        self.heads: dict[str, int] = {}
        self.body: dict[str, int] = {}
        self.units: list[str] = []
        self.docs: list[tuple] = []
        self.found: list = []
        self.occurrences = 0

    def _number(self, chunk: str, known: dict, space: str) -> int:
        k = known[chunk] = len(self.units)
        self.units.append(space + chunk)
        return k

    def add(self, doc_id, text: str) -> None:
        import numpy as np

        self.docs.append((doc_id, len(text.encode())))
        if not text:
            self.found.append(np.empty(0, np.int32))
            return
        first, *rest = self.cut(text, self.spaced)
        get, body = self.body.get, self.body
        numbers = [self.heads[first] if first in self.heads else self._number(first, self.heads, "")]
        numbers += [k if (k := get(c)) is not None else self._number(c, body, " ") for c in rest]
        self.found.append(np.array(numbers, np.int32))
        self.occurrences += len(numbers)

    def pretokens(self):
        """The distinct pre-tokens, and for each chunk where its own start in one flat list of their numbers."""
        from fringeworks.llm.tokens import split_plain

        known: dict[str, int] = {}
        flat: list[int] = []
        ends: list[int] = []
        for unit in self.units:
            for piece in split_plain(unit, self.spaced, self.special):
                flat.append(known.setdefault(piece, len(known)))
            ends.append(len(flat))
        return list(known), flat, ends

    def rows(self, block: int, buckets: int) -> Iterator[tuple]:
        import numpy as np

        ids, sizes = zip(*self.docs, strict=True)
        has = np.array([d is not None for d in ids])
        values = np.array([0 if d is None else d for d in ids], np.int64)
        yield block % buckets, block, has.astype(np.uint8).tobytes() + values.astype("<i8").tobytes(), b"", b"", b"", b"", _small(np.array(sizes, np.int64))
        names, flat, ends = self.pretokens()
        if not names:
            return
        flat, ends = np.array(flat, np.int64), np.array(ends, np.int64)
        counts = np.diff(ends, prepend=0)
        chunk = np.concatenate(self.found).astype(np.int64)
        doc = np.repeat(np.arange(len(self.docs)), [len(x) for x in self.found])
        # distinct (chunk, document) with their number, then the same by pre-token
        keys, n = np.unique(chunk * len(self.docs) + doc, return_counts=True)
        chunk, doc = keys // len(self.docs), keys % len(self.docs)
        each = counts[chunk]
        at = np.repeat((ends - counts)[chunk], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
        keys, back = np.unique(flat[at] * len(self.docs) + np.repeat(doc, each), return_inverse=True)
        n = np.bincount(back, np.repeat(n, each)).astype(np.int64)
        piece, doc = keys // len(self.docs), keys % len(self.docs)
        df = np.bincount(piece, minlength=len(names))
        start = np.cumsum(df) - df
        encoded = [x.encode() for x in names]
        bucket = np.array([zlib.crc32(x) % buckets for x in encoded])
        for b in np.unique(bucket).tolist():
            own = np.flatnonzero(bucket == b)
            take = np.repeat(start[own], df[own]) + np.arange(df[own].sum()) - np.repeat(np.cumsum(df[own]) - df[own], df[own])
            strings = [encoded[k] for k in own.tolist()]
            yield b, block, b"", b"".join(strings), _small(np.array([len(x) for x in strings])), _small(df[own]), _small(doc[take]), _small(n[take])


def token_counts(docs: DataFrame, vocabulary: str, spaced: bool = True, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit: one row per document."""
    buckets = buckets_for(docs)
    names = [x.split(" ")[0] for x in _ROW.split(", ")]

    def lists(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.tokens import special_strings
        from fringeworks.llm.worker import kept

        kept("frequencies")
        special = special_strings(vocabulary)
        kinds = [pa.int32(), pa.int64(), *[pa.binary()] * 6]
        number, held = TaskContext.get().partitionId() << 24, _Block(spaced, special)

        def flushed():
            for row in held.rows(number, buckets):
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names=names)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.add(doc_id, text or "")
                if len(held.docs) >= BLOCK_DOCS or len(held.units) >= BLOCK_CHUNKS or held.occurrences >= BLOCK_OCCURRENCES:
                    yield from flushed()
                    number, held = number + 1, _Block(spaced, special)
        if held.docs:
            yield from flushed()

    def counted(table):
        """The join within a bucket: its distinct pre-tokens are encoded, and each block's frequencies are weighted."""
        import numpy as np
        import pyarrow as pa

        from fringeworks.llm.tokens import piece_ids

        # distinct in the bucket, so nothing is gained from keeping their ids
        size_of, encode = {}, piece_ids(vocabulary, spaced, 0).encode
        out: list[tuple] = []
        for batch in table.to_batches():
            for row in batch.to_pylist():
                if row["docs"]:
                    out.append((row["block"], row["docs"], b"", row["n"]))
                    continue
                ends = np.cumsum(_wide(row["lengths"])).tolist()
                sizes, begin, data = [], 0, row["strings"]
                for end in ends:
                    piece = data[begin:end]
                    if (k := size_of.get(piece)) is None:
                        k = size_of[piece] = len(encode(piece.decode())) // 4
                    sizes.append(k)
                    begin = end
                weight = np.repeat(np.array(sizes, np.int64), _wide(row["df"])) * _wide(row["n"])
                doc = _wide(row["doc"])
                sums = np.zeros(int(doc.max()) + 1, np.int64)
                np.add.at(sums, doc, weight)
                some = np.flatnonzero(sums)
                out.append((row["block"], b"", _small(some), _small(sums[some])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "docs", "doc", "n"])

    def summed(table):
        import numpy as np
        import pyarrow as pa

        rows = table.to_pylist()
        base = next(r for r in rows if r["docs"])
        sizes = _wide(base["n"])
        count = len(sizes)
        has = np.frombuffer(base["docs"], np.uint8, count).astype(bool)
        ids = np.frombuffer(base["docs"], "<i8", count, offset=count)
        total = np.zeros(count, np.int64)
        for r in rows:
            if not r["docs"]:
                total[_wide(r["doc"])] += _wide(r["n"])
        return pa.table([pa.array(ids, mask=~has), pa.array(sizes), pa.array(total), pa.array(total > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    sums = docs.select("doc_id", "text").mapInArrow(lists, _ROW).groupBy("bucket").applyInArrow(counted, "block long, docs binary, doc binary, n binary")
    return sums.groupBy("block").applyInArrow(summed, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
