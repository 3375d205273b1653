"""Exact repeats of at least ``least`` bytes over all texts: enhanced suffix arrays of the places where a repeat can be.

Removal (``remove_repeats``):

1. One pass over the texts cuts each into blocks of windows (``least`` bytes each) that share a minimizer: the smallest
   hash of a ``GRAM``-byte string in the window. Equal windows have equal minimizers, so only blocks whose minimizer occurs
   twice can hold a repeat. Blocks are dealt by minimizer as numbers, not text: about 20 bytes for each 35 of text.
2. Equal blocks are a repeat as they stand: all but the first are covered whole, however many there are. Of the rest, the
   first of each kind, the bytes are fetched and dealt by minimizer again: the suffixes that can begin a repeat.
3. A bucket sorts these suffixes (prefix doubling), takes the common prefixes of neighbours and scans them with a stack: the
   tree of common-prefix intervals of at least ``least`` bytes. Where intervals merge, every member that is not the first
   occurrence is settled once, with the longest prefix it shares with an earlier one, so the scan is linear.
4. What is covered goes back to the documents as spans.

A frequent minimizer, as a passage has that a third of the texts share, isn't one bucket's work: equal blocks are settled where they meet, first in the
task that reads the texts, and the blocks of minimizers that fill a quarter of a bucket (``_frequent``) are dealt by their identity. A minimizer with more
than ``HOT`` different blocks is compared by window: each task first settles its own equal windows. Over ``DEALT`` buckets records are dealt in two
rounds, so that what a task sends grows with the root of the number of buckets. Nothing is capped or left out.

Maximal repeats (``maximal_repeats``): every string of ``least`` bytes or more that occurs twice and whose occurrences neither all follow
the same byte nor all go before the same byte, with all its occurrences, once and at its full length:

1. Of the blocks as above each different one is kept once, with its number of copies and the range of the bytes on their left;
   its windows are counted, which gives the windows that occur twice and those whose left bytes differ.
2. A maximal repeat begins with a window of the second kind and lies in a run of windows of the first kind. So each place of such
   a window is a suffix, cut where its run ends; nothing that repeats goes beyond it.
3. Suffixes are dealt by their first window, equal ones as one with its number, and sorted; the stack scan gives the intervals of
   common prefixes, and those with differing left bytes are the maximal repeats, however many blocks they run over.
4. Their occurrences are joined back, a row each.

Blocks and windows are told apart by 64 or 128 bits of their bytes, without structure.

"First" is by (doc_id, begin), null ids before all others, and rows repeated with the same doc_id in their order. Null and empty texts have no bytes; texts
under ``least`` bytes hold no repeat; texts of any length are worked on whole; an empty table gives an empty result;
other columns are ignored, and one whose name starts with ``_fw_`` is refused. ``least`` is at most 124 for removal, where prefixes are compared up to 192 bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import BUCKET_TEXT, ROW, buckets_of, numbered, temporaries, text_size, written
from fringeworks.llm.words import _POWERS, _VALUES, mixed, numbers, slices

#: Bytes of a repeat and of a minimizer's string; blocks of one minimizer that a task sorts; bytes of a table that is broadcast.
LEAST, GRAM, HOT, MOST_SENT = 100, 32, 50_000, 64 << 20
#: Blocks that a task gathers before it sends them, and bytes of text likewise.
BLOCK_RECORDS, BLOCK_BYTES = 1_500_000, 32 << 20
#: Bytes of text to a block, about; sampled records of a bucket; records of a minimizer that is split at the least, and such minimizers at most
#: (the most frequent ones); buckets that are dealt in one round.
BLOCK_TEXT, SAMPLED, SPLIT, MOST_SPLIT, DEALT = 35, 200, 1000, 1 << 20, 4096
_RECORD = np.dtype([("a", "<u8"), ("same", "<u8"), ("row", "<i8"), ("begin", "<i8"), ("extra", "<u2")])
_FETCH = np.dtype([("a", "<u8"), ("begin", "<i8"), ("extra", "<u2"), ("hot", "u1")])
_CONTEXT = np.dtype([("a", "<u8"), ("row", "<i8"), ("doc", "<i8"), ("has", "u1"), ("begin", "<i8"), ("extra", "<u2"), ("left", "<i2")])
_SPAN = np.dtype([("row", "<i8"), ("begin", "<i8"), ("length", "<i8")])


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row."""
    n = len(values) - width + 1
    rows = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    before = np.minimum.accumulate(rows, 1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def blocks_of(data: np.ndarray, bounds: np.ndarray, least: int, gram: int):
    """text, begin, extra windows, minimizer and identity of the blocks of several texts in a row."""
    n = len(data)
    if n < least:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),) * 2
    up, down = _POWERS.get(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[data] * up[:n], out=total[1:])
    h = mixed((total[gram:] - total[:-gram]) * down[: n - gram + 1])
    chosen = sliding_least((h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64), least - gram + 1) & np.uint64(0xFFFFFFFF)
    edge = np.zeros(len(chosen) + 1, np.int32)
    np.add.at(edge, np.minimum(np.maximum(bounds[1:] - least + 1, np.r_[0, bounds[1:-1]]), len(chosen)), 1)
    np.add.at(edge, np.minimum(bounds[1:], len(chosen)), -1)
    valid = np.cumsum(edge[:-1]) == 0
    differ = chosen[1:] != chosen[:-1]
    begin = np.flatnonzero(valid & np.r_[True, differ | ~valid[:-1]])
    end = np.flatnonzero(valid & np.r_[differ | ~valid[1:], True])
    at = chosen[begin].astype(np.int64)
    text = numbers(data, begin, end + least, least + len(data))
    same = mixed(text + (at - begin).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
    row = np.searchsorted(bounds, begin, "right") - 1
    return row, begin - bounds[row], end - begin, h[at], same


def _dealt(values: np.ndarray, where: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(where, kind="stable")
    ends = np.searchsorted(where[order], np.arange(buckets + 1)).tolist()
    for b in range(buckets):
        if ends[b] < ends[b + 1]:
            yield b, values[order[ends[b] : ends[b + 1]]]


def _squeezed(ids: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<i8").tobytes(), 1)


def _about(rows: np.ndarray, docs: np.ndarray, has: np.ndarray) -> list[bytes]:
    return [_squeezed(rows), _squeezed(docs), zlib.compress(has.astype(np.uint8).tobytes(), 1)]


def _combined(records: np.ndarray, rows: np.ndarray, docs: np.ndarray, has: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of equal blocks the first, and the spans of the others; ``rows`` ascend, with the doc_id of each."""
    order = np.argsort(records["same"])
    twice = records["same"][order]
    twice = twice[1:] == twice[:-1]
    some = np.zeros(len(records), bool)
    some[order[1:][twice]] = some[order[:-1][twice]] = True
    where = np.flatnonzero(some)
    r = records[where]
    at = np.searchsorted(rows, r["row"])
    order = np.lexsort((r["begin"], r["row"], docs[at], has[at], r["same"], r["a"]))
    r, where = r[order], where[order]
    later = np.zeros(len(r), bool)
    later[1:] = (r["a"][1:] == r["a"][:-1]) & (r["same"][1:] == r["same"][:-1])
    spans = np.empty(int(later.sum()), _SPAN)
    spans["row"], spans["begin"], spans["length"] = r["row"][later], r["begin"][later], r["extra"][later] + np.int64(least)
    keep = np.ones(len(records), bool)
    keep[where[later]] = False
    return records[keep], _merged(spans)


def _frequent_among(a: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``a`` are in the ascending ``frequent``, and where."""
    if not len(frequent):
        return np.zeros(len(a), bool), np.zeros(len(a), np.int64)
    at = np.minimum(np.searchsorted(frequent, a), len(frequent) - 1)
    return frequent[at] == a, at


class _Deal:
    """Records on their way to buckets: by minimizer, those of a frequent one by block; equal blocks that meet on the way are settled."""

    def __init__(self, least: int, buckets: int, frequent: np.ndarray):
        self.least, self.buckets, self.frequent = least, buckets, frequent
        self.clear()

    def clear(self) -> None:
        self.records: list[np.ndarray] = []
        self.about: list[tuple] = []
        self.count = 0

    def add(self, records: np.ndarray) -> None:
        self.records.append(records)
        self.count += len(records)

    def flushed(self, width: int = 1) -> Iterator:
        """A message for each ``width`` buckets that have records, and one with the spans settled here."""
        records = np.concatenate(self.records)
        rows, docs, has = (np.concatenate([x[k] for x in self.about]) for k in range(3))
        self.clear()
        rows, first = np.unique(rows, return_index=True)  # a task may read several files, in whatever order
        docs, has = docs[first], has[first]
        records, spans = _combined(records, rows, docs, has, self.least)
        key = records["a"].copy()
        often, _ = _frequent_among(key, self.frequent)
        key[often] = records["same"][often]
        where = (key % np.uint64(self.buckets * 127)) // np.uint64(127) // np.uint64(width)
        count = -(-self.buckets // width)
        for b, part in _dealt(records, where, count):
            own = np.unique(np.searchsorted(rows, part["row"]))
            yield _message(b, *_about(rows[own], docs[own], has[own]), part.tobytes())
        if len(spans):
            yield _message(int(spans["row"][0]) % count, spans.tobytes(), b"", b"", b"")


_MESSAGE = "bucket int, rows binary, docs binary, has binary, records binary"


def _message(bucket: int, *data: bytes):
    import pyarrow as pa

    names = [x.split(" ")[0] for x in _MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *[pa.array([x], pa.binary()) for x in data]], names=names)


def _frequent(docs: DataFrame, least: int, gram: int, buckets: int, size: int, split: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimizers of about a quarter of a bucket's records or more (and ``split``), ascending, and how many each has.

    Estimated on every so many-th text, a share that leaves about 200 records of each bucket however many there are. What it misses or adds
    makes buckets less even and changes no result.
    """
    each = size // (BLOCK_TEXT * buckets)
    step = max(1, each // SAMPLED)
    enough = max(each // 4, split) // step

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for _, data, bounds in slices(b.column(0), 1 << 19):
                a, n = np.unique(blocks_of(data, bounds, least, gram)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(n.astype(np.int64))], names=["a", "n"])

    counts = docs.where(F.pmod(F.xxhash64(ROW), F.lit(step)) == 0).select("text").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n"))
    found = counts.where(F.col("n") >= max(2, enough)).orderBy(F.desc("n"), "a").limit(MOST_SPLIT).collect()
    a, n = np.array([r["a"] for r in found], np.int64).view(np.uint64), np.array([r["n"] * step for r in found], np.int64)
    order = np.argsort(a)
    return a[order], n[order]


def _records(docs: DataFrame, least: int, gram: int, buckets: int, frequent: np.ndarray, dealt: int = DEALT, gathered: int = BLOCK_RECORDS) -> DataFrame:
    """Messages for buckets. Over ``dealt`` buckets they go in two rounds, first for about the root of their number together."""
    width = 1 if buckets <= dealt else int(np.ceil(np.sqrt(buckets)))

    def run(batches) -> Iterator:
        from fringeworks.llm.worker import kept

        kept("blocks")
        deal = _Deal(least, buckets, frequent)
        for b in batches:
            uid, doc = b.column(0).to_numpy(), b.column(1)
            deal.about.append((uid, doc.fill_null(0).to_numpy(zero_copy_only=False), doc.is_valid().to_numpy(zero_copy_only=False)))
            for row, data, bounds in slices(b.column(2), 1 << 19):
                at, begin, extra, a, same = blocks_of(data, bounds, least, gram)
                records = np.empty(len(at), _RECORD)
                for name, value in zip(_RECORD.names, (a, same, uid[row + at], begin, extra), strict=True):
                    records[name] = value
                deal.add(records)
            if deal.count >= gathered:
                yield from deal.flushed(width)
        if deal.count:
            yield from deal.flushed(width)

    def again(batches) -> Iterator:
        deal = _Deal(least, buckets, frequent)
        for batch in batches:
            for r in batch.to_pylist():
                if not r["records"]:  # spans, settled before
                    yield _message(r["bucket"], r["rows"], b"", b"", b"")
                    continue
                deal.about.append((_unsqueezed(r["rows"]), _unsqueezed(r["docs"]), np.frombuffer(zlib.decompress(r["has"]), np.uint8)))
                deal.add(np.frombuffer(r["records"], _RECORD))
                if deal.count >= gathered:
                    yield from deal.flushed()
        if deal.count:
            yield from deal.flushed()

    messages = docs.select(ROW, "doc_id", "text").mapInArrow(run, _MESSAGE)
    return messages if width == 1 else messages.repartition(-(-buckets // width), "bucket").mapInArrow(again, _MESSAGE)


def _unsqueezed(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))


def _parts(rows: np.ndarray) -> np.ndarray:
    """The task that read a row: what monotonically_increasing_id puts above its 33 bits."""
    return rows >> 33


def _packed_by_part(spans: np.ndarray) -> list[tuple[int, bytes]]:
    if not len(spans):
        return []
    part = _parts(spans["row"])
    order = np.argsort(part, kind="stable")
    names, begins = np.unique(part[order], return_index=True)
    return [(int(p), spans[order[i:j]].tobytes()) for p, i, j in zip(names, begins, [*begins[1:], len(order)], strict=True)]


def _settle(least: int, hot: int, frequent: np.ndarray, counts: np.ndarray):
    def run(table):
        """In a bucket: blocks that an earlier equal one covers (kind 1), and those whose bytes must be compared (kind 2)."""
        import pyarrow as pa

        out: list[tuple] = []
        found, docs, has = [], [], []
        for batch in table.to_batches():
            for r in batch.to_pylist():
                if not r["records"]:
                    out += [(p, 1, data) for p, data in _packed_by_part(np.frombuffer(r["rows"], _SPAN))]
                    continue
                records = np.frombuffer(r["records"], _RECORD)
                rows = _unsqueezed(r["rows"])
                at = np.searchsorted(rows, records["row"])
                found.append(records)
                docs.append(_unsqueezed(r["docs"])[at])
                has.append(np.frombuffer(zlib.decompress(r["has"]), np.uint8)[at])
        records, docs, has = (np.concatenate(x) if x else np.empty(0, t) for x, t in ((found, _RECORD), (docs, np.int64), (has, np.uint8)))
        order = np.argsort(records["a"], kind="stable")
        a = records["a"][order]
        twice = np.zeros(len(a), bool)
        twice[1:] = a[1:] == a[:-1]
        twice[:-1] |= twice[1:]
        order = order[twice | _frequent_among(a, frequent)[0]]  # a frequent minimizer's other blocks may be in other buckets
        if len(order):
            r = records[order]
            again = np.lexsort((r["begin"], r["row"], docs[order], has[order], r["same"], r["a"]))
            r = r[again]
            first_a = np.r_[True, r["a"][1:] != r["a"][:-1]]
            first = first_a | np.r_[True, r["same"][1:] != r["same"][:-1]]
            group = np.cumsum(first_a) - 1
            different = np.add.reduceat(first.astype(np.int64), np.flatnonzero(first_a))[group]
            spans = np.empty(int((~first).sum()), _SPAN)
            spans["row"], spans["begin"], spans["length"] = r["row"][~first], r["begin"][~first], r["extra"][~first] + np.int64(least)
            out += [(p, 1, data) for p, data in _packed_by_part(spans)]
            often, at = _frequent_among(r["a"], frequent)
            open_ = first & (often | (different > 1))
            many = np.where(often, counts[at] if len(counts) else 0, different)[open_] > hot
            open_ = r[open_]
            part = _parts(open_["row"])
            for p in np.unique(part).tolist():
                own = part == p
                fetch = np.empty(int(own.sum()), [("row", "<i8"), *_FETCH.descr])
                for name in ("row", "a", "begin", "extra"):
                    fetch[name] = open_[name][own]
                fetch["hot"] = many[own]
                out.append((p, 2, fetch.tobytes()))
        columns = list(zip(*out, strict=True)) if out else [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary()), strict=True)], names=["part", "kind", "data"])

    return run


def _by_row(table):
    """What to fetch, a row of bytes for each text."""
    import pyarrow as pa

    fetch = np.concatenate([np.frombuffer(x, [("row", "<i8"), *_FETCH.descr]) for x in table.column("data").to_pylist()])
    fetch = fetch[np.argsort(fetch["row"], kind="stable")]
    names, begins = np.unique(fetch["row"], return_index=True)
    plain = np.empty(len(fetch), _FETCH)
    for name in _FETCH.names:
        plain[name] = fetch[name]
    data = [plain[i:j].tobytes() for i, j in zip(begins, [*begins[1:], len(plain)], strict=True)]
    return pa.table([pa.array(names), pa.array(data, pa.binary())], names=[ROW, "fetch"])


def _contexts(least: int, buckets: int):
    def run(batches) -> Iterator:
        """The bytes of the blocks to compare, dealt by minimizer; those of hot ones window by window."""
        import pyarrow as pa

        about: list[tuple] = []
        texts: list[bytes] = []
        seen: dict[bytes, tuple] = {}
        covered: list[tuple] = []
        size = 0

        def flushed():
            for key, (has, doc, row, begin, left) in seen.items():
                about.append((zlib.crc32(key), row, doc, has, begin, 0, left))
                texts.append(key)
            made = np.array(about, _CONTEXT)
            for b, own in _dealt(np.arange(len(made)), (made["a"] % np.uint64(buckets * 127)) // np.uint64(127), buckets):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([made[own].tobytes()], pa.binary()), pa.array([b"".join(texts[k] for k in own.tolist())], pa.binary())], names=["bucket", "about", "texts"])
            if covered:  # settled here: passed on as they are
                spans = np.array(covered, _SPAN)
                yield pa.RecordBatch.from_arrays([pa.array([int(spans["row"][0]) % buckets], pa.int32()), pa.array([b""], pa.binary()), pa.array([spans.tobytes()], pa.binary())], names=["bucket", "about", "texts"])

        for batch in batches:
            for row, doc, text, fetch in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                data = text.encode()
                has, doc = doc is not None, doc or 0
                for a, begin, extra, hot in np.frombuffer(fetch, _FETCH).tolist():
                    if not hot:
                        about.append((a, row, doc, has, begin, extra, data[begin - 1] if begin else -1))
                        texts.append(data[begin : begin + extra + least])
                        size += extra + least
                        continue
                    for at in range(begin, begin + extra + 1):
                        key, mine = data[at : at + least], (has, doc, row, at, data[at - 1] if at else -1)
                        known = seen.get(key)
                        if known is None:
                            seen[key] = mine
                            size += least
                        else:
                            seen[key] = min(known, mine)
                            covered.append((*max(known, mine)[2:4], least))
                if size >= BLOCK_BYTES:
                    yield from flushed()
                    about, texts, seen, covered, size = [], [], {}, [], 0
        if about or seen or covered:
            yield from flushed()

    return run


def suffix_array(text: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """The order of the suffixes of ``text`` at ``at`` by their first 192 bytes, and ranks of 8, 16, 32 and 64 bytes everywhere."""
    n = len(text)
    padded = np.zeros(n + 256, np.uint8)
    padded[:n] = text
    word = np.zeros(n + 192, np.uint64)
    for k in range(8):
        word = (word << np.uint64(8)) | padded[k : k + n + 192]
    ranks = [np.unique(word, return_inverse=True)[1].astype(np.uint64)]
    for step in (8, 16, 32):
        last = ranks[-1]
        pair = last << np.uint64(32)
        pair[:-step] |= last[step:]
        ranks.append(np.unique(pair, return_inverse=True)[1].astype(np.uint64))
    r = ranks[-1]
    pair = np.unique((r[at] << np.uint64(32)) | r[at + 64], return_inverse=True)[1].astype(np.uint64)
    return np.argsort((pair << np.uint64(32)) | r[at + 128], kind="stable"), ranks, [padded]


def common_prefixes(ranks: list[np.ndarray], padded: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The common prefixes, of up to 192 bytes, of the suffixes at a and b."""
    n = np.zeros(len(a), np.int64)
    for step, rank in ((64, ranks[3]), (64, ranks[3]), (64, ranks[3]), (32, ranks[2]), (16, ranks[1]), (8, ranks[0]), (4, None), (2, None), (1, None)):
        if rank is None:
            same = np.ones(len(a), bool)
            for k in range(step):
                same &= padded[a + n + k] == padded[b + n + k]
        else:
            same = rank[np.minimum(a + n, len(rank) - 1)] == rank[np.minimum(b + n, len(rank) - 1)]
        # a longer step can only follow equal ones before it
        n += np.where(same & (n + step <= 192), step, 0)
    return n


def interval_tree(prefix: list[int], order: list[int], left: list[int], least: int, groups: list | None = None):
    """Stack scan of neighbours' common prefixes (``prefix[i]``: of members i - 1 and i; prefix[0] is 0) with all values >= least.

    Returns (member, length) of every member but the first: the longest prefix that it shares with an earlier one by ``order``.
    ``groups`` gets (length, first and last member, left-diverse) of every interval; ``left`` has the byte before
    each member, and a negative one stands for none.
    """
    settled, stack = [], []
    for i in range(1, len(order) + 1):
        now = prefix[i] if i < len(order) else 0
        best, begin, byte, diverse = i - 1, i - 1, left[i - 1], left[i - 1] < 0
        while stack and stack[-1][0] > now:
            length, other, begin, other_byte, other_diverse = stack.pop()
            if order[other] < order[best]:
                other, best = best, other
            settled.append((other, length))
            diverse = diverse or other_diverse or byte != other_byte
            byte = other_byte
            if groups is not None:
                groups.append((length, begin, i - 1, diverse))
        if stack and stack[-1][0] == now:
            length, other, begin, other_byte, other_diverse = stack.pop()
            if order[other] < order[best]:
                other, best = best, other
            settled.append((other, length))
            stack.append((length, best, begin, other_byte, diverse or other_diverse or byte != other_byte))
        elif now >= least:
            stack.append((now, best, begin, byte, diverse))
    return settled


def _compare(least: int):
    def run(table):
        import pyarrow as pa

        spans: list[np.ndarray] = []
        abouts, texts = [], []
        for batch in table.to_batches():
            for r in batch.to_pylist():
                if r["about"]:
                    abouts.append(np.frombuffer(r["about"], _CONTEXT))
                    texts.append(np.frombuffer(r["texts"], np.uint8))
                elif r["texts"]:
                    spans.append(np.frombuffer(r["texts"], _SPAN))
        if abouts:
            about, flat = np.concatenate(abouts), np.concatenate(texts)
            # eight bytes of the block's own number after each block: a prefix ends where its block does
            sizes = about["extra"].astype(np.int64) + least
            begin = np.cumsum(sizes + 8) - (sizes + 8)
            text = np.zeros(int((sizes + 8).sum()), np.uint8)
            inside = np.ones(len(text), bool)
            marks = (begin + sizes)[:, None] + np.arange(8)
            inside[marks.ravel()] = False
            text[inside] = flat
            text[marks] = np.arange(len(about), dtype=">u8").view(np.uint8).reshape(-1, 8)
            count = about["extra"].astype(np.int64) + 1
            block = np.repeat(np.arange(len(about)), count)
            offset = np.arange(len(block)) - np.repeat(np.cumsum(count) - count, count)
            at = begin[block] + offset
            order, ranks, (padded,) = suffix_array(text, at)
            at, block, offset = at[order], block[order], offset[order]
            rest = sizes[block] - offset
            prefix = np.zeros(len(at), np.int64)
            prefix[1:] = np.minimum(common_prefixes(ranks, padded, at[:-1], at[1:]), np.minimum(rest[:-1], rest[1:]))
            where = about["begin"][block] + offset
            earlier = np.empty(len(at), np.int64)
            earlier[np.lexsort((where, about["row"][block], about["doc"][block], about["has"][block]))] = np.arange(len(at))
            left = np.where(offset == 0, about["left"][block], text[at - 1].astype(np.int64))
            joined = prefix >= least
            heads = np.flatnonzero(joined & ~np.r_[False, joined[:-1]]) - 1
            ends = np.flatnonzero(joined & ~np.r_[joined[1:], False]) + 1
            member, length = [], []
            pairs = ends - heads == 2  # a tree of one interval
            h = heads[pairs]
            member.append(np.where(earlier[h] < earlier[h + 1], h + 1, h))
            length.append(prefix[h + 1])
            for i, j in zip(heads[~pairs].tolist(), ends[~pairs].tolist(), strict=True):
                settled = interval_tree([0, *prefix[i + 1 : j].tolist()], earlier[i:j].tolist(), left[i:j].tolist(), least)
                member.append(i + np.array([x for x, _ in settled], np.int64))
                length.append(np.array([x for _, x in settled], np.int64))
            member, length = np.concatenate(member), np.concatenate(length)
            made = np.empty(len(member), _SPAN)
            made["row"], made["begin"], made["length"] = about["row"][block[member]], where[member], length
            spans.append(_merged(made))
        out = _packed_by_part(np.concatenate(spans)) if spans else []
        return pa.table([pa.array([p for p, _ in out], pa.int64()), pa.array([1] * len(out), pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["part", "kind", "data"])

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Spans of the same row that touch or overlap become one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["begin"], spans["row"]))]
    row, begin, end = spans["row"], spans["begin"], spans["begin"] + spans["length"]
    first_of_row = np.r_[True, row[1:] != row[:-1]]
    # ends only grow within a row: running maxima of (row number, end) as one number
    shift = np.int64(max(1, int(end.max()) + 1))
    ordinal = np.cumsum(first_of_row) - 1
    reach = np.maximum.accumulate(ordinal * shift + end)
    fresh = first_of_row | np.r_[True, ordinal[1:] * shift + begin[1:] > reach[:-1]]
    heads = np.flatnonzero(fresh)
    out = np.empty(len(heads), _SPAN)
    out["row"], out["begin"] = row[heads], begin[heads]
    out["length"] = reach[np.r_[heads[1:] - 1, len(spans) - 1]] - ordinal[heads] * shift - begin[heads]
    return out


def _row_spans(table):
    import pyarrow as pa

    spans = _merged(np.concatenate([np.frombuffer(x, _SPAN) for x in table.column("data").to_pylist()]))
    names, begins = np.unique(spans["row"], return_index=True)
    bounds = np.r_[begins, len(spans)].astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(spans[c])) for c in ("begin", "length")]
    return pa.table([pa.array(names), *lists], names=[ROW, "begins", "lengths"])


def _fitting(df: DataFrame, size) -> DataFrame:
    """``df`` with a broadcast hint if ``size`` of its rows adds up to at most MOST_SENT bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= MOST_SENT else df


def _suffixes(docs: DataFrame, least: int, gram: int, hot: int, split: int = SPLIT, dealt: int = DEALT) -> tuple[DataFrame, DataFrame]:
    """What step 2 settles, and the suffixes for step 3."""
    size = text_size(docs)
    buckets = buckets_of(docs.sparkSession, size)
    frequent, counts = _frequent(docs, least, gram, buckets, size, split)
    records = _records(docs, least, gram, buckets, frequent, dealt)
    settled = written(records.groupBy("bucket").applyInArrow(_settle(least, hot, frequent, counts), "part long, kind int, data binary"), "settled")
    fetch = written(settled.where("kind = 2").groupBy("part").applyInArrow(_by_row, f"{ROW} long, fetch binary"), "fetch")
    texts = docs.select(ROW, "doc_id", "text").join(_fitting(fetch, F.octet_length("fetch") + 32), ROW).select(ROW, "doc_id", "text", "fetch")
    return settled.where("kind = 1"), texts.mapInArrow(_contexts(least, 4 * buckets), "bucket int, about binary, texts binary")


def _spans(docs: DataFrame, least: int, gram: int, hot: int, split: int = SPLIT, dealt: int = DEALT) -> DataFrame:
    """_fw_row, begins, lengths: the bytes of each text that lie in a string of ``least`` bytes which also begins earlier, as longest spans."""
    if least > 124:
        raise ValueError("removal compares prefixes of up to 192 bytes: least may be 124")
    covered, suffixes = _suffixes(docs, least, gram, hot, split, dealt)
    compared = suffixes.groupBy("bucket").applyInArrow(_compare(least), "part long, kind int, data binary")
    return covered.unionByName(compared).groupBy("part").applyInArrow(_row_spans, f"{ROW} long, begins array<long>, lengths array<long>")


def remove_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT, split: int = SPLIT, dealt: int = DEALT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that stay): one row per document."""
    docs = numbered(docs, "doc_id", "text")
    with temporaries(docs.sparkSession) as kept:
        spans = kept(_spans(docs, least, gram, hot, split, dealt), "spans")
    texts = docs.select(ROW, "doc_id", "text").join(_fitting(spans, F.size("begins") * 16 + 32), ROW, "left").select("doc_id", "text", "begins", "lengths")

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text, begins, lengths in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data = (text or "").encode()
                parts, at = [], 0
                for begin, length in zip(begins or (), lengths or (), strict=True):
                    parts.append(data[at:begin])
                    at = begin + length
                kept = b"".join([*parts, data[at:]])
                for column, value in zip(out, (doc_id, len(data), len(data) - len(kept), len(parts), hashlib.sha256(kept).hexdigest(), kept), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return texts.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _rows_of(columns: list[list], schema: str):
    import pyarrow as pa

    kinds = {"binary": pa.binary(), "long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    names, types = zip(*(x.split(" ") for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names=list(names))


def _name(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


_BLOCK_ROWS = f"{ROW} long, minimizer long, block binary, begin long, extra int, left int"
_WINDOWS = "window binary, block binary, offset int, n long, low int, high int"
_STARTS = f"window binary, {ROW} long, doc_id long, begin long, left int, context binary"
_MEMBERS = "repeat string, length long, window binary, key string"


def _block_rows(least: int, gram: int):
    def run(batches) -> Iterator:
        for b in batches:
            rows = b.column(0).to_pylist()
            for first, data, bounds in slices(b.column(1), 1 << 19):
                at, begin, extra, minimizer, _ = blocks_of(data, bounds, least, gram)
                whole = data.tobytes()
                places = (bounds[at] + begin).tolist()
                names = [_name(whole[p : p + n + least]) for p, n in zip(places, extra.tolist(), strict=True)]
                left = np.where(begin > 0, data[np.maximum(bounds[at] + begin - 1, 0)].astype(np.int32), -1) if len(at) else np.empty(0, np.int32)
                yield _rows_of([[rows[first + k] for k in at.tolist()], minimizer.view(np.int64), names, begin, extra.astype(np.int32), left], _BLOCK_ROWS)

    return run


def _windows(least: int):
    """Of each different block, its windows with the number of copies and the range of the bytes on their left."""

    def run(batches) -> Iterator:
        for b in batches:
            for text, kinds in zip(*(b.column(k).to_pylist() for k in range(2)), strict=True):
                data, out = text.encode(), [[] for _ in range(6)]
                for kind in kinds:
                    for k in range(kind["extra"] + 1):
                        at = kind["begin"] + k
                        low, high = (data[at - 1],) * 2 if k else (kind["low"], kind["high"])
                        for column, value in zip(out, (_name(data[at : at + least]), kind["block"], k, kind["n"], low, high), strict=True):
                            column.append(value)
                yield _rows_of(out, _WINDOWS)

    return run


def _starts(least: int):
    """A text's places of windows with differing left bytes, each with the text up to where its run of repeated bytes ends."""

    def run(batches) -> Iterator:
        for b in batches:
            for row, doc, text, found in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                data, out = text.encode(), [[] for _ in range(6)]
                hits = sorted((f["begin"] + h["offset"], h["window"]) for f in found for h in f["hits"])
                end = after = -1
                for at, window in reversed(hits):
                    if at + 1 != after:  # the last window of a run
                        end = at + least
                    after = at
                    if window is not None:
                        for column, value in zip(out, (window, row, doc, at, data[at - 1] if at else -1, data[at:end]), strict=True):
                            column.append(value)
                yield _rows_of(out, _STARTS)

    return run


def _tree(least: int):
    """The maximal repeats among the suffixes of a bucket: each with the suffixes that begin with it."""

    def run(table):
        import pyarrow as pa

        rows = sorted(table.to_pylist(), key=lambda r: r["context"])
        member: list[int] = []  # a suffix that occurs several times stands twice
        prefix: list[int] = []
        for k, r in enumerate(rows):
            member.append(k)
            prefix.append(_common(rows[k - 1]["context"], r["context"]) if k else 0)
            if r["n"] > 1:
                member.append(k)
                prefix.append(len(r["context"]))
        left = [rows[k]["low"] if rows[k]["low"] == rows[k]["high"] else -1 for k in member]
        groups: list[tuple] = []
        interval_tree([n if n >= least else 0 for n in prefix], list(range(len(member))), left, least, groups)
        out: list[list] = [[] for _ in range(4)]
        for length, first, last, diverse in groups:
            if diverse:
                name = _name(rows[member[first]]["context"][:length]).hex()
                for k in range(member[first], member[last] + 1):
                    for column, value in zip(out, (name, length, rows[k]["window"], rows[k]["key"]), strict=True):
                        column.append(value)
        return pa.Table.from_batches([_rows_of(out, _MEMBERS)])

    return run


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


def maximal_repeats(docs: DataFrame, least: int = LEAST, gram: int = GRAM) -> DataFrame:
    """repeat_id (of the string's bytes), length, row, doc_id, begin: the occurrences of all maximal repeats, a row each.

    Suffixes that are equal up to the end of their run are one in the tree, so a passage that many documents share is one member; the
    different ones that begin with the same window are one task's work.
    """
    docs = numbered(docs, "doc_id", "text")
    blocks = written(docs.select(ROW, "text").mapInArrow(_block_rows(least, gram), _BLOCK_ROWS), "blocks")
    kinds = blocks.groupBy("minimizer", "block").agg(F.min(F.struct(ROW, "begin", "extra")).alias("one"), F.count(F.lit(1)).alias("n"), F.min("left").alias("low"), F.max("left").alias("high"))
    kinds = written(kinds, "kinds")
    often = kinds.groupBy("minimizer").agg(F.sum("n").alias("all")).where("all > 1").select("minimizer")
    wanted = kinds.join(often, "minimizer").select(f"one.{ROW}", F.struct("block", "one.begin", "one.extra", "n", "low", "high").alias("kind"))
    wanted = wanted.groupBy(ROW).agg(F.collect_list("kind").alias("kinds"))
    windows = written(docs.join(wanted, ROW).select("text", "kinds").mapInArrow(_windows(least), _WINDOWS), "windows")
    classes = windows.groupBy("window").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).where("n > 1")
    hits = windows.select("window", "block", "offset").join(classes.select("window", F.expr("low < 0 or low <> high").alias("open")), "window")
    hits = hits.groupBy("block").agg(F.collect_list(F.struct("offset", F.when(F.col("open"), F.col("window")).alias("window"))).alias("hits"))
    places = blocks.join(hits, "block").groupBy(ROW).agg(F.collect_list(F.struct("begin", "hits")).alias("found"))
    starts = docs.join(places, ROW).select(ROW, "doc_id", "text", "found").mapInArrow(_starts(least), _STARTS)
    starts = written(starts.withColumn("key", F.sha2("context", 256)), "starts")
    suffixes = starts.groupBy("window", "key").agg(F.min("context").alias("context"), F.count(F.lit(1)).alias("n"), F.min("left").alias("low"), F.max("left").alias("high"))
    suffixes = written(suffixes, "suffixes")
    size = suffixes.agg(F.sum(F.octet_length("context"))).first()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // BUCKET_TEXT)
    bucket = F.pmod(F.xxhash64("window"), F.lit(buckets)).alias("bucket")
    members = suffixes.select("*", bucket).groupBy("bucket").applyInArrow(_tree(least), _MEMBERS)
    found = members.join(starts, ["window", "key"])
    return found.select(F.col("repeat").alias("repeat_id"), "length", F.col(ROW).alias("row"), "doc_id", "begin")
