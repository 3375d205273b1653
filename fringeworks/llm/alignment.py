"""Alignment of two tokenizers over the same bytes: windows between whitespace anchors, each kind of window aligned once.

Tokenizer A (byte-level, a ``tokenizers`` file) encodes a space and the text, B (a ``sentencepiece`` model, which adds the space itself) the text.

1. Each text is encoded whole by both libraries; every id stands for bytes, and both must give the space and the text back byte for byte.
2. Byte offsets where tokens of both end and after which tokens of both begin with a space are anchors. They are verified on the
   offsets themselves and cut the text into windows, most often words: no token reaches over one.
3. A window is named by its two tuples of ids. Ids fix the bytes, so what a window's tokens share is worked out once for each
   distinct tuple of a task (``Windows``): its groups, and its links, which are the pairs of tokens with overlapping bytes. Between two
   neighbours of all their ends lies one token of each, so there are at most na + nb links, and no pairs of a group are tried.
4. A document is then counts of windows. Its linked id pairs with how often they occur are written, and in how many documents a
   task has seen each pair: one packed row a task.
5. Those are summed over the corpus; the highest of each A id marks its best pairs. Joined back to the documents' pairs they are summed by
   row, which Spark does before it shuffles, as the pairs of a row lie together. The table of pairs is broadcast while it has at most
   ``MOST_PAIRS`` rows; beyond that the same join shuffles.

Memory: texts are worked on in slices of about a MB, windows are remembered up to ``MOST_WINDOWS`` bytes a task and forgotten together
(forgetting only costs time), windows of over ``LONGEST`` ids aren't remembered, and a task's pair counts are sent whenever
they number ``SEND``.

Cases: a null or empty text, and one whose joined bytes differ for A or B (such as a text with U+2581, or one that isn't normalised as B wants it)
has no tokens: zeros, and '' instead of a digest; strings of special tokens are plain text; rows with equal or null ids are documents each,
also in the counts of documents; texts of any length, with or without blanks, are aligned whole; an empty table gives an empty result; other
columns are ignored, and one whose name starts with ``_fw_`` is refused.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import ROW, refuse_own, temporaries, written

#: Rows of the table of pairs that is broadcast; bytes of windows that a task remembers, and of pre-tokens of A in a generation; ids of such a window; pairs that a task counts before it sends them.
MOST_PAIRS, MOST_WINDOWS, MOST_PIECES, LONGEST, SEND = 1 << 20, 48 << 20, 24 << 20, 64, 500_000
SLICE = 1 << 20
_PAIRS = "array<struct<a:int,b:int,n:int>>"
_DOCUMENT = f"{ROW} long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs {_PAIRS}, counted array<struct<a:int,b:int,n:int>>"


class Vocabulary:
    """The bytes of each id, one after the other."""

    def __init__(self, entries: list[bytes]):
        self.size = np.array([len(x) for x in entries], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(entries), np.uint8)

    def spelled(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of ``ids`` in a row, and where each ends."""
        size = self.size[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        return self.data[np.repeat(self.begin[ids] - (ends - size), size) + np.arange(total)], ends


class Encoders:
    """Both libraries, without special tokens, and the bytes of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        from fringeworks.llm.tokens import PieceIds, _byte_letters

        self.a = PieceIds(a_path, True, MOST_PIECES)
        self.a.special, self.a.tok.encode_special_tokens = set(), True  # their strings are plain text
        vocabulary, letter = self.a.tok.get_vocab(with_added_tokens=False), {c: b for b, c in enumerate(_byte_letters())}
        entries = {k: bytes(letter[c] for c in piece) for piece, k in vocabulary.items() if all(c in letter for c in piece)}
        self.a_bytes = Vocabulary([entries.get(k, b"") for k in range(max(self.a.tok.get_vocab().values()) + 1)])
        self.b = b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.b_bytes = Vocabulary([bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b"" if b.is_control(k) or b.is_unknown(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in range(b.get_piece_size())])
        digits = [b"%d," % k for k in range(max(len(self.a_bytes.size), len(self.b_bytes.size)))]
        self.digits = Vocabulary(digits)

    def both(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for text, b in zip(texts, self.b.encode(texts, num_threads=1), strict=True):
            yield np.frombuffer(self.a.of(" " + text), "<u4").astype(np.int64), np.array(b, np.int64)


def _places(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All places of runs that begin at ``begin``."""
    ends = np.cumsum(size)
    return np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Grown:
    """An array that is appended to, with where each item begins."""

    def __init__(self, kind):
        self.data, self.used, self.ends = np.empty(1 << 16, kind), 0, [np.zeros(1, np.int64)]

    def add(self, values: np.ndarray, sizes: np.ndarray) -> None:
        if self.used + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.empty(self.used + len(values), self.data.dtype)])
        self.data[self.used : self.used + len(values)] = values
        self.ends.append(self.used + np.cumsum(sizes))
        self.used += len(values)

    def items(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Their values in a row, and how many each has."""
        if len(self.ends) > 1:
            self.ends = [np.concatenate(self.ends)]
        bounds = self.ends[0]
        size = bounds[which + 1] - bounds[which]
        return self.data[_places(bounds[which], size)], size


class Windows:
    """Distinct windows by number: the text of their groups, and their links as numbers of id pairs (``pair`` has each by its code, A id << 32 | B id)."""

    def __init__(self, tools: Encoders):
        self.tools = tools
        self.clear()

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.pair: dict[int, int] = {}
        self.text, self.links, self.groups = _Grown(np.uint8), _Grown(np.int64), _Grown(np.int64)
        self.count = self.bytes = 0

    def numbers(self, a: np.ndarray, b: np.ndarray, a_bounds: np.ndarray, b_bounds: np.ndarray) -> np.ndarray:
        """Of the windows of ids between bounds; those not known by their tuples of ids are aligned first, all together."""
        a_data, b_data, mark = a.astype("<i4").tobytes(), b.astype("<i4").tobytes(), b"\xff" * 4
        get, number, count, out, new = self.number.get, self.number, self.count, [], []
        i, j = (4 * a_bounds).tolist(), (4 * b_bounds).tolist()
        for x, y, v, w in zip(i[:-1], i[1:], j[:-1], j[1:]):
            key = a_data[x:y] + mark + b_data[v:w]
            k = get(key)
            if k is None:
                k = count
                count += 1
                new.append(len(out))
                self.bytes += 250 + len(key)
                if y - x + w - v <= 4 * LONGEST:
                    number[key] = k
            out.append(k)
        if new:
            self.count, which = count, np.array(new)
            self._align(*(ids[_places(bounds[which], bounds[which + 1] - bounds[which])] for ids, bounds in ((a, a_bounds), (b, b_bounds))), a_bounds[which + 1] - a_bounds[which])
        return np.array(out, np.int64)

    def _align(self, a: np.ndarray, b: np.ndarray, a_count: np.ndarray) -> None:
        """New windows in a row, ``a_count`` tokens of A in each. Their bytes are the same for A and B, so offsets run on from window to window."""
        a_ends, b_ends = np.cumsum(self.tools.a_bytes.size[a]), np.cumsum(self.tools.b_bytes.size[b])
        window_ends = a_ends[np.cumsum(a_count) - 1]
        # between two neighbours of all ends lies one token of A and one of B: a link
        ends = np.zeros((2, int(a_ends[-1]) + 1), bool)
        ends[0, a_ends] = ends[1, b_ends] = True
        cuts, shared = np.flatnonzero(ends.any(0)), np.flatnonzero(ends.all(0))
        links = (a[np.searchsorted(a_ends, cuts)] << 32) | b[np.searchsorted(b_ends, cuts)]
        per_window = lambda ends: np.diff(np.searchsorted(ends, window_ends, "right"), prepend=0)
        codes, which = np.unique(links, return_inverse=True)
        pair = self.pair
        self.links.add(np.array([pair.setdefault(c, len(pair)) for c in codes.tolist()], np.int64)[which], per_window(cuts))
        groups = per_window(shared)
        self.groups.add(groups, np.ones(len(groups), np.int64))
        # the text of groups: tokens by group, A's before B's, each with the mark that follows it
        own = np.concatenate([2 * np.searchsorted(shared, a_ends), 2 * np.searchsorted(shared, b_ends) + 1])
        order = np.argsort(own, kind="stable")
        own = own[order]
        text, ends = self.tools.digits.spelled(np.concatenate([a, b])[order])
        last = np.r_[own[1:] != own[:-1], True]
        text[ends[last] - 1] = np.where(own[last] % 2 == 0, ord("|"), ord(";"))
        until = ends[last][2 * np.cumsum(groups) - 1]  # a group has a part of each
        sizes = np.diff(until, prepend=0)
        self.text.add(text, sizes)
        self.bytes += len(text) + 8 * len(links)

    def of(self, texts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        """The windows of texts (ids and their ends for A and B, and the bytes) in a row, and how many each text has."""
        a_bounds, b_bounds, counts, a_base, b_base = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [], 0, 0
        for a, a_ends, b, b_ends, data in texts:
            space = np.flatnonzero(data == 32)
            space = space[space > 0]
            i, j = np.searchsorted(a_ends, space), np.searchsorted(b_ends, space)
            anchor = (a_ends[i] == space) & (b_ends[j] == space)  # tokens of both end here, and a space follows
            i, j = np.r_[i[anchor] + 1, len(a)], np.r_[j[anchor] + 1, len(b)]
            a_bounds.append(a_base + i)
            b_bounds.append(b_base + j)
            counts.append(len(i))
            a_base, b_base = a_base + len(a), b_base + len(b)
        if not texts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (np.concatenate([t[k] for t in texts]) for k in (0, 2))
        return self.numbers(a, b, np.concatenate(a_bounds), np.concatenate(b_bounds)), np.array(counts)


def _summed(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    names, back = np.unique(codes, return_inverse=True)
    return names, np.bincount(back, n, len(names)).astype(np.int64)


def _aligned(a_path: str, b_path: str, slice_: int, most: int, send: int):
    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        tools = kept(("align", a_path, b_path), lambda: Encoders(a_path, b_path))
        windows = Windows(tools)
        counts = np.zeros(0, np.int64)  # by number of a pair: in how many documents
        seen: list[tuple] = []  # likewise by code, of windows that have been forgotten
        struct = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int32())])
        columns = [x.split(" ")[0] for x in _DOCUMENT.split(", ")]

        def lists(bounds: np.ndarray, codes: np.ndarray, n: np.ndarray):
            parts = [pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int32))]
            return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.StructArray.from_arrays(parts, fields=list(struct)))

        def forgotten() -> None:
            nonlocal counts
            if len(counts):
                seen.append((np.fromiter(windows.pair, np.int64, len(windows.pair)), counts))
                seen[:] = [_summed(*(np.concatenate([x[k] for x in seen]) for k in range(2)))]
            windows.clear()
            counts = np.zeros(0, np.int64)

        def sent() -> Iterator:
            if seen:
                codes, n = _summed(*(np.concatenate([x[k] for x in seen]) for k in range(2)))
                one = lists(np.array([0, len(codes)]), codes, n)
                yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 6, pa.nulls(1, pa.string()), pa.nulls(1, one.type), one], names=columns)
                seen.clear()

        def sliced(rows: list, ids: list, texts: list[str]) -> Iterator:
            nonlocal counts
            good, number = [], []
            full = [k for k, t in enumerate(texts) if t]
            for k, (a, b) in zip(full, tools.both([texts[k] for k in full]), strict=True):
                data = np.frombuffer((" " + texts[k]).encode(), np.uint8)
                (a_said, a_ends), (b_said, b_ends) = tools.a_bytes.spelled(a), tools.b_bytes.spelled(b)
                if np.array_equal(a_said, data) and np.array_equal(b_said, data):
                    good.append((a, a_ends, b, b_ends, data))
                    number.append(k)
            about = np.zeros((4, len(texts)), np.int64)
            sha = [""] * len(texts)
            about[0, number], about[1, number] = [len(x[0]) for x in good], [len(x[2]) for x in good]
            flat, size = windows.of(good)
            bounds, codes, n = np.zeros(len(texts) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
            if good:
                doc = np.repeat(np.array(number), size)
                said, long = windows.text.items(flat)
                ends = np.cumsum(long)[np.cumsum(size) - 1].tolist()
                whole = said.tobytes()
                for k, x, y in zip(number, [0, *ends[:-1]], ends, strict=True):
                    sha[k] = hashlib.sha256(whole[x : y - 1]).hexdigest()
                about[2] = np.bincount(doc, windows.groups.items(flat)[0], len(texts))
                links, many = windows.links.items(flat)
                key = np.sort(np.repeat(doc, many) * len(windows.pair) + links)
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
                n, key = np.diff(np.r_[first, len(key)]), key[first]
                doc, pair = key // len(windows.pair), key % len(windows.pair)
                codes = np.fromiter(windows.pair, np.int64, len(windows.pair))[pair]
                about[3] = np.bincount(doc, n, len(texts))
                bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
                counts = np.r_[counts, np.zeros(len(windows.pair) - len(counts), np.int64)] + np.bincount(pair, minlength=len(windows.pair))
            pairs = lists(bounds, codes, n)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *map(pa.array, about), pa.array(sha), pairs, pa.nulls(len(texts), pairs.type)], names=columns)
            if windows.bytes > most:
                forgotten()
                if len(seen[0][0]) > send:
                    yield from sent()

        rows, ids, texts, size = [], [], [], 0
        for batch in batches:
            for row, doc_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                rows.append(row)
                ids.append(doc_id)
                texts.append(text or "")
                size += len(texts[-1])
                if size > slice_ or len(rows) >= 4096:
                    yield from sliced(rows, ids, texts)
                    rows, ids, texts, size = [], [], [], 0
        if rows:
            yield from sliced(rows, ids, texts)
        forgotten()
        yield from sent()

    return run


def aligned(docs: DataFrame, a_path: str, b_path: str, slice_: int = SLICE, most: int = MOST_WINDOWS, send: int = SEND) -> DataFrame:
    """A row for each document (counts, the digest of its groups, its linked id pairs with how often), and rows of ``counted`` pairs with in how many documents."""
    numbered = refuse_own(docs).select(F.monotonically_increasing_id().alias(ROW), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return numbered.mapInArrow(_aligned(a_path, b_path, slice_, most, send), _DOCUMENT)


def linked_pairs(rows: DataFrame) -> DataFrame:
    """a, b, n_docs, best: the id pairs linked anywhere, in how many documents, and whether that is the most for a."""
    pairs = rows.where("counted is not null").select(F.inline("counted")).groupBy("a", "b").agg(F.sum("n").alias("n_docs"))
    most = pairs.groupBy("a").agg(F.max("n_docs").alias("most"))
    return pairs.join(most, "a").select("a", "b", "n_docs", (F.col("n_docs") == F.col("most")).alias("best"))


def align(docs: DataFrame, a_path: str, b_path: str, most_pairs: int = MOST_PAIRS, **bounds) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: a row for each document."""
    with temporaries(docs.sparkSession) as kept:
        rows = written(aligned(docs, a_path, b_path, **bounds), "aligned")
        pairs = written(linked_pairs(rows), "pairs")
        if pairs.count() <= most_pairs:
            pairs = F.broadcast(pairs)
        documents = rows.where("counted is null")
        sums = documents.select(ROW, F.inline("pairs")).join(pairs, ["a", "b"]).groupBy(ROW).agg(F.sum(F.col("n") * F.col("n_docs")).alias("count_sum"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"))
        whole = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
        return kept(documents.join(sums, ROW, "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", whole("n_best"), whole("count_sum"), "groups_sha256"), "alignment")
