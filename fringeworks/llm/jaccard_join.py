"""Near duplicates by an exact Jaccard self-join on word shingles: T-occurrence search with DivideSkip.

A document of s shingles shares at least T = ceil(t s) of them with any partner, hence at least one of its s - T + 1 first in
any order of the shingles that is the same for all documents. The order here is rarest first:

1. One pass over the texts makes blocks of documents. A fixed share of all shingle numbers (the pool, wide enough for those
   first ones) is dealt to buckets, packed; a document whose pool is too small sends all its shingles. A bucket counts each
   shingle's documents and sends back only what several documents have, so a block knows which of its documents' first
   shingles are shared. Most documents have none and are done.
2. Documents with equal sets form a class. Classes that share a first shingle are joined to shards (connected components of
   the candidate graph, from one star for each inverted list, never its pairs).
3. In a shard, each class asks the inverted lists of the shard for documents that occur T times: the short lists are merged
   by a heap, and the candidates reaching T minus the number of long lists are probed in these by binary search. Whoever
   is known to be connected to the class leaves the lists, after each link anew, so a group of many near copies costs
   about a query for each, not a probe for each pair. A shard above ``MOST`` classes is cut into blocks, a task each. What
   the blocks leave unconnected to the shard's largest part so far is cut into groups of ``MOST``, and each group is searched
   against each block in a task of its own, which gets only classes that share a first shingle with the other side; two classes
   of the largest part need no search. So a task has about 2 ``MOST`` classes however large the shard and few its links. A group of
   near copies costs what its size does; n classes that are hardly linked cost at most 2 n n / ``MOST`` sets sent, fewer where lists are short.
4. The links found, a spanning forest of each shard, give the components.

No link between different texts is lost: the filters are exact. Shingles are compared as 64-bit numbers without structure (``words``).
The rows are numbered in one written table that all passes read.

Cases: null and empty texts, or those without words, have an empty set and are linked with nothing; fewer words than a
shingle are one shingle; repeated rows are equal sets; a null doc_id is the largest, so a group's id is null only where all its
ids are; an empty table gives an empty result; other columns are ignored, and one whose name starts with ``_fw_`` is refused.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import ROW, buckets_for, numbered, temporaries, written
from fringeworks.llm.components import components
from fringeworks.llm.words import NOT_BLANK, mixed, numbered_words, slices

#: Documents and postings of a block; classes of a shard that one task searches; classes whose rows are broadcast.
BLOCK_DOCS, BLOCK_POSTINGS, MOST, MOST_SENT = 8192, 1_000_000, 2000, 2_000_000
_ROW = "bucket int, block long, kind int, a binary, b binary, c binary"


def shingle_sets(column, words: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle numbers) of every text of an Arrow string column."""
    weights = mixed(np.arange(1, words + 1, dtype=np.uint64)) | np.uint64(1)
    for row, data, bounds in slices(column):
        w, first = numbered_words(data, bounds, NOT_BLANK)
        whole = np.zeros(max(0, len(w) - words + 1), np.uint64)
        for j in range(words):
            whole += w[j : j + len(whole)] * weights[j]
        whole = mixed(whole)
        for k in range(len(bounds) - 1):
            begin, n = int(first[k]), int(first[k + 1] - first[k])
            if n >= words:
                yield row + k, np.unique(whole[begin : begin + n - words + 1])
            else:
                short = (w[begin : begin + n] * weights[:n]).sum(dtype=np.uint64)
                yield row + k, mixed(np.array([short + np.uint64(n)] * (n > 0), np.uint64))


def needed(size: int, num: int, den: int) -> int:
    """The least overlap with any partner: ceil(t size)."""
    return -(-num * size // den)


def _packed(docs: DataFrame, words: int, num: int, den: int, buckets: int) -> DataFrame:
    """The blocks: kind 0 describes a block's documents, kind 1 holds its postings for a bucket."""
    pool = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, 2.5 * (den - num) / den))))

    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        kept("shingles")
        kinds = [pa.int32(), pa.int64(), pa.int32(), *[pa.binary()] * 3]
        names = [x.split(" ")[0] for x in _ROW.split(", ")]
        block = TaskContext.get().partitionId() << 24
        about: list[tuple] = []
        found: list[np.ndarray] = []
        seen: set[bytes] = set()
        size = 0

        def flushed():
            base = np.array([(r, h, d, s, p, a) for r, h, d, s, p, a, _ in about], np.int64)
            rows = [(block % buckets, block, 0, base.tobytes(), b"".join(x[-1] for x in about), b"")]
            doc = np.repeat(np.arange(len(found), dtype=np.uint32), [len(x) for x in found])
            token = np.concatenate(found)
            where = (token % np.uint64(buckets * 8191)) // np.uint64(8191)
            order = np.argsort(where, kind="stable")
            token, doc, ends = token[order], doc[order], np.searchsorted(where[order], np.arange(buckets + 1))
            rows += [(b, block, 1, token[i:j].tobytes(), doc[i:j].tobytes(), b"") for b, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if i < j]
            for r in rows:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(r, kinds, strict=True)], names=names)

        for b in batches:
            ids, uids = b.column(1).to_pylist(), b.column(0).to_pylist()
            for k, tokens in shingle_sets(b.column(2), words):
                first = tokens[: int(np.searchsorted(tokens, pool))]
                s = len(tokens)
                everything = len(first) < s - needed(s, num, den) + 1
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
                # of equal sets in a block one speaks for all
                sent = tokens[:0] if digest in seen else tokens if everything else first
                seen.add(digest)
                about.append((uids[k], ids[k] is not None, ids[k] or 0, s, len(first), everything, digest))
                found.append(sent)
                size += len(sent)
                if len(about) >= BLOCK_DOCS or size >= BLOCK_POSTINGS:
                    yield from flushed()
                    block, about, found, size = block + 1, [], [], 0
                    seen.clear()
        if about:
            yield from flushed()

    return docs.select(ROW, "doc_id", "text").mapInArrow(run, _ROW)


def _shared(table):
    """In a bucket: of each shingle that several documents have, its documents and their number, back to the blocks."""
    import pyarrow as pa

    out: list[tuple] = []
    rows = []
    for batch in table.to_batches():
        for r in batch.to_pylist():
            if r["kind"] == 0:
                out.append((r["block"], 0, r["a"], r["b"], b""))
            else:
                rows.append((r["block"], np.frombuffer(r["a"], np.uint64), np.frombuffer(r["b"], np.uint32)))
    if rows:
        token = np.concatenate([x[1] for x in rows])
        origin = np.repeat(np.arange(len(rows)), [len(x[1]) for x in rows])
        doc = np.concatenate([x[2] for x in rows])
        order = np.argsort(token, kind="stable")
        token, origin, doc = token[order], origin[order], doc[order]
        head = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        df = np.diff(np.r_[head, len(token)])
        df = np.repeat(df, df)
        some = df > 1
        token, origin, doc, df = token[some], origin[some], doc[some], df[some]
        order = np.argsort(origin, kind="stable")
        ends = np.searchsorted(origin[order], np.arange(len(rows) + 1))
        for (block, _, _), i, j in zip(rows, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if i < j:
                own = order[i:j]
                out.append((block, 1, token[own].tobytes(), doc[own].tobytes(), df[own].astype(np.uint32).tobytes()))
    columns = list(zip(*out, strict=True)) if out else [()] * 5
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["block", "kind", "a", "b", "c"])


def _first_shared(num: int, den: int, pool_share: float):
    pool = np.uint64(min(2**64 - 1, int(2**64 * min(1.0, pool_share))))

    def run(table):
        """In a block: which of a document's first shingles, rarest first, other documents have."""
        import pyarrow as pa

        rows = table.to_pylist()
        base = next(r for r in rows if r["kind"] == 0)
        about = np.frombuffer(base["a"], np.int64).reshape(-1, 6)
        rest = [r for r in rows if r["kind"] == 1]
        join = lambda k, t: np.concatenate([np.frombuffer(r[k], t) for r in rest]) if rest else np.empty(0, t)
        token, doc, df = join("a", np.uint64), join("b", np.uint32), join("c", np.uint32)
        late = token >= pool
        order = np.lexsort((token, df, late, doc))
        token, late, doc = token[order], late[order], doc[order]
        ends = np.searchsorted(doc, np.arange(len(about) + 1)).tolist()
        live = []
        for k, (_, _, _, s, in_pool, everything) in enumerate(about.tolist()):
            own, after = token[ends[k] : ends[k + 1]], int(late[ends[k] : ends[k + 1]].sum())
            early, count = len(own) - after, s - needed(s, num, den) + 1
            # shingles that only this document has come first in either part
            take = own[: min(early, max(0, count - (in_pool - early)))] if s else own[:0]
            if everything and count > in_pool:
                more = max(0, count - in_pool - (s - in_pool - after))
                take = np.concatenate([take, own[early : early + more]])
            live.append(take.view(np.int64))
        digest = [base["b"][16 * k : 16 * k + 16] for k in range(len(about))]
        return pa.table(
            [pa.array(about[:, 0]), pa.array(about[:, 2], mask=about[:, 1] == 0), pa.array(about[:, 3]), pa.array(digest, pa.binary()), pa.array(live, pa.list_(pa.int64()))],
            names=["row", "doc_id", "n_shingles", "digest", "live"],
        )

    return run


def divide_skip(sets: list[np.ndarray], num: int, den: int, parts: list[int] | None = None) -> list[tuple[int, int]]:
    """Links (a, b) that connect all of ``sets`` that Jaccard >= num / den connects: a spanning forest.

    ``parts``: sets with the same number are known to be connected.
    """
    order = sorted(range(len(sets)), key=lambda k: len(sets[k]))
    sizes, links = [len(sets[k]) for k in order], []
    part = np.arange(len(order)) if parts is None else np.unique([parts[k] for k in order], return_inverse=True)[1]
    left = len(np.unique(part))
    token = np.concatenate([sets[k] for k in order])
    by = np.argsort(token, kind="stable")
    holder = np.repeat(np.arange(len(order)), sizes)[by]  # the inverted lists in a row, each ascending
    names, begins, lengths = np.unique(token[by], return_index=True, return_counts=True)
    entry = np.repeat(np.arange(len(names)), lengths) * len(order) + holder  # (list, set) as one ascending number
    for q in range(1, len(order)):
        if left == 1:
            break
        s, at = sizes[q], np.searchsorted(names, sets[order[q]])
        t = needed(s, num, den)
        rare = at[np.argsort(lengths[at], kind="stable")]
        n_long = min(t - 1, int(t / (0.0085 * np.log2(max(2, int(lengths[rare[-1]]))) + 1)))
        short, long = rare[: s - n_long], np.sort(rare[s - n_long :]) * len(order)
        small = int(np.searchsorted(sizes, t))  # sets before it are too small to be linked
        lists = [holder[b : b + n] for b, n in zip(begins[short].tolist(), lengths[short].tolist(), strict=True) if n > 1]
        lists = [x[(x >= small) & (x < q)] for x in lists]
        while lists := [y for x in lists if len(y := x[part[x] != part[q]])]:
            for c, n in _merged(lists):
                both = -(-num * (s + sizes[c]) // (num + den))  # what the two must share, never under t
                if n < both - n_long:
                    continue
                place = np.searchsorted(entry, long + c)
                n += int((entry[np.minimum(place, len(entry) - 1)] == long + c).sum())
                if n >= both:
                    links.append((order[q], order[c]))
                    part[part == part[c]] = part[q]
                    left -= 1
                    lists = [x[x > c] for x in lists]
                    break
            else:
                break
    return links


def _merged(lists: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """(set, occurrences) in ascending order, by a heap over the lists."""
    last, n = -1, 0
    for c in heapq.merge(*[memoryview(x) for x in lists]):
        if c == last:
            n += 1
            continue
        if n:
            yield last, n
        last, n = c, 1
    if n:
        yield last, n


def shingle_classes(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """row, doc_id, n_shingles, digest (of the set), live (its first shingles that others have): one row per document."""
    buckets = buckets_for(docs)
    packed = _packed(docs, words, num, den, buckets).groupBy("bucket").applyInArrow(_shared, "block long, kind int, a binary, b binary, c binary")
    blocks = packed.groupBy("block").applyInArrow(_first_shared(num, den, 2.5 * (den - num) / den), "row long, doc_id long, n_shingles long, digest binary, live array<long>")
    return written(blocks, "classes")


def stands_for(classes: DataFrame) -> DataFrame:
    """digest, s (doc_id and row that stand for the class, the smallest), live: a row per class of equal sets that aren't empty."""
    live = F.max(F.struct(F.size("live").alias("n"), "live")).alias("l")
    return written(classes.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("s"), live).select("digest", "s", "l.live"), "stands")


def links_of(docs: DataFrame, stands: DataFrame, words: int, num: int, den: int, most: int = MOST) -> DataFrame:
    """a, b (rows that stand for their classes): links that connect what the join connects."""
    lists = stands.select("s.row", F.explode("live").alias("token"))
    stars = lists.join(lists.groupBy("token").agg(F.min("row").alias("b")), "token").where("row != b")
    shards = components(stars.select(F.col("row").alias("a"), "b"))
    sizes = shards.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    k = F.ceil(F.col("n") / most)
    placed = shards.join(sizes, "component").select(F.col("node").alias("row"), "component", k.alias("k"), F.pmod(F.xxhash64("node"), k).alias("block"))
    placed = written(placed, "shards")
    links = _searched(docs, placed.withColumn("part", F.col("row")), words, num, den)
    cut = placed.where("k > 1")
    if cut.isEmpty():
        return links
    # second round: what isn't in the largest part of its shard (the others) meets every block
    parts = components(links.join(cut.select(F.col("row").alias("a")), "a", "left_semi"))
    cut = written(cut.join(parts.withColumnsRenamed({"node": "row", "component": "part"}), "row", "left").withColumn("part", F.coalesce("part", "row")), "cut")
    largest = cut.groupBy("component", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("component").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    sides = cut.join(largest, "component").withColumn("other", F.col("part") != F.col("largest"))
    dealt = sides.where("other").groupBy("component").agg(F.ceil(F.count(F.lit(1)) / most).alias("m"))
    sides = sides.join(dealt, "component").withColumn("group", F.pmod(F.xxhash64("row", F.lit(1)), F.col("m")))
    # a task for each group of others and block, of those in either that share a first shingle with some in the other
    held = written(lists.join(sides, "row").select("row", "token", "component", "k", "block", "part", "other", "group"), "held")
    blocks = held.select("token", F.col("block").alias("b")).distinct()
    groups = held.where("other").select("token", F.col("group").alias("g")).distinct()
    ours = held.where("other").join(blocks, "token").withColumnRenamed("group", "g")
    theirs = held.join(groups, "token").withColumnRenamed("block", "b")
    columns = ["row", "component", (F.col("g") * F.col("k") + F.col("b")).alias("block"), "part"]
    again = written(ours.select(*columns).unionByName(theirs.select(*columns)).distinct(), "again")
    return links if again.isEmpty() else links.unionByName(_searched(docs, again, words, num, den))


def _searched(docs: DataFrame, placed: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Links within each (component, block) of ``placed`` (row, component, block, part)."""
    total = placed.count()
    # a bucket is held as a whole: about MOST / 2 sets and one (component, block) more
    buckets = max(4 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // MOST)

    def with_sets(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        kept("shingles")
        for b in batches:
            out = [s.tobytes() for _, s in shingle_sets(b.column(4), words)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(out, pa.binary())], names=["row", "component", "block", "part", "tokens"])

    def search(table):
        import pyarrow as pa

        groups: dict[tuple, list[int]] = {}
        keys = zip(*(table.column(c).to_pylist() for c in ("component", "block")), strict=True)
        for at, key in enumerate(keys):
            groups.setdefault(key, []).append(at)
        rows, parts, tokens = table.column("row").to_pylist(), table.column("part").to_pylist(), table.column("tokens")
        a, b = [], []
        for members in groups.values():
            members = sorted(members, key=lambda k: rows[k])
            sets = [np.frombuffer(tokens[k].as_buffer(), np.uint64) for k in members]
            for x, y in divide_skip(sets, num, den, [parts[k] for k in members]):
                a.append(rows[members[x]])
                b.append(rows[members[y]])
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    placed = placed.select(F.col("row").alias(ROW), "component", "block", "part")
    chosen = F.broadcast(placed) if total <= MOST_SENT else placed
    texts = docs.select(ROW, "text").join(chosen, ROW).select(ROW, "component", "block", "part", "text")
    sets = texts.mapInArrow(with_sets, "row long, component long, block long, part long, tokens binary")
    bucket = F.pmod(F.xxhash64("component", "block"), F.lit(buckets)).alias("bucket")
    return written(sets.select("*", bucket).groupBy("bucket").applyInArrow(search, "a long, b long"), "links")


def similar_groups(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, most: int = MOST) -> DataFrame:
    """row, doc_id, n_shingles, component_id (smallest doc_id that links reach), first (whether this row is the one that stays)."""
    with temporaries(docs.sparkSession) as kept:
        return kept(_groups(numbered(docs, "doc_id", "text"), words, num, den, most), "groups")


def _groups(docs: DataFrame, words: int, num: int, den: int, most: int) -> DataFrame:
    classes = shingle_classes(docs, words, num, den)
    stands = stands_for(classes)
    joined = components(links_of(docs, stands, words, num, den, most))
    # the row that stands for a class links it to its component; equal sets share a digest
    stands = stands.join(joined, F.col("s.row") == F.col("node"), "left")
    stands = stands.select("digest", "s", F.coalesce("component", "s.row").alias("component"))
    least = stands.groupBy("component").agg(F.min("s").alias("least"))
    group = stands.join(least, "component").select("digest", "least")
    some = classes.where("n_shingles > 0").join(group, "digest").select("row", "doc_id", "n_shingles", F.col("least.doc_id").alias("component_id"), (F.col("row") == F.col("least.row")).alias("first"))
    none = classes.where("n_shingles = 0").select("row", "doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("first"))
    return some.unionByName(none)


def drop_near_copies(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each group of near copies, the one with the smallest doc_id; columns as given."""
    rows = numbered(docs)
    with temporaries(docs.sparkSession) as kept:
        dropped = kept(_groups(rows, words, num, den, MOST).where(~F.col("first")).select(F.col("row").alias(ROW)), "near")
    return rows.join(dropped, ROW, "left_anti").drop(ROW)
