"""The prefix trie of rebuilt conversations, from fingerprints that are composed instead of texts that are put together.

A conversation c is rebuilt from the first h turns of its base (conversation ``c - c % group``; ``h = crc32(decimal c) % heads``) and its own turns after its
first h. A node is a distinct sequence of the first d rebuilt turns; its members are the rebuilt conversations that start with it.

1. ``turns``: each turn once, with a digest of (role, text) made where the text lies. They are sorted over ranges of (conversation, turn, digest), so a
   conversation may lie in many tasks; each task goes through its rows once, with the running product of its part of a
   conversation, and ``parts`` says what comes ahead of each part, a row for each (conversation, range).
2. The fingerprint of n turns is an element of a monoid: (n, x) times (m, y) is (n + m, x * B**m + y) in four fields of 31 bits, with a
   base B drawn by a seed. The products of all prefixes of a conversation are known, so the base's head times the own suffix is
   ``own[k] + (head - own[h]) * B**(k - h)``: no turn is read again and no text is rebuilt.
3. Nodes are groups of (depth, fingerprint), summed in each task before the shuffle. Each row refers to the stored turn that it ends with, and a group verifies
   that its rows end with equal turns and have equal parents; so, from the root on, its members start with equal turns. Equal turns
   are equal digests, which ``differing_turns`` verifies on roles and texts. Where two sequences share a fingerprint, ``trie`` starts again with another base.
4. Each node is kept by its smallest member. Along a conversation's path the nodes that it keeps are the last ones. So the sum over a subtree is the sum, over
   the top's members, of all that each keeps, less what the top's keeper keeps above it: a running sum along each path (by blocks of
   ``BLOCK`` depths, then over blocks) and one more sum over members, whatever the depth or shape of the trie.
5. The ids of members that end at a node are sorted in ranges of (node, id), joined range by range, and the pieces hashed in order, a piece at a time.

No table has more rows than there are rebuilt turns and conversations; no task holds a conversation, a node's members or its children.

Cases: null roles and texts are empty; turns of a conversation with the same number (or null, which comes first) are ordered by their digests, so
equal rows are equal turns one after the other; rows with a null conv_id belong to no conversation and are left out; no conversation, no
node: an empty table gives an empty result; roles and texts of any length are digested whole; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fringeworks.llm.common import temporaries, written

#: A head has fewer turns than HEADS, of the conversation with the round number of GROUP; depths of a block; ids that are joined as one piece; bases that are tried.
HEADS, GROUP, BLOCK, JOINED, TRIES = 6, 100, 4096, 512, 3
#: The four largest primes below 2**31.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
_LOW30, _LOW31 = np.int64((1 << 30) - 1), np.int64((1 << 31) - 1)
_NODE = ["depth", "f1", "f2"]


class Bases:
    """Powers of the base and of its inverse, in the four fields."""

    def __init__(self, seed: int, primes=PRIMES):
        self.primes = np.array(primes, np.uint64)
        self.base = [int(x) for x in np.random.default_rng(seed).integers(2, min(primes) - 1, 4)]
        self.inverse = [pow(b, -1, p) for b, p in zip(self.base, primes, strict=True)]
        self.tables = [np.ones((1, 4), np.uint64) for _ in range(2)]

    def powers(self, n: int) -> list[np.ndarray]:
        """Of the base and of its inverse, up to the n-th."""
        while len(self.tables[0]) <= n:
            for k, base in enumerate((self.base, self.inverse)):
                own = self.tables[k]
                step = np.array([pow(b, len(own), int(p)) for b, p in zip(base, self.primes, strict=True)], np.uint64)
                self.tables[k] = np.concatenate([own, own * step % self.primes])
        return self.tables

    def power(self, exponents: np.ndarray) -> np.ndarray:
        """The base to powers of any size, by squaring."""
        out, square, left = np.ones((len(exponents), 4), np.uint64), np.array(self.base, np.uint64), exponents.astype(np.uint64)
        while len(left) and left.any():
            out = np.where((left & np.uint64(1) == 1)[:, None], out * square % self.primes, out)
            square, left = square * square % self.primes, left >> np.uint64(1)
        return out

    def prefixes(self, turns: np.ndarray, runs: np.ndarray) -> np.ndarray:
        """The products of all prefixes of each run of turns; ``runs`` has where they begin."""
        size = np.diff(np.r_[runs, len(turns)])
        place = np.arange(len(turns)) - np.repeat(runs, size)
        up, down = self.powers(int(place.max(initial=0)))
        total = np.cumsum(turns * down[place] % self.primes, 0, dtype=np.uint64)
        before = np.concatenate([np.zeros((1, 4), np.uint64), total])[runs]
        return (total - np.repeat(before, size, 0)) % self.primes * up[place] % self.primes

    def element(self, t1: np.ndarray, t2: np.ndarray) -> np.ndarray:
        """Of a turn, from the 60 bits of each half of its digest."""
        return np.stack([t1 >> 30, t1 & _LOW30, t2 >> 30, t2 & _LOW30], 1).astype(np.uint64) % self.primes

    def minus(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return (x + self.primes - y) % self.primes


def _fields(f1: np.ndarray, f2: np.ndarray) -> np.ndarray:
    return np.stack([f1 >> 31, f1 & _LOW31, f2 >> 31, f2 & _LOW31], 1).astype(np.uint64)


def _packed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.int64)
    return (x[:, 0] << 31) | x[:, 1], (x[:, 2] << 31) | x[:, 3]


def _longs(batch, *names) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False) for n in names]


def _rows(columns: list, schema: str):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split(" ")[0] for x in schema.split(", ")])


def _role_and_text() -> tuple:
    return tuple(F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))


def _digest(role, text) -> list:
    sha = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    return [F.conv(F.substring(sha, k, 15), 16, 10).cast("long").alias(name) for k, name in ((1, "t1"), (16, "t2"))]


_TURN = "part long, conv_id long, place long, t1 long, t2 long, points long, f1 long, f2 long"


def _products(seed: int, primes):
    """Sorted turns of a range: place and running product within the range's part of the conversation."""

    def run(batches) -> Iterator:
        from pyspark import TaskContext

        bases, part = Bases(seed, primes), TaskContext.get().partitionId()
        known, place, product = None, 0, np.zeros((1, 4), np.uint64)  # where the last batch ended
        for b in batches:
            if not b.num_rows:
                continue
            conv, t1, t2 = _longs(b, "conv_id", "t1", "t2")
            runs = np.r_[0, np.flatnonzero(conv[1:] != conv[:-1]) + 1]
            size = np.diff(np.r_[runs, len(conv)])
            places = np.arange(1, len(conv) + 1) - np.repeat(runs, size)
            products = bases.prefixes(bases.element(t1, t2), runs)
            if conv[0] == known:
                own = slice(0, size[0])
                products[own] = (products[own] + product * bases.power(places[own])) % bases.primes
                places[own] += place
            known, place, product = conv[-1], places[-1], products[-1:].copy()
            yield _rows([np.full(len(conv), part), conv, places, t1, t2, b.column("points"), *_packed(products)], _TURN)

    return run


def turns(conversations: DataFrame, seed: int, primes=PRIMES) -> DataFrame:
    """part, conv_id, place, digest (t1, t2), points (code points of the text), product (f1, f2): each turn, by the range that it lies in."""
    role, text = _role_and_text()
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *_digest(role, text), F.length(text).cast("long").alias("points"))
    keys = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("t1"), F.col("t2")]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("turn").mapInArrow(_products(seed, primes), _TURN)


def differing_turns(conversations: DataFrame) -> DataFrame:
    """Digests that stand for different (role, text), with how many."""
    role, text = _role_and_text()
    each = conversations.where("conv_id is not null").select(role.alias("role"), text.alias("text")).distinct()
    return each.select(*_digest(F.col("role"), F.col("text"))).groupBy("t1", "t2").count().where("count > 1")


_PART = "conv_id long, part long, before long, a1 long, a2 long, n long"


def _ahead(seed: int, primes):
    """Of one conversation's parts: turns and product ahead of each, and how many turns there are."""

    def run(table):
        import pyarrow as pa

        bases = Bases(seed, primes)
        conv, part, n, f1, f2 = _longs(table.sort_by("part"), "conv_id", "part", "place", "f1", "f2")
        own, ahead = _fields(f1, f2), np.zeros((len(part), 4), np.uint64)
        step = bases.power(n)
        for k in range(1, len(part)):
            ahead[k] = (ahead[k - 1] * step[k - 1] + own[k - 1]) % bases.primes
        return pa.Table.from_batches([_rows([conv, part, np.cumsum(n) - n, *_packed(ahead), np.full(len(part), n.sum())], _PART)])

    return run


def parts(rows: DataFrame, seed: int, primes=PRIMES) -> DataFrame:
    """For each (conversation, range): what comes ahead of the part. What is gathered of a conversation has a row for each range at most."""
    last = written(rows.groupBy("conv_id", "part").agg(F.max("place").alias("place"), *(F.max_by(f, "place").alias(f) for f in ("f1", "f2"))), "parts")
    several = last.groupBy("conv_id").count().where("count > 1").select("conv_id")
    none = F.lit(0).cast("long")
    one = last.join(several, "conv_id", "left_anti").select("conv_id", "part", none.alias("before"), none.alias("a1"), none.alias("a2"), F.col("place").alias("n"))
    return one.unionByName(last.join(several, "conv_id").groupBy("conv_id").applyInArrow(_ahead(seed, primes), _PART))


_EARLY = "conv_id long, place long, t1 long, t2 long, points long, f1 long, f2 long"


def _early(seed: int, primes):
    """The place and product of turns in the whole conversation."""

    def run(batches) -> Iterator:
        bases = Bases(seed, primes)
        for b in batches:
            place, before, f1, f2, a1, a2 = _longs(b, "place", "before", "f1", "f2", "a1", "a2")
            product = (_fields(f1, f2) + _fields(a1, a2) * bases.power(place)) % bases.primes
            yield _rows([b.column("conv_id"), before + place, *(b.column(c) for c in ("t1", "t2", "points")), *_packed(product)], _EARLY)

    return run


def rebuilt(rows: DataFrame, split: DataFrame, seed: int, primes=PRIMES, heads: int = HEADS, group: int = GROUP) -> DataFrame:
    """conv_id, own, n, h, and of the base's head: base_id, taken (turns), head (those turns), the product (b1, b2); a row for each conversation.

    ``own`` has the product (o1, o2) of the conversation's own first h turns, where it has so many.
    """
    first = rows.where(F.col("place") < heads).join(split.where(F.col("before") < heads), ["conv_id", "part"]).where(F.col("before") + F.col("place") < heads)
    first = first.select(*rows.drop("part").columns, "before", "a1", "a2").mapInArrow(_early(seed, primes), _EARLY)
    first = first.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("place", "t1", "t2", "points", "f1", "f2"))).alias("first"))  # heads - 1 at most
    each = split.where("before = 0").select("conv_id", "n").join(first, "conv_id")
    each = written(each.withColumn("h", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).cast("int")), "conversations")
    base = each.select(F.col("conv_id").alias("base_id"), F.col("first").alias("head"))
    both = each.withColumn("base_id", F.col("conv_id") - F.col("conv_id") % group).join(base, "base_id", "left")
    both = both.withColumn("taken", F.least("h", F.when(F.col("head").isNull(), 0).otherwise(F.size("head"))))
    at = lambda turns_, n, f: F.coalesce(F.get(F.col(turns_), F.col(n) - 1)[f], F.lit(0).cast("long"))
    return both.select("conv_id", "n", "h", "base_id", "taken", "head", at("head", "taken", "f1").alias("b1"), at("head", "taken", "f2").alias("b2"), at("first", "h", "f1").alias("o1"), at("first", "h", "f2").alias("o2"), (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))


_ROW = "conv_id long, depth long, f1 long, f2 long, p1 long, p2 long, t1 long, t2 long, points long, turn_conv_id long, turn_place long, ends boolean"


def _suffix(seed: int, primes):
    """Own turns after the first h as prefixes of the rebuilt conversation."""

    def run(batches) -> Iterator:
        bases = Bases(seed, primes)
        back = np.array(bases.inverse, np.uint64)
        for b in batches:
            place, before, h, taken, length = _longs(b, "place", "before", "h", "taken", "length")
            f, a, base, own = (_fields(*_longs(b, x + "1", x + "2")) for x in "fabo")
            t1, t2 = _longs(b, "t1", "t2")
            k = before + place
            product = (f + a * bases.power(place) + bases.minus(base, own) * bases.power(k - h)) % bases.primes
            parent = bases.minus(product, bases.element(t1, t2)) * back % bases.primes
            depth = taken + k - h
            yield _rows([b.column("conv_id"), depth, *_packed(product), *_packed(parent), t1, t2, b.column("points"), b.column("conv_id"), k, depth == length], _ROW)

    return run


def prefixes(rows: DataFrame, split: DataFrame, conversations: DataFrame, seed: int, primes=PRIMES) -> DataFrame:
    """A row for each prefix of each rebuilt conversation: fingerprint, the parent's, and the stored turn that it ends with."""
    about = split.select("conv_id", "part", "before", "a1", "a2").join(conversations.drop("head", "n", "base_id"), "conv_id")
    own = rows.join(about, ["conv_id", "part"]).where("before + place > h").mapInArrow(_suffix(seed, primes), _ROW)
    d = F.col("depth")
    zero = F.lit(0).cast("long")
    last, above = F.get("head", d - 1), F.get("head", d - 2)
    of = lambda turn, f: F.coalesce(turn[f], zero)
    head = conversations.select("*", F.explode(F.sequence(F.lit(0), "taken")).alias("depth")).select(
        "conv_id", d.cast("long").alias("depth"), of(last, "f1").alias("f1"), of(last, "f2").alias("f2"), of(above, "f1").alias("p1"), of(above, "f2").alias("p2"), of(last, "t1").alias("t1"), of(last, "t2").alias("t2"),
        of(last, "points").alias("points"), F.when(d > 0, F.col("base_id")).alias("turn_conv_id"), F.when(d > 0, d.cast("long")).alias("turn_place"), (d == F.col("length")).alias("ends"),
    )
    return head.unionByName(own)


def nodes(rows: DataFrame) -> DataFrame:
    """A row for each (depth, fingerprint), with its keeper, counts, the stored turn it ends with, and whether its rows differ."""
    same = [F.min(c) != F.max(c) for c in ("p1", "p2", "t1", "t2")]
    differs = same[0] | same[1] | same[2] | same[3]
    one = lambda c: F.min_by(c, "conv_id").alias(c)
    made = rows.groupBy(*_NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.sum(F.col("ends").cast("long")).alias("n_ends"), F.min("points").alias("points"), F.min("p1").alias("p1"), F.min("p2").alias("p2"),
        one("turn_conv_id"), one("turn_place"), differs.alias("differs"),
    )
    return made.withColumn("saves", (F.col("n_convs") - 1) * F.col("points"))


def _kept_above(made: DataFrame, block: int) -> DataFrame:
    """The nodes' keys with ``above``: what the keeper keeps at smaller depths."""
    from pyspark.sql import Window

    own = made.select(*_NODE, "conv_id", "saves", F.floor(F.col("depth") / block).alias("block"))
    sums = own.groupBy("conv_id", "block").agg(F.sum("saves").alias("all"))
    ahead = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("carried", F.sum("all").over(ahead)).where("carried <> 0").select("conv_id", "block", "carried")
    within = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = own.withColumn("within", F.sum("saves").over(within)).join(carried, ["conv_id", "block"], "left")
    return placed.select(*_NODE, (F.coalesce("within", F.lit(0)) + F.coalesce("carried", F.lit(0))).alias("above"))


_PIECE = "depth long, f1 long, f2 long, conv_id long, ids string"


def _pieces(joined: int):
    """Sorted (node, id) of a range: ids of a node joined by commas, ``joined`` at a time."""

    def run(batches) -> Iterator:
        for b in batches:
            if not b.num_rows:
                continue
            columns = _longs(b, *_NODE, "conv_id")
            differ = np.zeros(b.num_rows - 1, bool)
            for c in columns[:3]:
                differ |= c[1:] != c[:-1]
            begin = np.r_[0, np.flatnonzero(differ) + 1]
            begin = np.unique(np.concatenate([begin, *(np.arange(i, j, joined) for i, j in zip(begin, np.r_[begin[1:], b.num_rows], strict=True) if j - i > joined)]))
            names = list(map(str, columns[3].tolist()))
            said = [",".join(names[i:j]) for i, j in zip(begin.tolist(), [*begin[1:].tolist(), len(names)], strict=True)]
            yield _rows([*(c[begin] for c in columns), said], _PIECE)

    return run


def _hashed(batches) -> Iterator:
    """Sorted pieces: the digest of each node's pieces, joined by commas."""
    known, state, out = None, None, []
    for b in batches:
        for *key, ids in zip(*(b.column(k).to_pylist() for k in (*_NODE, "ids")), strict=True):
            if key != known:
                if known:
                    out.append((*known, state.hexdigest()))
                known, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ids.encode())
        if out:
            yield _rows(list(zip(*out, strict=True)), "depth long, f1 long, f2 long, ends_sha256 string")
            out = []
    if known:
        yield _rows([[x] for x in (*known, state.hexdigest())], "depth long, f1 long, f2 long, ends_sha256 string")


def end_digests(rows: DataFrame, joined: int = JOINED) -> DataFrame:
    """depth, f1, f2, ends_sha256: of the ids that end at a node. A digest takes its bytes one after the other, so the pieces of a node meet in one task, which holds a batch of them."""
    keys = [*_NODE, "conv_id"]
    pieces = rows.where("ends").select(*keys).repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(_pieces(joined), _PIECE)
    return pieces.repartition(*_NODE).sortWithinPartitions(*keys).mapInArrow(_hashed, "depth long, f1 long, f2 long, ends_sha256 string")


def trie(conversations: DataFrame, heads: int = HEADS, group: int = GROUP, seed: int = 1, primes=PRIMES, block: int = BLOCK, joined: int = JOINED) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, turn_conv_id, turn_place: a row for each node.

    The last two refer to the stored turn that the node ends with: the turn_place-th of conversation turn_conv_id, null for the root.
    """
    with temporaries(conversations.sparkSession) as kept:
        if not differing_turns(conversations).isEmpty():
            raise ValueError("different turns with one digest")
        for tried in range(TRIES):
            rows = written(turns(conversations, seed + tried, primes), "turns")
            split = written(parts(rows, seed + tried, primes), "split")
            about = written(rebuilt(rows, split, seed + tried, primes, heads, group), "rebuilt")
            paths = written(prefixes(rows, split, about, seed + tried, primes), "prefixes")
            made = written(nodes(paths), "nodes")
            if made.where("differs").isEmpty():
                break
        else:
            raise ValueError(f"different sequences with one fingerprint, for {TRIES} bases")
        keepers = made.groupBy("conv_id").agg(F.sum("saves").alias("keeps"), F.max((F.col("n_ends") == F.col("n_convs")).cast("long")).alias("leaf")).where("keeps <> 0 or leaf <> 0")
        sums = paths.select("conv_id", *_NODE).join(keepers, "conv_id").groupBy(*_NODE).agg(F.sum("keeps").alias("keeps"), F.sum("leaf").alias("n_leaves"))
        children = made.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("f1"), F.col("p2").alias("f2")).agg(F.count(F.lit(1)).alias("n_children"))
        found = made
        for other in (sums, children, _kept_above(made, block), end_digests(paths, joined)):
            found = found.join(other, _NODE, "left")
        keys = {"p1": "f1", "p2": "f2"}
        parent = made.select((F.col("depth") + 1).alias("depth"), *(F.col(f).alias(p) for p, f in keys.items()), F.col("conv_id").alias("parent_conv_id"))
        found = found.join(parent, ["depth", "p1", "p2"], "left")
        whole = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        digest = F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))
        return kept(
            found.select("conv_id", "depth", "parent_conv_id", "n_convs", whole("n_children").alias("n_children"), whole("n_leaves").alias("n_leaves"), (whole("keeps") - whole("above")).alias("saved_tokens"), digest.alias("ends_sha256"), "turn_conv_id", "turn_place"),
            "trie",
        )
