"""The trie of rebuilt conversations against one that is built from the texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fringeworks.llm import prefix_trie as m

COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> Counter:
    own = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    built = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:h] + own[c][h:])
    members = defaultdict(list)
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members[built[c][:d]].append(c)
    children, out = Counter(x[:-1] for x in members if x), Counter()
    saves = {x: (len(c) - 1) * len(x[-1][1]) if x else 0 for x, c in members.items()}
    leaves, saved = Counter(), Counter()
    for x in members:
        for d in range(len(x) + 1):
            saved[x[:d]] += saves[x]
            leaves[x[:d]] += not children[x]
    for x, c in members.items():
        ends = ",".join(str(k) for k in c if built[k] == x)
        out[c[0], len(x), members[x[:-1]][0] if x else None, len(c), children[x], leaves[x], saved[x], hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def found(df) -> Counter:
    return Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())


def some_rows() -> list[tuple]:
    r, rows = random.Random(8), []
    for c in [*range(0, 30), *range(100, 140), 205, 250, 1000, 1001, 1099, 12345, 12300]:
        turns = r.choice([1, 2, 3, 5, 6, 7, 9])
        rows += [(c, t if t else r.choice([None, 0]), r.choice(["user", "assistant", None, ""]), r.choice(["a", "bé", "\U0001f600x", None, "", "same " * 20])) for t in range(turns)]
    rows += [(c, t, "user", "hello") for c in range(300, 340) for t in range(8)]  # copies
    return rows + [(301, t, "u", f"long {t}") for t in range(8, 300)] + [(None, 1, "user", "nobody's"), (None, None, None, None)]


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "joined": 3}])
def test_trie(spark, sizes):
    rows = some_rows()
    table = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA + ", depth int, f1 int, part string").repartition(5)
    assert found(m.trie(table, **sizes)) == brute(rows)


def test_a_conversation_over_many_ranges(spark, monkeypatch):
    """Parts of one conversation in several tasks: products ahead of each part, also when a part ends within the head."""
    r = random.Random(1)
    rows = [(c, t, "u", r.choice("ab")) for c in (0, 100) for t in range(400)] + [(c, t, "u", r.choice("ab")) for c in range(1, 8) for t in range(3)]
    table = spark.createDataFrame(rows, SCHEMA)
    keys, old = ["conv_id", "turn", "t1", "t2"], type(table).repartitionByRange
    monkeypatch.setattr(type(table), "repartitionByRange", lambda self, *columns: old(self, 60, *columns))
    made = m.turns(table, 1)
    assert made.select("conv_id", "part").distinct().where("conv_id = 0").count() > 10 and len(keys) == 4
    assert found(m.trie(table, block=50)) == brute(rows)
    few = [(0, t, "u", str(t)) for t in range(9)] + [(c, t, "u", str(t)) for c in range(1, 40) for t in range(7)]
    monkeypatch.setattr(type(table), "repartitionByRange", lambda self, *columns: old(self, 150, *columns))
    assert found(m.trie(spark.createDataFrame(few, SCHEMA))) == brute(few)


def test_products():
    bases = m.Bases(3)
    turns = np.random.default_rng(1).integers(0, 2**31 - 100, (9, 4)).astype(np.uint64)
    got = bases.prefixes(turns, np.array([0, 4]))
    for run in (range(0, 4), range(4, 9)):
        x = [0] * 4
        for k in run:
            x = [(a * b + int(t)) % p for a, b, t, p in zip(x, bases.base, turns[k], m.PRIMES, strict=True)]
            assert got[k].tolist() == x
    assert bases.power(np.array([0, 1, 5, 10**12])).tolist() == [[pow(b, n, p) for b, p in zip(bases.base, m.PRIMES, strict=True)] for n in (0, 1, 5, 10**12)]


def test_equality_is_verified(spark, monkeypatch):
    table = spark.createDataFrame(some_rows(), SCHEMA)
    with pytest.raises(ValueError, match="one fingerprint"):
        m.trie(table, primes=(5, 7, 5, 7))
    monkeypatch.setattr(m, "_digest", lambda role, text: [F.length(text).cast("long").alias(c) for c in ("t1", "t2")])
    with pytest.raises(ValueError, match="one digest"):
        m.trie(table)


def test_empty_and_lonely(spark):
    empty = m.trie(spark.createDataFrame([], SCHEMA))
    assert [c for c in COLUMNS if c not in empty.columns] == [] and empty.collect() == []
    rows = [(7, 3, "u", "x"), (7, 3, "u", "x"), (7, None, "u", "y" * 50_000)]
    assert found(m.trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_sql_agrees(spark):
    from fringeworks.llm.queries import OP11_SQL, op11_prefix_trie

    data = "/root/testdata/sf0.001"
    db = duckdb.connect()
    db.sql(f"create view conversations as from '{data}/conversations.parquet'")
    want = db.sql(OP11_SQL)
    got = op11_prefix_trie(spark, data)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
    assert found(got) == brute(db.sql("from conversations").fetchall())
