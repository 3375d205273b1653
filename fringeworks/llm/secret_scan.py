"""Secret scan: long unbroken strings as candidates, and a random forest that removes the false positives.

Candidates are runs of ``LEAST`` or more key characters, also with dots between such runs; shorter values (passwords of a few
letters, say) are none. Features: length and kinds of characters, transitions between kinds, entropy, variety and longest run of one
character, how much of the string the corpus' words cover, the words before it (names of credentials, of digests, of identifiers, key
prefixes), quotes and an assignment, and words of the path.
The dictionary is the corpus' own: the words of letters with the largest document counts, counted over all documents, with
a bound on what is sent to the tasks. The forest is grown in numpy from labelled findings, at most ``most_findings`` of
either label (smallest hash of the finding).

Labels don't come from a rule over the features. ``example_findings`` writes out findings whose label is known by how they were made:
random keys in the forms in which credentials are stored, and as false positives digests, identifiers, placeholders under a credential's
name, public values, long words and paths. Reviewed findings of the same columns can be given with or instead of them.

Cases: null and empty texts have no candidates, null paths are empty; a run of any length is one candidate; equal findings in repeated
rows and null doc_ids are each returned; with labels of one kind only, that label is every score; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math
import random
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fringeworks.llm.common import temporaries, written

LEAST, MOST_FINDINGS, MOST_WORDS, BEFORE, EXAMPLES = 16, 4000, 20_000, 48, 3000
RUN = r"[A-Za-z0-9+/_\-]{%d,}={0,2}"
#: Names that credentials are assigned to, names of digests and of identifiers, prefixes that issuers give to keys, words of paths.
NAMES = ("token", "secret", "password", "passwd", "api_key", "apikey", "access_key", "private_key", "auth", "credential", "bearer")
DIGESTS = ("sha", "md5", "commit", "checksum", "digest", "etag", "hash", "integrity", "revision", "blob")
IDENTIFIERS = ("id", "uuid", "guid", "request", "trace", "session", "ref", "data", "base")
PREFIXES = ("AKIA", "ghp_", "gho_", "xoxb-", "xoxp-", "sk-", "sk_live_", "AIza", "glpat-", "eyJ")
PATHS = (("test", "mock", "fixture", "example", "sample"), ("doc", "readme", ".md"), (".lock", "vendor", "dist", "checksums"), (".env", "config", ".yml", ".yaml", ".ini", "settings"))
FEATURES = 26
SCHEMA = "doc_id long, path string, begin long, length long, value string, before string, after string"


def candidates(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, path, begin (characters), length, value, before, after: one row per candidate."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        from fringeworks.llm.worker import kept

        kept("secrets")
        pattern = re.compile(r"%s(?:\.%s)*" % (RUN % least, RUN % least))
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, path, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                for m in pattern.finditer(text or ""):
                    i, j = m.span()
                    for column, value in zip(out, (doc_id, path, i, j - i, m[0], text[max(0, i - BEFORE) : i], text[j : j + 1]), strict=True):
                        column.append(value)
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=[x.split(" ")[0] for x in SCHEMA.split(", ")])

    return docs.select("doc_id", "path", "text").mapInArrow(run, SCHEMA)


def dictionary(docs: DataFrame, most: int = MOST_WORDS) -> list[str]:
    """At most ``most`` words of 3 to 12 letters, those in most documents (ties at the edge stay out); each task counts its own first."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        pattern, seen = re.compile(r"[a-z]{3,12}"), Counter()
        for b in batches:
            for text in b.column(0).to_pylist():
                seen.update({w for w in (text or "").lower().split() if pattern.fullmatch(w)})
            if len(seen) > 300_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen)), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
                seen.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    counts = written(docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    # the least count that at most ``most`` words reach: counts' own table is small, and only those words are sent
    room, least = most, None
    for r in counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(most).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["n"]
    return [] if least is None else sorted(r["word"] for r in counts.where(F.col("n") >= least).select("word").collect())


def example_findings(n: int = EXAMPLES, seed: int = 5) -> list[tuple]:
    """``n`` findings of known label, half of them false: (doc_id, path, begin, length, value, before, after, label)."""
    r = random.Random(seed)
    take = lambda letters, k: "".join(r.choice(letters) for _ in range(k))
    hexed, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = [take("bcdfglmnprstv", 1) + take("aeiou", 1) + take("lnrst", r.randrange(2)) for _ in range(120)]
    word = lambda k: "".join(r.choice(parts) for _ in range(k))
    prose = lambda: " ".join(word(r.randrange(1, 4)) for _ in range(6))[-30:] + " "
    case = lambda t: r.choice((str, str, str.upper, str.title))(t)
    named = lambda: r.choice(("", "", "aws_", "db_", "my_", "service_")) + r.choice(NAMES[:-1])

    def key() -> str:
        kind = r.randrange(6)
        if kind < 3:
            return case(take(hexed, r.choice((24, 32, 40, 40, 64))))
        if kind == 3:
            return take(mixed, r.randrange(20, 48))
        if kind == 4:
            return take(mixed + "+/", 43) + "="
        return r.choice(PREFIXES[:-1]) + take(mixed, r.randrange(16, 40))

    def secret() -> tuple[str, str, str]:
        form, value, name = r.randrange(7), key(), case(named())
        if form < 2:
            return f'{name} {r.choice("=:")} "', value, '"'
        if form == 2:
            return f"{name}='", value, "'"
        if form == 3:
            return f"export {name.upper()}=", value, r.choice(("", " ", "\n"))
        if form == 4:
            return f'"{name}": "', value, '"'
        if form == 5:
            return "Authorization: Bearer ", r.choice((value, "eyJ" + take(mixed, 30) + "." + take(mixed, 60) + "." + take(mixed, 43))), r.choice(('"', " ", "\n"))
        return r.choice((" ", "key ", "= ")), r.choice(PREFIXES[:-1]) + take(mixed, r.randrange(20, 40)), " "

    def other() -> tuple[str, str, str]:
        form, quote = r.randrange(8), r.choice(('"', "'", ""))
        if form == 0:  # a digest, with its name or bare
            return r.choice((f"{r.choice(DIGESTS)}{r.choice(('1', '256', ''))}{r.choice((': ', ' = ', ' ', '-', ':'))}{quote}", " ", "(")), case(take(hexed, r.choice((32, 40, 40, 64)))), quote or " "
        if form == 1:  # an identifier
            return f'{r.choice(IDENTIFIERS)}{r.choice((" = ", "=", ": "))}{quote}', str(uuid.UUID(int=r.getrandbits(128))), quote or " "
        if form == 2:  # a placeholder under a credential's name
            value = r.choice((r.choice("xX0*a1".replace("*", "_")) * r.randrange(16, 41), f"your_{r.choice(NAMES)}_goes_here", "changeme_" * r.randrange(2, 4), f"example{r.choice(NAMES)}value{r.randrange(9999)}", "0123456789abcdef" * r.randrange(1, 3), f"<{word(3)}>".strip("<>") + "_placeholder"))
            return f'{case(named())} {r.choice("=:")} {quote}', value if len(value) >= LEAST else value + "_" * LEAST, quote or " "
        if form == 3:  # a name of a function or variable
            return r.choice((" ", "= ", f"{named()} = ")), "_".join([word(2), *r.sample(NAMES, 2), word(2)]), r.choice("( .")
        if form == 4:
            return f"{r.choice((' ', '/', quote))}", "/".join(word(2) for _ in range(r.randrange(3, 6))), r.choice((" ", ".", quote or " "))
        if form == 5:  # encoded data
            return r.choice(("data:image/png;base64,", "integrity=sha384-", "src=")), take(mixed + "+/", r.randrange(60, 200)), r.choice(('"', " ", "\n"))
        value = case(word(9))[: r.randrange(LEAST, 26)]
        return r.choice((" ", quote, f"{named()} of ")), value + "".join(r.choice(parts) for _ in range(max(0, LEAST - len(value)))), r.choice(" .,\n")

    folders = ("src/app.py", "lib/net.js", "config/prod.env", "settings.yml", "tests/test_login.py", "docs/readme.md", "web/package.lock", "src0/en", "src3/de", "")
    out = []
    for k in range(n):
        before, value, after = other() if k % 2 else secret()
        before = (prose() + before)[-BEFORE:]
        out.append((k, r.choice(folders), len(before), len(value), value, before, after[:1], 1 - k % 2))
    return out


def labelled_findings(spark: SparkSession, n: int = EXAMPLES, seed: int = 5) -> DataFrame:
    """The ``example_findings`` as a table."""
    return spark.createDataFrame(example_findings(n, seed), f"{SCHEMA}, label int")


def by_rule(before: str, after: str) -> bool:
    """What the forest is held against: a quoted value that is assigned to a credential's name."""
    return bool(re.search(r"(%s)[a-z0-9_]*\s*[:=]\s*[\"']$" % "|".join(NAMES), before.lower())) and after in ('"', "'")


def _kind(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def _covered(low: str, words: set[str]) -> int:
    """Characters that words cover, the longest word at each place."""
    at = covered = 0
    while at < len(low):
        step = next((k for k in range(min(12, len(low) - at), 2, -1) if low[at : at + k] in words), 0)
        covered, at = covered + step, at + max(1, step)
    return covered


def features(values: list[str], befores: list[str], afters: list[str], paths: list[str], words: set[str]) -> np.ndarray:
    out = np.zeros((len(values), FEATURES))
    for row, value, before, after, path in zip(out, values, befores, afters, paths, strict=True):
        n, low, path = len(value), value.lower(), (path or "").lower()
        kinds = [_kind(c) for c in value]
        pairs = Counter(zip(kinds, kinds[1:]))
        steps = max(1, n - 1)
        counts = Counter(value)
        longest = max(len(m[0]) for m in re.finditer(r"(.)\1*", value, re.S))
        near = re.findall(r"[a-z_0-9]+", before.lower())[-2:]
        row[:] = [
            math.log(n), *[kinds.count(k) / n for k in range(4)],
            sum(m for (a, b), m in pairs.items() if a != b) / steps, (pairs[0, 2] + pairs[2, 0] + pairs[1, 2] + pairs[2, 1]) / steps,
            -sum(k / n * math.log2(k / n) for k in counts.values()), len(counts) / n, longest / n, _covered(low, words) / n,
            sum(c in "0123456789abcdefABCDEF" for c in value) / n, n % 4 == 0, value.startswith(PREFIXES), low.count("-") / n, low.count("/") / n,
            any(name in low for name in NAMES), bool(re.search(r"[:=]\s*[\"']?$", before)), before[-1:] in ('"', "'"), after in ('"', "'"),
            any(name in w for w in near for name in NAMES), any(name in w for w in near for name in DIGESTS) + any(w in IDENTIFIERS for w in near),
            *[any(w in path for w in kind) for kind in PATHS],
        ]
    return out


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 8, least_leaf: int = 3, seed: int = 11) -> list[np.ndarray]:
    """A random forest: each tree a table of (feature, threshold, low child, high child, share of secrets)."""
    rng, forest = np.random.default_rng(seed), []
    for _ in range(trees):
        nodes: list[list[float]] = []

        def split(rows: np.ndarray, level: int, nodes=nodes) -> int:
            me, rate = len(nodes), float(y[rows].mean())
            nodes.append([-1, 0, 0, 0, rate])
            if level == depth or rate in (0.0, 1.0) or len(rows) < 2 * least_leaf:
                return me
            best = (2 * rate * (1 - rate) - 1e-9, -1, 0.0)
            for f in rng.choice(x.shape[1], max(1, int(math.sqrt(x.shape[1]))), replace=False):
                order = rows[np.argsort(x[rows, f], kind="stable")]
                v, ones = x[order, f], np.cumsum(y[order])
                cut = np.flatnonzero((v[1:] > v[:-1])[least_leaf - 1 : len(v) - least_leaf]) + least_leaf
                if not len(cut):
                    continue
                low, high = ones[cut - 1] / cut, (ones[-1] - ones[cut - 1]) / (len(v) - cut)
                gini = (cut * low * (1 - low) + (len(v) - cut) * high * (1 - high)) * 2 / len(v)
                k = int(gini.argmin())
                if gini[k] < best[0]:
                    best = (float(gini[k]), int(f), float((v[cut[k] - 1] + v[cut[k]]) / 2))
            if best[1] >= 0:
                low = x[rows, best[1]] <= best[2]
                nodes[me][:2] = best[1], best[2]
                nodes[me][2] = split(rows[low], level + 1)
                nodes[me][3] = split(rows[~low], level + 1)
            return me

        split(rng.integers(0, len(y), len(y)), 0)
        forest.append(np.array(nodes))
    return forest


def scores(forest: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    total = np.zeros(len(x))
    for tree in forest:
        at = np.zeros(len(x), np.int64)
        while True:
            feature = tree[at, 0].astype(np.int64)
            inner = feature >= 0
            if not inner.any():
                break
            high = x[np.arange(len(x)), np.maximum(feature, 0)] > tree[at, 1]
            at = np.where(inner, tree[at, np.where(high, 3, 2)].astype(np.int64), at)
        total += tree[at, 4]
    return total / max(1, len(forest))


def _known_features(labelled: DataFrame, words: list[str]) -> DataFrame:
    sent = labelled.sparkSession.sparkContext.broadcast(set(words))

    def run(batches) -> Iterator:
        import pyarrow as pa

        for b in batches:
            x = features(*(b.column(k).to_pylist() for k in range(4)), sent.value)
            yield pa.RecordBatch.from_arrays([b.column(4), pa.array(list(x), pa.list_(pa.float64()))], names=["label", "x"])

    return labelled.select("value", "before", "after", "path", F.col("label").cast("int").alias("label")).mapInArrow(run, "label int, x array<double>")


def train(labelled: DataFrame, words: list[str], most_findings: int = MOST_FINDINGS) -> list[np.ndarray]:
    """The forest of at most ``most_findings`` findings of either label; only their features reach the driver."""
    order = F.xxhash64("doc_id", "begin", "value")
    rows = [r for label in (0, 1) for r in _known_features(labelled.where(F.col("label") == label).orderBy(order, "doc_id", "begin").limit(most_findings), words).collect()]
    if not rows:
        return []
    rows = sorted(rows, key=lambda r: (r["label"], r["x"]))
    return grow(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], float))


def scan(docs: DataFrame, findings: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """doc_id, path, begin, length, value_sha256, score: the secrets of ``docs`` (doc_id, path, text), false positives removed."""
    with temporaries(docs.sparkSession) as kept:  # candidates lie in clear on the shared disk until then
        found = written(candidates(docs), "candidates")
        words = dictionary(docs)
        sent = docs.sparkSession.sparkContext.broadcast((train(labelled_findings(docs.sparkSession) if findings is None else findings, words), set(words)))

        def run(batches) -> Iterator:
            import pyarrow as pa

            forest, known = sent.value
            for b in batches:
                value, before, after, path = (b.column(k).to_pylist() for k in (4, 5, 6, 1))
                score = scores(forest, features(value, before, after, path, known))
                yield pa.RecordBatch.from_arrays([b.column(k) for k in range(5)] + [pa.array(score)], names=["doc_id", "path", "begin", "length", "value", "score"])

        scored = found.mapInArrow(run, "doc_id long, path string, begin long, length long, value string, score double").where(F.col("score") >= threshold)
        return kept(scored.select("doc_id", "path", "begin", "length", F.sha2("value", 256).alias("value_sha256"), "score"), "secrets")
