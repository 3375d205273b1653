"""Small tables with awkward rows, and plain Python versions of what the operators do."""

import random
import re
import zlib
from collections import Counter, defaultdict

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row long, bucket string, term array<int>, component int"


def texts() -> list:
    r = random.Random(5)
    words = ["the", "of", "and", "alpha", "Beta", "gämma", "delta,", "épsilon", "zeta.", "eta", "theta", "iota"] + [f"w{k}" for k in range(200)]
    made = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage, long = made(120), made(40), made(20_000)
    out = [None, "", " \n\t ", "a", "A b", "one two three four", "1234 !!", "<|endoftext|> x  y   z\n\n  t", base, base, base, base + " more", base.replace("alpha", "omega", 1)]
    out += [made(30) + " " + passage + " " + made(r.randrange(0, 60)) for _ in range(6)]
    out += [long, long + " end", "x" * 5000, "é" * 300, base[:250] + made(50), made(3), made(10) + "\n" + passage.upper()]
    for k in range(12):  # a group of near copies
        w = base.split(" ")
        w[(k * 7) % len(w)] = f"edit{k}"
        out.append(" ".join(w))
    return out


def rows() -> list[tuple]:
    out = [(k, t, ["en", "de", None][k % 3], None if k % 5 == 0 else f"s{k % 4}", None, k, "b", [k], k) for k, t in enumerate(texts())]
    return out


def documents(spark, some=None):
    return spark.createDataFrame(rows() if some is None else some, SCHEMA).repartition(3, "doc_id")


def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(text: str) -> bytes:
    return bytes(b + 32 if 65 <= b <= 90 else b for b in text.encode())


def shingles(text, k: int) -> set:
    w = re.findall(rb"[^\x20\x09-\x0d]+", lower(text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(docs: dict, k: int, num: int, den: int) -> dict:
    sets, up = {d: shingles(t, k) for d, t in docs.items()}, {d: d for d in docs}

    def root(d):
        while up[d] != d:
            d = up[d]
        return d

    lists = defaultdict(list)
    for d in sorted(sets):
        shared = Counter(o for s in sets[d] for o in lists[s])
        for s in sets[d]:
            lists[s].append(d)
        for o, n in shared.items():
            if den * n >= num * (len(sets[d]) + len(sets[o]) - n):
                a, b = root(d), root(o)
                up[max(a, b)] = min(a, b)
    return {d: (len(sets[d]), root(d)) for d in docs}


def repeats(docs: dict, least: int) -> dict:
    """doc -> (bytes, removed flags), by the set of all strings that began earlier."""
    seen, out = set(), {}
    for d in sorted(docs):
        data = (docs[d] or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - least + 1):
            s = data[i : i + least]
            if s in seen:
                gone[i : i + least] = b"\1" * least
            seen.add(s)
        out[d] = (data, bytes(gone))
    return out


def hits(docs: dict, items: dict, window: int = 10) -> dict:
    kind = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    wins = defaultdict(set)
    for k, t in items.items():
        w = re.findall(kind, lower(t or ""))
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            wins[tuple(w[i : i + n])].add(k)
    out = {}
    for d, t in docs.items():
        w, hit, found = re.findall(kind, lower(t or "")), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if own := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    found |= own
        out[d] = (len(w), len(hit), sorted(map(str, found)))
    return out


def crc(ids: list[int]) -> int:
    return zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids))


def maximal_repeats(docs: list, least: int) -> dict:
    """string -> its places (row, begin), of every string of a pair of places that can be extended on neither side."""
    data = [(t or "").encode() for t in docs]
    places, found = defaultdict(list), set()
    for d, t in enumerate(data):
        for i in range(len(t) - least + 1):
            places[t[i : i + least]].append((d, i))
    for own in places.values():
        for x, (d, i) in enumerate(own):
            for e, j in own[:x]:
                a, b = data[d], data[e]
                if i and j and a[i - 1] == b[j - 1]:
                    continue
                n = least
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                found.add(a[i : i + n])
    return {w: sorted((d, i) for d, i in places[w[:least]] if data[d][i : i + len(w)] == w) for w in found}
