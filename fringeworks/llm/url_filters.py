"""URL filters: all wildcard rules at once over each canonical URL, as one automaton of bits.

A canonical URL is the host, A-Z lower-cased, and the path: what follows the first ``://`` up to ``?`` or ``#``. A rule is a glob over
its UTF-8 bytes: ``*`` stands for any run without ``/``, ``**`` for any run, ``?`` for one byte but ``/``; all else stands for itself.

1. Each glob becomes a row of bits, one for each byte it asks for and one ahead of them; the rows of all globs stand one after the other in
   64-bit words (``Automaton``). For each byte value one mask has the bits that it moves into, another those that a wildcard lets stay.
2. A step over a byte is ``((D << 1) & into[byte]) | (D & stay[byte])`` with a carry from word to word, for all globs and for
   a slice of URLs together (Shift-And). A bit that enters the next row by the shift is cut off, as no byte leads into a row's first bit.
3. After a URL's last byte, the last bits of the rows say which globs match the whole of it.

Site rules (``example.net/en/``: the host and all its subdomains, and paths that begin so) are two globs each and come first; the longest of those
that fit decides. Where none fits, of the globs that match the one with most literal bytes decides, of equals one that blocks, then
the first by name; where none matches, the default.

One pass without a shuffle: rules are parameters of the job (at most ``MOST_BYTES`` of globs, else refused), documents stay where they
are. Words are worked on in groups of ``WORDS``, URLs in slices of at most ``SLICE`` (URL, rule) pairs, so memory depends on neither.

Cases: a null url, or one without ``://``, has an empty host and path, which no site rule fits and only globs of stars match; rows with equal or null ids
are judged each; urls of any length are read whole; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 64-bit words of states that are stepped together; (URL, rule) pairs of a slice; bytes of all globs that a job may be given.
WORDS, SLICE, MOST_BYTES = 64, 1 << 18, 1 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SLASH = ord("/")


class Rule(NamedTuple):
    name: str
    action: str  # "allow" or "block"
    site: bool = False


def site(action: str, host_and_path: str) -> Rule:
    """A rule for a host, its subdomains and the paths that begin as given: ``example.net/en/``."""
    if "/" not in host_and_path or set("*?") & set(host_and_path):
        raise ValueError(f"a site rule is a host and the beginning of a path: {host_and_path}")
    return Rule(host_and_path, action, True)


def globs_of(rule: Rule) -> list[str]:
    return [f"{rule.name}**", f"*.{rule.name}**"] if rule.site else [rule.name]


def _tokens(glob: str) -> list[str | int]:
    """Bytes, "?", "*" and "**"."""
    data, out, at = glob.encode(), [], 0
    while at < len(data):
        one = data[at : at + 1]
        if one == b"*":
            wide = data[at : at + 2] == b"**"
            out.append("**" if wide else "*")
            at += 1 + wide
        else:
            out.append("?" if one == b"?" else data[at])
            at += 1
    return out


class _Group:
    """Globs whose bits lie in the same few words."""

    def __init__(self, globs: list[list]):
        bits = sum(1 + sum(x not in ("*", "**") for x in g) for g in globs)
        words = -(-bits // 64)
        into, stay = (np.zeros((256, words * 64), bool) for _ in range(2))
        first = np.zeros(words * 64, bool)
        last, at = [], 0
        for glob in globs:
            first[at] = True
            for x in glob:
                if x in ("*", "**"):
                    stay[:, at] = True
                    stay[_SLASH, at] = x == "**"
                    continue
                at += 1
                if x == "?":
                    into[:, at] = True
                    into[_SLASH, at] = False
                else:
                    into[x, at] = True
            last.append(at)
            at += 1
        pack = lambda rows: np.packbits(rows, axis=-1, bitorder="little").view("<u8")
        self.into, self.stay, self.first = pack(into), pack(stay), pack(first)
        self.word, self.bit = np.array(last) >> 6, (np.array(last) & 63).astype(np.uint64)

    def matches(self, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """(URL, glob): does it match the whole; URLs come longest first."""
        state = np.repeat(self.first[None], len(begin), 0)
        ascending = size[::-1]
        for at in range(int(size[0]) if len(size) else 0):
            some = len(size) - int(np.searchsorted(ascending, at, "right"))  # those that have a byte here
            byte, now = data[begin[:some] + at], state[:some]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[:some] = (moved & self.into[byte]) | (now & self.stay[byte])
        return (state[:, self.word] >> self.bit) & np.uint64(1) == 1


class Automaton:
    """All globs of the rules, in groups of at most ``WORDS`` words."""

    def __init__(self, rules: list[Rule], words: int = WORDS):
        if sum(len(r.name.encode()) for r in rules) > MOST_BYTES:
            raise ValueError(f"rules of over {MOST_BYTES} bytes")
        # the rule that decides comes first
        self.rules = sorted(dict.fromkeys(rules), key=lambda r: (not r.site, -_weight(r), r.action != "block", r.name))
        self.rule_of, self.groups, held, bits = [], [], [], 0
        for k, rule in enumerate(self.rules):
            for glob in map(_joined, map(_tokens, globs_of(rule))):
                if held and bits + len(glob) + 1 > words * 64:
                    self.groups.append(_Group(held))
                    held, bits = [], 0
                held.append(glob)
                bits += len(glob) + 1
                self.rule_of.append(k)
        if held:
            self.groups.append(_Group(held))

    def matches(self, urls: list[bytes]) -> np.ndarray:
        """(URL, rule): does the rule fit."""
        out = np.zeros((len(urls), len(self.rules)), bool)
        size = np.array([len(u) for u in urls], np.int64)
        order = np.argsort(-size, kind="stable")
        begin = (np.cumsum(size) - size)[order]
        data = np.frombuffer(b"".join(urls), np.uint8)
        at = 0
        for group in self.groups:
            found = group.matches(data, begin, size[order])
            for k in range(found.shape[1]):
                out[order, self.rule_of[at + k]] |= found[:, k]
            at += found.shape[1]
        return out


def _joined(tokens: list) -> list:
    """Stars in a row are one: the wider."""
    out: list = []
    for x in tokens:
        if x in ("*", "**") and out and out[-1] in ("*", "**"):
            out[-1] = max(out[-1], x)
        else:
            out.append(x)
    return out


def _weight(rule: Rule) -> int:
    return len(rule.name) if rule.site else sum(isinstance(x, int) for x in _tokens(rule.name))


def canonical(url: str = "url") -> tuple:
    """Columns of the host and the path."""
    begin = F.instr(F.col(url), "://")
    rest = F.when(begin > 0, F.substring(F.col(url), begin + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (the site rule that decides), verdict, glob (the glob that decides), n_globs (that match): a row for each page."""
    host, path = canonical()
    Automaton(rules)  # refuses on the driver what it can't hold

    def run(batches) -> Iterator:
        import pyarrow as pa

        automaton = Automaton(rules)
        names = np.array([r.name for r in automaton.rules] + [None], object)
        actions = np.array([r.action for r in automaton.rules] + [default], object)
        sites = sum(r.site for r in automaton.rules)
        step = max(1, min(4096, SLICE // max(1, len(automaton.rules))))
        for whole in batches:
            for begin in range(0, whole.num_rows, step):
                batch = whole.slice(begin, step)
                urls = [(h + p).encode() for h, p in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                fits = automaton.matches(urls)
                best = np.where(fits.any(1), fits.argmax(1), len(automaton.rules)) if len(automaton.rules) else np.zeros(len(urls), np.int64)
                by_site = best < sites
                rule, glob = (np.where(own, names[best], None) for own in (by_site, ~by_site))
                count = fits[:, sites:].sum(1).astype(np.int64)
                made = [pa.array(rule.tolist(), pa.string()), pa.array(actions[best].tolist(), pa.string()), pa.array(glob.tolist(), pa.string()), pa.array(count)]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=["page_id", "host", "path", "rule", "verdict", "glob", "n_globs"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", host.alias("host"), path.alias("path")).mapInArrow(run, f"page_id {kind}, host string, path string, rule string, verdict string, glob string, n_globs long")
