"""Alignment of two tokenizers against a plain walk over both libraries' tokens."""

import functools
import hashlib
import random
from collections import Counter, defaultdict

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from fringeworks.llm import alignment as m
from tests.llm import cases

@functools.lru_cache
def libraries():
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    return tok, sentencepiece.SentencePieceProcessor(model_file=B)


A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text) -> tuple[list, list] | None:
    """(id, begin, end) of both, or nothing."""
    if not text:
        return None
    (tok, sp), whole = libraries(), (" " + text).encode()
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    hidden = iter(range(256, 512))
    letter = {chr(b) if b in shown else chr(next(hidden)): b for b in range(256)}
    spelled = [
        [(k, bytes(letter[c] for c in tok.id_to_token(k))) for k in tok.encode(" " + text, add_special_tokens=False).ids],
        [(k, bytes([int(sp.id_to_piece(k)[3:5], 16)]) if sp.is_byte(k) else sp.id_to_piece(k).replace("▁", " ").encode()) for k in sp.encode(text)],
    ]
    if any(b"".join(x for _, x in own) != whole for own in spelled):
        return None
    out = []
    for own in spelled:
        at, made = 0, []
        for k, x in own:
            made.append((k, at, at := at + len(x)))
        out.append(made)
    return tuple(out)


def brute(texts: list) -> list[tuple]:
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each."""
    found, held = [], Counter()
    for text in texts:
        both = tokens(text)
        if both is None:
            found.append(None)
            continue
        a, b = both
        links = [(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(k) for k, x, y in own if begin <= x and y <= end) for own in (a, b)))
            begin = end
        held.update(set(links))
        found.append((len(a), len(b), groups, links))
    most = defaultdict(int)
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if x is None else (x[0], x[1], len(x[2]), len(x[3]), sum(held[p] == most[p[0]] for p in x[3]), sum(held[p] for p in x[3]), hashlib.sha256(";".join(x[2]).encode()).hexdigest()) for x in found]


def some_texts() -> list:
    r = random.Random(6)
    alphabet = [*"aZ é ß\n\n\t  ' '' 's't12._-$%|<>中文١½²ªº　\x1c\x85​", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", " the", "  ", "    ", "'ll", "\U0001f600", "▁", "\0", "é"]
    out = [t if t is None or len(t) < 3000 else t[:3000] for t in cases.texts()]
    out += ["".join(r.choice(alphabet) for _ in range(r.randrange(1, 40))) for _ in range(150)]
    return [*out, "<|endoftext|>", " ", "\n", "a▁b", "中文" * 200, "x" * 999, "the the the", "the the the", "the  the   the ", "﻿", "ﬁ①"]


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("bounds", [{}, {"most_pairs": 0, "slice_": 200, "most": 2000, "send": 20}])
def test_alignment(spark, bounds):
    """With windows remembered or forgotten, pairs broadcast or shuffled: the same."""
    texts = some_texts()
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in enumerate(texts)], "doc_id long, text string, n_a int, pairs string").repartition(3)
    found = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in m.align(docs, A, B, **bounds).collect()}
    want = brute(texts)
    assert sum(x[0] > 0 for x in want) > 100 and sum(x[0] == 0 for x in want) > 5
    assert [found[k] for k in range(len(texts))] == want


def test_odd_rows(spark):
    rows = [(None, "a b"), (1, "a b"), (1, "a b"), (2, None), (3, "")]
    found = m.align(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()
    want = brute([t for _, t in rows])
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in found) == Counter((k, *x) for (k, _), x in zip(rows, want, strict=True))
    empty = m.align(cases.nothing(spark), A, B)
    assert empty.columns == ["doc_id", *COLUMNS] and empty.collect() == []
    with pytest.raises(ValueError):
        m.align(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as _fw_row"), A, B)


def test_windows_are_words():
    """Anchors cut at blanks where both end; a window known by its ids isn't aligned again."""
    tools = m.Encoders(A, B)
    windows = m.Windows(tools)

    def numbers(text):
        (a, b), = tools.both([text])
        return windows.of([(a, tools.a_bytes.spelled(a)[1], b, tools.b_bytes.spelled(b)[1], m.np.frombuffer((" " + text).encode(), m.np.uint8))])[0].tolist()

    assert numbers("alpha beta alpha gamma") == [0, 1, 0, 2]
    assert numbers("gamma beta delta") == [2, 1, 3] and windows.count == 4
