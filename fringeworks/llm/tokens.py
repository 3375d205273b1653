"""Ids of whole texts by the tokenizers library, each distinct pre-token encoded once in a while per worker.

Both vocabularies split a text into pre-tokens before they merge anything, so the ids of a text are the ids of its
pre-tokens in a row. ``PieceIds`` remembers the library's ids of a pre-token, in two generations of bounded bytes.

A text of plain characters (ASCII and Latin letters) is split by the pattern that the vocabulary file names. Other texts are cut into
chunks first: at a space whose left neighbour is not white space (``spaced=True``: the space belongs to the chunk on its
right, and a run of several blanks stays whole), or at any space or line feed where the tokenizer drops white space
(``spaced=False``). Chunks that aren't plain, or hold a special string, go to the library whole.
"""

from __future__ import annotations

import os
import re
import struct

os.environ["TOKENIZERS_PARALLELISM"] = "false"

#: A space after white space: then a run must stay whole. The space leads, so that the search runs from space to space.
_RUN = re.compile(r" (?<=\s )")
_CUT = re.compile(r"(?<=\S) ")
#: ASCII but for the separators 1C-1F (white space in Python only), Latin-1 letters and Latin Extended-A but for the one whose lower case is two characters.
_PLAIN = re.compile(r"[\x00-\x1b\x20-\x7fÀ-įı-ſ]*\Z")
#: The split patterns that the two vocabulary files name, written for plain characters only; letters first, as most pieces are.
_LETTERS, _BLANKS = "A-Za-zÀ-ÖØ-öø-ſ", r" \t\n\x0b\x0c\r"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_PATTERNS = {
    True: re.compile(rf" ?[{_LETTERS}]+|{_SHORT}| ?[0-9]+| ?[^{_BLANKS}0-9{_LETTERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"),
    False: re.compile(rf"[{_LETTERS}]+|{_SHORT}|[0-9]|[^{_BLANKS}0-9{_LETTERS}]+"),
}

#: Bytes that a generation of a worker's memory may hold (an entry counts as its strings and ENTRY), and the longest piece that is kept.
MOST, ENTRY, LONGEST = 40 << 20, 160, 64


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = {b for a, z in ((33, 126), (161, 172), (174, 255)) for b in range(a, z + 1)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class PieceIds(dict):
    """pre-token, or chunk that isn't plain -> its ids as little-endian uint32 bytes.

    At ``most`` bytes the entries become the old generation, from which what is asked for again is taken back; forgetting only costs time.
    """

    def __init__(self, path: str, spaced: bool, most: int = MOST):
        from tokenizers import Tokenizer

        self.tok, self.spaced, self.most, self.size = Tokenizer.from_file(path), spaced, most, 0
        self.model, self.find = self.tok.model, _PATTERNS[spaced].findall
        self.old: dict[str, bytes] = {}
        self.letters = dict(enumerate(_byte_letters()))
        self.blank = self.letters[32]
        self.special = special_strings(path)

    def __missing__(self, piece: str) -> bytes:
        """Of a pre-token of plain characters: the model alone."""
        ids = self.old.get(piece)
        if ids is None:
            if piece.isascii() and piece.isprintable():
                word = piece.replace(" ", self.blank)  # all others stand for themselves
            else:
                word = piece.encode().decode("latin-1").translate(self.letters)
            ids = id_bytes([t.id for t in self.model.tokenize(word)])
        return self.remembered(piece, ids)

    def remembered(self, piece: str, ids: bytes) -> bytes:
        if len(piece) <= LONGEST:
            if self.size >= self.most:
                self.old, self.size = dict(self), 0
                self.clear()
            self[piece] = ids
            self.size += len(piece) + len(ids) + ENTRY
        return ids

    def whole(self, unit: str) -> bytes:
        """Of a chunk that isn't plain: the library's whole way."""
        if ids := self.get(unit):
            return ids
        return self.remembered(unit, self.old.get(unit) or id_bytes(self.tok.encode(unit, add_special_tokens=False).ids))

    def plain(self, text: str) -> bool:
        return bool(_PLAIN.match(text)) and not any(s in text for s in self.special)

    def pieces(self, text: str) -> list[str]:
        return self.find(text if self.spaced else text.lower())

    def encode(self, unit: str) -> bytes:
        """Of a chunk, or of a pre-token."""
        return b"".join(map(self.__getitem__, self.pieces(unit))) if self.plain(unit) else self.whole(unit)

    def of(self, text: str) -> bytes:
        if not text:
            return b""
        if self.plain(text):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        found = []
        for k, chunk in enumerate(chunks(text, self.spaced)):
            unit = " " + chunk if self.spaced and k else chunk
            if self.plain(unit):
                found += map(self.__getitem__, self.pieces(unit))
            else:
                found.append(self.whole(unit))
        return b"".join(found)


def special_strings(path: str) -> set[str]:
    """The strings that the vocabulary takes as one id wherever they stand."""
    import json

    with open(path, encoding="utf-8") as f:
        return {t["content"] for t in json.load(f)["added_tokens"]}


def split_plain(unit: str, spaced: bool, special: set[str]) -> list[str]:
    """The pre-tokens of a chunk; one with other than plain characters or a special string stays whole."""
    if _PLAIN.match(unit) and not any(s in unit for s in special):
        return _PATTERNS[spaced].findall(unit)
    return [unit] if unit else []


def chunks(text: str, spaced: bool) -> list[str]:
    if not spaced:
        return text.replace("\n", " ").split(" ")
    if _RUN.search(text):
        return _CUT.split(text)
    return text.split(" ")


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def piece_ids(path: str, spaced: bool, most: int = MOST) -> PieceIds:
    """The memory of this worker process for the vocabulary."""
    from fringeworks.llm.worker import kept

    return kept(("ids", path, spaced, most), lambda: PieceIds(path, spaced, most))


def id_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit."""
    return _PACK[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}I", *ids)
