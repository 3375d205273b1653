"""64-bit words to I, Q and the turn counter, and what follows from a single sample.

A word holds a signed 24-bit Q in bits 0-23, a signed 24-bit I in bits 24-47 and a signed 16-bit turn counter M in bits
48-63. Shifts on a signed BIGINT extend the sign, so no branch is needed and everything stays in generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Base rates in Hz for the flag ``l`` and otherwise, fastest rate, wavelength in m, step of M that is a wrap.
BASE_LOW, BASE_HIGH, MOST_RATE, WAVELENGTH, WRAP = 1e7, 2e7, 1e7, 1550e-9, 0xF000


def i_of(word) -> Column:
    return F.shiftright(F.shiftleft(word, 16), 40).cast("int")


def q_of(word) -> Column:
    return F.shiftright(F.shiftleft(word, 40), 40).cast("int")


def m_of(word) -> Column:
    return F.shiftright(word, 48)


def decode(words: DataFrame, word: str = "word") -> DataFrame:
    """``words`` with i, q and m in place of the word."""
    return words.select("*", i_of(F.col(word)).alias("i"), q_of(F.col(word)).alias("q"), m_of(F.col(word)).alias("m")).drop(word)


def cycles(i="i", q="q", turns="m") -> Column:
    """Reduced phase in cycles; the angle's first argument is I."""
    return -F.atan2(F.col(i), F.col(q)) / (2 * F.pi()) - F.col(turns)


def radius(i="i", q="q") -> Column:
    return F.hypot(F.col(q), F.col(i))


def base_rate(flags: str = "flags") -> Column:
    return F.when(F.map_contains_key(F.col(flags), F.lit("l")), BASE_LOW).otherwise(BASE_HIGH)


def rate(flags: str = "flags") -> Column:
    """Samples a second: the base rate over one more than the skip flag."""
    return base_rate(flags) / (1 + F.coalesce(F.expr(f"try_cast({flags}['s'] as double)"), F.lit(0.0)))


def valid_rate(fs) -> Column:
    return (fs <= MOST_RATE) & (BASE_HIGH / fs == F.floor(BASE_HIGH / fs))


def metres(c) -> Column:
    return c * WAVELENGTH


def microns_in_fibre(c) -> Column:
    """Cycles to micrometres at a refractive index of 1.5."""
    return c * (1.55 / 1.5)


def to_db(x) -> Column:
    return 20 * F.log10(x)


def from_db(db) -> Column:
    return F.pow(F.lit(10.0), db / 20)
