"""Column expressions for whole-text work without Python: words, lines, windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_RUN = r"[\x20\x09-\x0D]+"
NON_ALNUM_RUN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it any number of times, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z for matching ASCII words.

    ``lower`` is fast and differs on ASCII letters only for the Kelvin sign and
    the dotted capital I; texts that hold one of these take ``translate``.
    """
    odd = text.contains("\u212a") | text.contains("\u0130")
    return F.when(odd, F.translate(text, ASCII_UPPER, ASCII_LOWER)).otherwise(F.lower(text))


def words(text: Column, separators: str = SPACE_RUN) -> Column:
    """Non-empty pieces between separators; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), separators), lambda w: w != "")


def gram_hashes(ws: Column, k: int) -> Column:
    """64-bit hash of every k consecutive words; ``ws`` must be a lambda variable or a stored column."""
    n = F.size(ws)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(ws, i + j) for j in range(k)]))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))
