"""Masking of text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a random replacement is drawn from.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def hashed(c: Column) -> Column:
    """SHA-256 of the UTF-8 text, in hexadecimal."""
    return F.sha2(c, 256)


def masked(c: Column) -> Column:
    """First and last character stay, ``*`` between; two or fewer stay as is."""
    n = F.length(c)
    stars = F.repeat(F.lit("*"), F.greatest(n - 2, F.lit(0)))
    return F.when(n <= 2, c).otherwise(F.concat(F.substring(c, 1, 1), stars, F.substring(c, -1, 1)))


def scrambled(c: Column, salt: Column) -> Column:
    """Letters and digits of the same length, drawn from a per-row salt.

    The draw depends on the salt only, so a task that runs twice writes the same
    text twice.
    """
    n = F.length(c)
    draw = F.transform(
        F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
        lambda i: F.substr(F.lit(ALPHABET), F.pmod(F.xxhash64(salt, i), F.lit(len(ALPHABET))).cast("int") + 1, F.lit(1)),
    )
    return F.when(n == 0, F.lit("")).when(n > 0, F.array_join(draw, ""))
