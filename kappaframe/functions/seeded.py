"""Reproducible pseudo-random numbers as plain column arithmetic.

The same arithmetic runs in any SQL engine, so a seeded draw can be checked there. `MODULUS` is the
Mersenne prime 2^31-1; every intermediate value fits a BIGINT.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODULUS = 2147483647


def mix_sql(expression: str, seed: int) -> str:
    """SQL text for a number in [0, MODULUS) drawn from a non-negative BIGINT expression."""
    first = f"((({expression}) % {MODULUS} * 48271 + {seed * 16807 % MODULUS}) % {MODULUS})"
    return f"((({first} * {first}) % {MODULUS} * 16807 + {first}) % {MODULUS})"


def mix(column: Column | str, seed: int) -> Column:
    """Column form of `mix_sql`."""
    value = F.col(column) if isinstance(column, str) else column
    first = (value.cast("bigint") % MODULUS * 48271 + seed * 16807 % MODULUS) % MODULUS
    return ((first * first) % MODULUS * 16807 + first) % MODULUS


def mix_text(column: Column | str, seed: int) -> Column:
    """`mix` for ids that are not numbers."""
    return F.pmod(F.xxhash64(F.lit(seed), column), F.lit(MODULUS))


def uniform(draw: Column) -> Column:
    return draw / F.lit(float(MODULUS))


def slice_of_draw(draw: Column, slices: int) -> Column:
    """Equal-width slice number of a draw; slices follow the draw's order and hold about equally many rows."""
    return F.floor(draw * slices / F.lit(MODULUS)).cast("bigint")
