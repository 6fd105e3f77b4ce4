"""A linear congruential generator as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Multiplier, increment, modulus, shift and range.
MULTIPLIER, INCREMENT, MODULUS, SHIFT, RANGE = 214013, 2531011, 2**31, 16, 32767


def step(seed: Column) -> Column:
    return (seed * MULTIPLIER + INCREMENT) % MODULUS


def draws(seed: Column, n: int) -> Column:
    """The first n values in [0, 1] as an array; products stay below 2**63."""
    first = F.array(step(seed.cast("long")))
    seeds = F.aggregate(F.sequence(F.lit(2), F.lit(max(n, 2))), first, lambda acc, i: F.concat(acc, F.array(step(F.element_at(acc, -1)))))
    return F.transform(F.slice(seeds, 1, n), lambda s: F.shiftright(s, SHIFT) / F.lit(float(RANGE)))


def between(u: Column, lo: Column, hi: Column) -> Column:
    return lo + u * (hi - lo)
