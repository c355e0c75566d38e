"""Seeded, engine-independent randomness: every draw is a function of the record id and the seed.

The same id gives the same draw whatever the partitioning, so samples survive task retries unchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_RANGE = 2**32


def hash32(key: Column, salt: str) -> Column:
    """First eight hex digits of md5("key:salt") as a number in [0, 2^32); a null key draws like an empty one."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{salt}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def uniform(key: Column, salt: str) -> Column:
    return hash32(key, salt) / F.lit(float(HASH_RANGE))


def poisson_steps(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... of a Poisson variable, as far as a 32-bit draw can tell them from 1."""
    if rate < 0:
        raise ValueError(f"rate must not be negative, got {rate}")
    if rate == 0:
        return []
    steps, k, total = [], 0, math.exp(-rate)
    while total <= 1.0 - 1.0 / HASH_RANGE:
        steps.append(total)
        k += 1
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1))
    return steps


def poisson_copies(draw: Column, rate: float) -> Column:
    """Number of copies of a record, by inversion of the Poisson distribution at a uniform draw."""
    copies = F.lit(0)
    for step in poisson_steps(rate):
        copies = copies + (draw >= F.lit(step)).cast("int")
    return copies
