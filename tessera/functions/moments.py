"""Confidence intervals from sums: population variance over a sample in which rows that don't
match count as 0, in closed form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z = 2.576  # two-sided 99 %


def half_width(variance: Column, z: float = Z) -> Column:
    return F.lit(z) * F.sqrt(F.greatest(variance, F.lit(0.0)))


def padded_variance(total: Column, squares: Column, n: Column) -> Column:
    """Of a sum and a sum of squares over ``n`` values."""
    mean = total / n
    return squares / n - mean * mean


def priority(seed: str, key: Column) -> Column:
    """A row's place in the random order of a seed: the same in any engine and partitioning."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def query_id(box: dict, target: str = "") -> str:
    """First ten hex digits of SHA-1 over the sorted predicates."""
    import hashlib

    text = "".join(f"{d}[{lo}, {hi}]" for d, (lo, hi) in sorted(box.items())) + target
    return hashlib.sha1(text.encode()).hexdigest()[:10]


def seed_of(identifier: str) -> int:
    """A query's seed: its id's first six hex digits."""
    return int(identifier[:6], 16)
