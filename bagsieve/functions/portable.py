"""Choices that are the same on any number of partitions, in any order of rows, and in other engines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shuffle_key(seed, *keys) -> Column:
    """A pseudo-random order: md5 of the seed and the keys."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in keys]))


def truncated(ratio: float, n: Column) -> Column:
    """int(ratio * n) in double precision."""
    return (F.lit(float(ratio)) * n).cast("long")


def half_even(x: Column) -> Column:
    """round() to the even neighbour."""
    return F.bround(x, 0).cast("long")


def lower_median(x: str) -> Column:
    """Aggregate: the lower of the two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {x})")
