"""Repeatable pseudo-random values derived from md5, independent of partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw_key(seed: int, *keys: Column) -> Column:
    """Hex digest that orders rows pseudo-randomly."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def unit_draw(digest: Column) -> Column:
    """Uniform number in [0, 1) from the first 32 bits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket_of(digest: Column, hex_digits: int = 4) -> Column:
    """Leading hex digits as an int: 16**hex_digits evenly filled, order-preserving buckets."""
    return F.conv(F.substring(digest, 1, hex_digits), 16, 10).cast("int")
