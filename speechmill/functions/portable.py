"""Random draws that any engine can repeat: the first 32 bits of an MD5 of a key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _key(parts: tuple) -> Column:
    return F.concat_ws(":", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def bits(*key: Column | str | int) -> Column:
    """A long in [0, 2**32) from the parts of a key; never depends on partitioning."""
    return F.conv(F.substring(F.md5(_key(key)), 1, 8), 16, 10).cast("bigint")


def draw(n: Column | int, *key: Column | str | int) -> Column:
    """A long in [0, n)."""
    return bits(*key) % n


def uniform(*key: Column | str | int) -> Column:
    """A double in [0, 1)."""
    return bits(*key) / F.lit(TWO32)


def order_key(*key: Column | str | int) -> Column:
    """A sort key that shuffles rows the same way every time."""
    return F.md5(_key(key))
