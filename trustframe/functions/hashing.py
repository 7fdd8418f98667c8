"""Seeded pseudo-random columns.

A random draw is a hash of ``(seed, purpose, row key)``, so it does not depend on partitioning, task retries or
row order, and the same draw can be made again anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def keyed_md5(key: Column, *parts: object) -> Column:
    """Hex MD5 of ``part:part:...:key``; its order is a uniform shuffle of the keys."""
    prefix = "".join(f"{part}:" for part in parts)
    return F.md5(F.concat(F.lit(prefix), key.cast("string")).cast("binary"))


def uniform_from_md5(digest: Column) -> Column:
    """Number in [0, 1) made from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def keyed_uniform(key: Column, *parts: object) -> Column:
    return uniform_from_md5(keyed_md5(key, *parts))
