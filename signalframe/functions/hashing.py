"""Deterministic randomness: every random choice is a SHA-256 of (seed, key).

The value depends only on the key and the seed, never on partitioning, task
retries or row order, so a lost executor recomputes the same draw.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digest(seed, *cols) -> Column:
    """Hex SHA-256 of ``seed::col::col``."""
    parts = [F.lit(str(seed))] + [_col(c).cast("string") for c in cols]
    return F.sha2(F.concat_ws("::", *parts), 256)


def uniform(seed, *cols) -> Column:
    """First eight digest bytes as a double in [0, 1)."""
    return uniform_of(digest(seed, *cols))


def uniform_of(hex_digest: Column) -> Column:
    head = F.conv(F.substring(hex_digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double")
    return head / F.lit(float(2**64))


def choice(u: Column, n) -> Column:
    """Index in ``0..n-1`` from a uniform draw."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.least(F.floor(u * size).cast("int"), (size - 1).cast("int"))


def normals(seed, *cols, count) -> Column:
    """Array of ``count`` standard normal draws.

    One digest of (seed, key, block number) gives four 64-bit draws, and Box-Muller
    makes four normals of them: sample i is number ``i % 4`` of block ``i // 4``, so any
    sample can be drawn alone.
    """
    size = count if isinstance(count, Column) else F.lit(count)
    part = lambda d, k: F.conv(F.substring(d, 16 * k + 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(float(2**64))

    def pair(d, k):
        radius = F.sqrt(-2.0 * F.log(F.greatest(part(d, k), F.lit(1e-12))))
        angle = 2.0 * F.pi() * part(d, k + 1)
        return radius * F.cos(angle), radius * F.sin(angle)

    def four(b):
        return F.get(F.transform(F.array(digest(seed, *cols, b)), lambda d: F.array(*pair(d, 0), *pair(d, 2))), F.lit(0))

    blocks = F.sequence(F.lit(0), F.ceil(F.greatest(size, F.lit(1)) / 4).cast("int") - 1)
    return F.slice(F.flatten(F.transform(blocks, four)), 1, size)


def _col(c) -> Column:
    return c if isinstance(c, Column) else F.col(c)
