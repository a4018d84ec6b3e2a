"""Seeded pseudo-random numbers that depend only on their arguments.

Unlike rand(), a draw does not depend on partitioning, so a retried task draws the same value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts) -> Column:
    """60-bit value from md5 of the parts joined by '|'; plain values become literals."""
    texts = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    digest = F.md5(F.concat_ws("|", *[t.cast("string") for t in texts]))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint")


def draw(n, *parts) -> Column:
    """Uniform integer in [0, n); the modulo bias is below n / 2**60."""
    bound = n if isinstance(n, Column) else F.lit(n)
    return F.pmod(stable_hash(*parts), bound)
