"""Seeded, partition-independent order keys.

``md5(seed ':' key)`` gives the same order in any engine that has md5 and the
same decimal text for integers, is stable across task retries and does not
depend on how the input is split into files or partitions.  Everything that
"samples", "shuffles" or "splits" orders rows by this key instead of ``rand()``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _key_text(*cols: str | Column) -> Column:
    parts = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat_ws(":", *[p.cast("string") for p in parts])


def hash_order(seed: int, *key_cols: str | Column) -> Column:
    """32-hex-digit md5 of ``seed:key``; ordering by it is a seeded permutation."""
    return F.md5(F.concat(F.lit(f"{int(seed)}:"), _key_text(*key_cols)))


def hash_bucket(h: Column, digits: int) -> Column:
    """The first ``digits`` hex digits of an order key: ``16**digits`` equal buckets.

    Buckets preserve the order of the key, so "first k rows by key" can be
    decided bucket by bucket and only one bucket per stratum needs a rank.
    """
    return F.substring(h, 1, digits)


def hash_uniform(seed: int, *key_cols: str | Column) -> Column:
    """A uniform double in [0, 1) from the first 32 bits of the order key."""
    h = hash_order(seed, *key_cols)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)
