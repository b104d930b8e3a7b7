"""Deterministic pseudo-random draws: pure functions of a seed and a row key.

A draw never depends on partitioning, task order or retries, so a lost executor
recomputes exactly the same sample.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int | str, *keys: Column | str) -> Column:
    """md5 hex digest of ``seed|key1|key2...``; a total random order over distinct keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def uniform(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1) from the first 32 bits of :func:`key_hash`."""
    return F.conv(F.substring(key_hash(seed, *keys), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def coin(seed: int | str, *keys: Column | str, p: float = 0.5) -> Column:
    return uniform(seed, *keys) < F.lit(p)
