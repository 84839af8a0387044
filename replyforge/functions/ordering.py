"""Seeded pseudo-random order that every engine can reproduce.

``md5(seed:key)`` sorts rows in an order that looks random, depends only on the
key and the seed, and is the same on every run, cluster and engine.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def seeded_hash(key: Column, seed: int | str = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
