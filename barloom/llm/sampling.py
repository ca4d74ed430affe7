"""Bounded samples for fitting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RANGE = 1 << 30


def hash_sample(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """About ``n`` rows, those whose keys hash lowest; all rows if there are no more than ``n``.

    The share of hashes is set from the row count, so nothing is sorted or gathered.
    """
    total = rows.count()
    if total <= n:
        return rows
    return rows.where(F.pmod(F.xxhash64(*keys), F.lit(_RANGE)) < max(1, round(n / total * _RANGE)))


def collect_sample(rows: DataFrame, n: int, *keys: str) -> list:
    """The rows of a sample in a fixed order; twice ``n`` at most, even if all rows share one key."""
    return sorted(hash_sample(rows, n, *keys).limit(2 * n).collect(), key=lambda r: [str(r[k]) for k in keys])
