"""Sums (or unions) of fixed-size arrays that tasks make beside their rows.

A task cuts its array into rows (part, data). They are folded in two streaming
steps, each holding one array at most, so neither the number of tasks nor of
input rows matters to memory; the driver receives one array of the fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARE = "part int, data binary"
_SALTS = 8


def share(array: np.ndarray, rows: int = 64) -> pd.DataFrame:
    """The rows of one task's array; all-zero parts are left out."""
    parts = np.array_split(array.reshape(-1), rows)
    used = [i for i, p in enumerate(parts) if p.any()]
    return pd.DataFrame({"part": np.array(used, dtype=np.int32), "data": [parts[i].tobytes() for i in used]})


def _folding(read, keep, combine, finish=None):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, np.ndarray] = {}
        for frame in frames:
            for part, data in zip(frame["part"], frame["data"]):
                more = np.frombuffer(data, dtype=read).astype(keep)
                held[part] = combine(held[part], more) if part in held else more
        done = [finish(a) if finish else a for a in held.values()]
        yield pd.DataFrame({"part": list(held), "data": [a.tobytes() for a in done]})

    return run


def fold(shares: DataFrame, dtype, size: int, combine=np.add, wide=None, rows: int = 64, finish=None) -> np.ndarray:
    """The combined array of ``size`` elements; zeros where no task had anything.

    Tasks send elements of ``dtype``; they are combined and returned as ``wide``, if it is given. ``finish`` makes of
    each part of the combined array what the driver receives: as many elements, and zeros of zeros.
    """
    wide = wide or dtype
    n = int(shares.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    salt = F.pmod(F.xxhash64("data"), F.lit(_SALTS))
    once = shares.select("part", "data").repartition(n, "part", salt).mapInPandas(_folding(dtype, wide, combine), SHARE)
    total = once.repartition(min(n, rows), "part").mapInPandas(_folding(wide, wide, combine, finish), SHARE)
    out = finish(np.zeros(1, dtype=wide)).dtype if finish else wide
    parts = np.array_split(np.zeros(size, dtype=out), rows)
    for row in total.collect():
        parts[row.part][:] = np.frombuffer(row.data, dtype=out)
    return parts[0].base
