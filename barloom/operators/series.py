"""Order-dependent work on long series without one task per series.

A window partitioned by symbol alone puts a whole series into one task. Every
helper here splits a series into blocks of bounded length, works inside the
blocks, and carries what crosses a block edge:

* ``index_series``  global row numbers from per-chunk counts;
* ``with_halo``     rows near an edge are copied into the neighbour block, which
                    makes finite look-back and look-ahead windows exact;
* ``shift_across``  lag/lead by one row over chunks of any, even empty, size;
* ``prefix_over_chunks`` running totals from per-chunk totals;
* ``ema``           the recursive average as a closed form per sub-block.

Only per-chunk summaries (one row per chunk) are ever windowed by symbol.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from barloom.schema import BAR_START, IDX, SERIES_LEN, SYMBOL

BLOCK_ROWS = 8192
BLOCK = "block"
HOUR_CHUNK = 3600
BAR_CHUNK = 90 * 24 * 3600


def time_chunk(ts: str, seconds: int) -> Column:
    """Number of the fixed-length time span that holds ``ts``."""
    return F.floor(F.unix_seconds(F.col(ts)) / seconds)


def index_series(
    df: DataFrame,
    order: Sequence[str] = (BAR_START,),
    keys: Sequence[str] = (SYMBOL,),
    chunk: Column | None = None,
    idx: str = IDX,
    length: str = SERIES_LEN,
) -> DataFrame:
    """Add the 0-based position in the series and the series length.

    ``chunk`` must rise with ``order``; by default it is a span of 90 days of
    the first order column. ``df`` is read twice, so pass a stored table.
    """
    keys = list(keys)
    if chunk is None:
        chunk = time_chunk(order[0], BAR_CHUNK)
    chunked = df.withColumn("_chunk", chunk)
    by_series = Window.partitionBy(*keys)
    before = by_series.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        chunked.groupBy(*keys, "_chunk")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(
            *keys,
            "_chunk",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
            F.sum("_rows").over(by_series).alias(length),
        )
    )
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    return (
        chunked.withColumn("_pos", F.row_number().over(in_chunk))
        .join(offsets, [*keys, "_chunk"])
        .withColumn(idx, F.col("_before") + F.col("_pos") - 1)
        .drop("_chunk", "_pos", "_before")
    )


def with_halo(
    df: DataFrame,
    before: int,
    after: int = 0,
    block_rows: int = BLOCK_ROWS,
    idx: str = IDX,
    length: str = SERIES_LEN,
    keys: Sequence[str] = (SYMBOL,),
) -> DataFrame:
    """Assign rows to blocks, copying edge rows to the neighbours.

    ``block`` is the block a copy works in and ``is_own`` marks the copy that
    belongs there. After the windows, keep the ``is_own`` rows. Rows come back
    dealt by key and block, which all windows inside a block can use as it is.
    """
    if max(before, after) > block_rows:
        raise ValueError("a halo longer than a block would have to span two blocks")
    own = F.floor(F.col(idx) / block_rows)
    pos = F.pmod(F.col(idx), F.lit(block_rows))
    last = F.floor((F.col(length) - 1) / block_rows)
    targets = F.array_compact(
        F.array(
            own,
            F.when((pos >= block_rows - before) & (own < last), own + 1),
            F.when((pos < after) & (own > 0), own - 1),
        )
    )
    return (
        df.withColumn("_own", own)
        .withColumn(BLOCK, F.explode(targets))
        .withColumn("is_own", F.col(BLOCK) == F.col("_own"))
        .drop("_own")
        .repartition(*keys, BLOCK)
    )


@dataclass(frozen=True)
class BlockWindows:
    """Window specs over haloed blocks; the exchange of ``with_halo`` serves all of them.

    A block is cut further into sub-blocks for recurrences.
    """

    rows: WindowSpec
    within_sub: WindowSpec
    previous_sub: WindowSpec


def block_windows(keys: Sequence[str] = (SYMBOL,), sub: str = "sub", idx: str = IDX) -> BlockWindows:
    block = [*keys, BLOCK]
    return BlockWindows(
        rows=Window.partitionBy(*block).orderBy(sub, idx),
        within_sub=Window.partitionBy(*block, sub).orderBy(idx),
        previous_sub=Window.partitionBy(*block).orderBy(sub).rangeBetween(-1, -1),
    )


def with_sub_block(df: DataFrame, sub_rows: int, sub: str = "sub", idx: str = IDX) -> DataFrame:
    return df.withColumn(sub, F.floor(F.col(idx) / sub_rows))


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the halo copies; the block number stays for further in-block work."""
    return df.where("is_own").drop("is_own", "sub")


def ema_history(spans: Sequence[int]) -> int:
    """Rows after which a seed no longer shows in a double, as a power of two."""
    slowest = max(spans)
    decay = 1 - 2 / (slowest + 1)
    rows = math.ceil(53 * math.log(2) / -math.log(decay)) if decay > 0 else 1
    history = 1 << max(rows - 1, 1).bit_length()
    fastest = 1 - 2 / (min(spans) + 1)
    if fastest <= 0 or history * -math.log10(fastest) > 280:
        raise ValueError("these spans differ too much to share a sub-block; call once per span")
    return history


def ema_stages(
    x: str, span: int, sub_rows: int, w: BlockWindows, idx: str = IDX
) -> list[dict[str, Column]]:
    """Steps that build ``_ema_{span}``, each reading columns of the step before.

    Inside a sub-block, y_j = d^j * sum_{i<=j} w_i x_i d^-i with d = 1 - alpha is
    the average as if the value before it were 0; w_i is alpha, or 1 at the very
    first bar. The previous sub-block then adds its last value times d^(j+1).
    What older sub-blocks would add is below 2^-53 by the choice of ``sub_rows``.
    """
    alpha = 2 / (span + 1)
    d = F.lit(1 - alpha)
    j = F.pmod(F.col(idx), F.lit(sub_rows)).cast("double")
    weight = F.when(F.col(idx) == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    frame = w.within_sub.rowsBetween(Window.unboundedPreceding, 0)
    sums, local, carry = f"_sum_{span}", f"_local_{span}", f"_carry_{span}"
    return [
        {sums: F.sum(weight * F.col(x) * F.pow(d, -j)).over(frame)},
        {local: F.col(sums) * F.pow(d, j)},
        {carry: F.max_by(local, F.col(idx)).over(w.previous_sub)},
        {f"_ema_{span}": F.col(local) + F.coalesce(F.col(carry) * F.pow(d, j + 1), F.lit(0.0))},
    ]


def shift_across(
    df: DataFrame,
    chunk: Column,
    order: Sequence[str],
    shifted: dict[str, str],
    forward: bool = False,
    keys: Sequence[str] = (SYMBOL,),
) -> DataFrame:
    """Lag (or lead, if ``forward``) by one row, exact over chunk edges.

    ``shifted`` maps source columns to the names of their shifted copies. Inside
    a chunk this is a plain window; the row at the edge takes the boundary row
    of the nearest chunk that has rows. ``df`` is read twice.
    """
    keys = list(keys)
    chunked = df.withColumn("_chunk", chunk)
    in_chunk = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    edge_key = F.struct(*order) if len(order) > 1 else F.col(order[0])
    pick = F.min_by if forward else F.max_by
    move = F.lead if forward else F.lag
    edges = chunked.groupBy(*keys, "_chunk").agg(
        *[pick(F.col(src), edge_key).alias(f"_edge_{dst}") for src, dst in shifted.items()]
    )
    over_chunks = Window.partitionBy(*keys).orderBy("_chunk")
    edges = edges.select(
        *keys,
        "_chunk",
        *[move(f"_edge_{dst}").over(over_chunks).alias(f"_edge_{dst}") for dst in shifted.values()],
    )
    return (
        chunked.select(
            "*",
            move(F.lit(1)).over(in_chunk).isNull().alias("_at_edge"),
            *[move(src).over(in_chunk).alias(dst) for src, dst in shifted.items()],
        )
        .join(edges, [*keys, "_chunk"], "left")
        .select(
            *df.columns,
            *[
                F.when(F.col("_at_edge"), F.col(f"_edge_{dst}")).otherwise(F.col(dst)).alias(dst)
                for dst in shifted.values()
            ],
        )
    )


def prefix_over_chunks(
    df: DataFrame,
    chunk: str,
    order: Sequence[str],
    value: str,
    out: str,
    keys: Sequence[str] = (SYMBOL,),
) -> DataFrame:
    """Running sum of ``value`` from the series start, and its series total.

    Adds ``out`` (inclusive running sum) and ``{out}_total``. ``df`` is read
    twice: once for the per-chunk sums, once for the rows.
    """
    keys = list(keys)
    by_series = Window.partitionBy(*keys)
    before = by_series.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        df.groupBy(*keys, chunk)
        .agg(F.sum(value).alias("_sum"))
        .select(
            *keys,
            chunk,
            F.sum("_sum").over(before).alias("_carry"),
            F.sum("_sum").over(by_series).alias(f"{out}_total"),
        )
    )
    in_chunk = (
        Window.partitionBy(*keys, chunk)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        df.withColumn("_local", F.sum(value).over(in_chunk))
        .join(carried, [*keys, chunk])
        .withColumn(out, F.col("_local") + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_local", "_carry")
    )
