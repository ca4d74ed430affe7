"""Exact quantiles by rank, without one task holding all values and without shuffling them.

The built-in exact percentile keeps every distinct value of a group in one
buffer. Here a sketch of the values gives splitters, the range between two
splitters is cut into equal cells, and a histogram over the cells (combined map-side)
locates each wanted rank. Only the values of the cells that hold a wanted rank are
shuffled and ordered; a cell that is too full is cut the same way again. The sketch
decides how well the cells are balanced, never what the answer is.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.functions import is_finite
from barloom.schema import SYMBOL
from barloom.session import materialize

TAIL = [0.0001, 0.001, 0.01]
SPLITTERS = [*TAIL, *[i / 16 for i in range(1, 16)], *[1 - q for q in reversed(TAIL)]]
CELLS = 1024  # per range between splitters
FULL_CELL = 1_000_000  # rows of different values that one task may order
DEPTHS = 4
NEAREST, LINEAR = "nearest", "linear"


def _position(q: float) -> Column:
    return (F.col("_total") - 1) * F.lit(float(q))


def _ranks(q: float, interpolation: str) -> tuple[Column, Column]:
    if interpolation == NEAREST:
        rank = F.floor(_position(q) + 0.5)
        return rank, rank
    if interpolation == LINEAR:
        return F.floor(_position(q)), F.ceil(_position(q))
    raise ValueError(f"unknown interpolation {interpolation!r}")


def _cell(x: Column, edges: Column) -> Column:
    """Cell number, non-decreasing in ``x``; the infinities get cells of their own."""
    cell = F.lit(-1)
    pieces = len(SPLITTERS) + 1
    for i in range(pieces):
        lo, hi = edges[i], edges[i + 1]
        inside = F.least(F.floor((x - lo) / F.nullif(hi - lo, F.lit(0.0)) * CELLS), F.lit(CELLS - 1))
        cell = F.when(x >= lo, i * CELLS + F.coalesce(inside, F.lit(0))).otherwise(cell)
    top = pieces * CELLS
    return F.when(F.isnan(x), top + 1).when(x == F.lit(float("inf")), top).otherwise(cell)


def _edges(x: Column) -> Column:
    """Least, splitting and largest finite values, from one mergeable sketch."""
    finite = F.when(is_finite(x), x)
    return F.concat(F.array(F.min(finite)), F.percentile_approx(finite, SPLITTERS, 10_000), F.array(F.max(finite)))


def with_cells(counts: DataFrame, by: Sequence[str], x: str, n: str) -> DataFrame:
    """Add ``_cell``, which rises with ``x`` and splits each group evenly, and ``_total``.

    ``counts`` holds distinct values and how often they occur; it is read twice.
    The splitters are a sketch per group and are stored, so that the join that
    brings them back can be a broadcast by measured size.
    """
    number = F.col(x).cast("double")
    groups = counts.groupBy(*by).agg(F.sum(n).alias("_total"), _edges(number).alias("_edges"))
    cell = F.coalesce(_cell(number, F.col("_edges")), F.lit(0)).alias("_cell")
    return counts.join(materialize(groups, "splitters"), list(by)).select(*counts.columns, "_total", cell)


def _locate(rows: DataFrame, groups: DataFrame, key: Sequence[str], cell: str) -> tuple[DataFrame, DataFrame]:
    """Rows of the cells that hold a wanted rank, and those cells.

    ``groups`` has the edges of each ``key``, its wanted ranks and the rows before it.
    """
    number = F.col("_x").cast("double")
    placed = rows.join(groups.select(*key, "_edges"), list(key))
    placed = placed.select(*rows.columns, F.coalesce(_cell(number, F.col("_edges")), F.lit(0)).alias(cell))
    earlier = Window.partitionBy(*key).orderBy(cell).rowsBetween(Window.unboundedPreceding, -1)
    histogram = placed.groupBy(*key, cell).agg(
        F.count(F.lit(1)).alias("_rows"), (F.min("_x") < F.max("_x")).alias("_mixed")
    )
    found = histogram.withColumn("_within", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)))
    found = found.join(groups.select(*key, "_total", "_ranks", "_before"), list(key))
    found = found.withColumn("_before", F.col("_before") + F.col("_within"))
    here = F.filter("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_rows")))
    found = found.withColumn("_ranks", here).where(F.size("_ranks") > 0).drop("_within")
    cells = materialize(found, "wanted-cells")
    return placed.join(cells.select(*key, cell), [*key, cell], "left_semi"), cells


def exact_quantiles(
    df: DataFrame,
    value: str,
    quantiles: Mapping[str, tuple[float, str]],
    by: Sequence[str] = (SYMBOL,),
) -> DataFrame:
    """One row per group with a column for each ``name: (q, interpolation)``.

    ``df`` is read three times, and once more per refinement: pass a stored table or a
    plain scan. Groups without a value that is not NULL have no row.
    """
    by = list(by)
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).alias("_x"))
    wanted = [r for q, how in quantiles.values() for r in _ranks(q, how)]
    number = F.col("_x").cast("double")
    groups = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_total"), _edges(number).alias("_edges"))
    groups = groups.withColumns({"_ranks": F.array_distinct(F.array(*wanted)), "_before": F.lit(0).cast("bigint")})
    groups = materialize(groups, "splitters")
    key = list(by)
    for depth in range(DEPTHS):
        cell = f"_cell_{depth}"
        rows, cells = _locate(rows, groups, key, cell)
        key.append(cell)
        fullest = cells.where("_mixed").agg(F.max("_rows")).first()[0] or 0
        if fullest <= FULL_CELL:
            break
        cut = rows.groupBy(*key).agg(_edges(number).alias("_edges"))
        groups = materialize(cells.select(*key, "_total", "_ranks", "_before").join(cut, key), "splitters")

    in_cell = Window.partitionBy(*key).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    at_rank = (
        rows.groupBy(*key, "_x")
        .agg(F.count(F.lit(1)).alias("_n"))
        .join(cells.select(*key, "_total", "_ranks", "_before"), key)
        .withColumn("_end", F.col("_before") + F.sum("_n").over(in_cell))
        .withColumn("_rank", F.explode("_ranks"))
        .where((F.col("_rank") < F.col("_end")) & (F.col("_rank") >= F.col("_end") - F.col("_n")))
    )
    picked, out = [], []
    for name, (q, how) in quantiles.items():
        low, high = _ranks(q, how)
        low_x = F.max(F.when(F.col("_rank") == low, F.col("_x")))
        high_x = F.max(F.when(F.col("_rank") == high, F.col("_x")))
        picked.append(low_x.alias(f"_low_{name}"))
        result = F.col(f"_low_{name}")
        if how == LINEAR:
            part = F.max(_position(q) - F.floor(_position(q)))
            picked += [high_x.alias(f"_high_{name}"), part.alias(f"_part_{name}")]
            result = result + (F.col(f"_high_{name}") - result) * F.col(f"_part_{name}")
        out.append(result.alias(name))
    return at_rank.groupBy(*by).agg(*picked).select(*by, *out)
