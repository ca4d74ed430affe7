"""Purged walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.overlap import overlap_join
from barloom.operators.series import index_series
from barloom.schema import BAR_START, SYMBOL
from barloom.session import materialize

ROW, ROWS = "row", "n_rows"


def number_rows(labeled: DataFrame) -> DataFrame:
    """Position among the labelled rows of the symbol; event columns keep bar positions."""
    return index_series(labeled, (BAR_START,), idx=ROW, length=ROWS)


def _test_blocks(numbered: DataFrame, n_splits: int) -> DataFrame:
    """(symbol, fold, first and last test row, event span of the test block): a row per block."""
    size = F.greatest(F.floor(F.col(ROWS) / (n_splits + 1)), F.lit(1))
    step = F.floor(F.col(ROW) / size)
    test = numbered.where(step >= 1).withColumn("fold", F.least(step - 1, F.lit(n_splits - 1)).cast("int"))
    return test.groupBy(SYMBOL, "fold").agg(
        F.min(ROW).alias("_first"),
        F.max(ROW).alias("_last"),
        F.min_by("event_start", ROW).alias("_test_from"),
        F.max_by("event_end", ROW).alias("_test_to"),
    )


def fold_bounds(numbered: DataFrame, n_splits: int = 5) -> DataFrame:
    """(symbol, fold, first and last test row, time span of the test block): a row per fold.

    Folds without a row to train on are left out.
    """
    edges = _test_blocks(numbered, n_splits)
    trained = fold_rows(numbered, edges, "train").select(SYMBOL, "fold").distinct()
    return edges.join(trained, [SYMBOL, "fold"], "left_semi")


def fold_rows(numbered: DataFrame, bounds: DataFrame, role: str) -> DataFrame:
    """The rows that the folds of ``bounds`` test or train on, as filters against its few rows."""
    joined = numbered.join(bounds, SYMBOL)
    if role == "test":
        chosen = joined.where(F.col(ROW).between(F.col("_first"), F.col("_last")))
    else:
        overlap = (F.col("event_start") <= F.col("_test_to")) & (F.col("event_end") >= F.col("_test_from"))
        chosen = joined.where((F.col(ROW) < F.col("_first")) & ~overlap)
    return chosen.drop("_first", "_last", "_test_from", "_test_to")


def purged_folds(numbered: DataFrame, n_splits: int = 5) -> DataFrame:
    """Long frame of ``numbered`` rows with ``fold`` and ``role`` (train or test).

    With size = max(1, n // (n_splits + 1)), fold i tests rows
    [(i+1)*size, (i+2)*size) and the last fold runs to the end. It trains on all
    earlier rows except those whose events overlap the test block. A fold
    without train rows is left out. ``numbered`` is read several times, so pass a stored table.
    """
    bounds = materialize(fold_bounds(numbered, n_splits), "fold-bounds")
    train, test = (
        fold_rows(numbered, bounds, role).withColumn("role", F.lit(role)) for role in ("train", "test")
    )
    return train.unionByName(test)


def purged_rows(numbered: DataFrame, n_splits: int) -> DataFrame:
    """(symbol, row, fold) of every row before a test block whose event reaches into the block.

    The blocks are those of ``purged_folds``, with those that it leaves out for want of train rows. Events meet blocks by an
    interval join, so the work follows the events and not their number times that of the blocks.
    """
    events = numbered.select(SYMBOL, ROW, "event_start", "event_end")
    blocks = _test_blocks(numbered, n_splits).drop("_last")
    met = overlap_join(events, blocks, [SYMBOL], ("event_start", "event_end"), ("_test_from", "_test_to"))
    return met.where(F.col(ROW) < F.col("_first")).select(SYMBOL, ROW, "fold")
