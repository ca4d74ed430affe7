"""Bars to a labelled, split dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.config import FEATURES
from barloom.functions import drop_null_rows, replace_infinite_with_nan
from barloom.operators.indicators import MARKET_GROUPS, add_groups
from barloom.operators.labels import (
    LABEL_COLUMNS,
    LabelOptions,
    SLICE_END,
    SLICE_START,
    SplitOptions,
    TEST,
    TRAIN,
    chronological_split,
    label_distribution,
    label_group,
)
from barloom.operators.series import BLOCK_ROWS, index_series
from barloom.schema import BAR_START, IDX, SYMBOL

HELPERS = ("part", SLICE_START, SLICE_END, "label_is_valid")


@dataclass(frozen=True)
class LabeledDataset:
    """Views over one stored table of featured, labelled bars."""

    featured: DataFrame
    train: DataFrame
    test_labeled: DataFrame
    test_continuous: DataFrame


def label_and_split(
    bars: DataFrame,
    labels: LabelOptions | None = None,
    split: SplitOptions | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Features, split part and labels of all bars in one blocked pass."""
    indexed = bars if IDX in bars.columns else index_series(bars)
    labels, split = labels or LabelOptions(), split or SplitOptions()
    parts = chronological_split(indexed, split.test_size, split.purge_bars)
    group = label_group(labels.horizon, labels.threshold, labels.max_gap_hours)
    return add_groups(parts, (*MARKET_GROUPS, group), block_rows)


def _labeled(everything: DataFrame, part: str) -> DataFrame:
    rows = everything.where((F.col("part") == part) & F.col("label_is_valid")).drop(*HELPERS)
    return drop_null_rows(replace_infinite_with_nan(rows))


def split_views(everything: DataFrame) -> LabeledDataset:
    """The four frames of a run, as filters over the stored table."""
    plain = [c for c in everything.columns if c not in (*HELPERS, *LABEL_COLUMNS)]
    continuous = everything.where(F.col("part") == TEST).select(*plain)
    return LabeledDataset(
        featured=everything.select(*plain),
        train=_labeled(everything, TRAIN),
        test_labeled=_labeled(everything, TEST),
        test_continuous=drop_null_rows(replace_infinite_with_nan(continuous)),
    )


def checked_views(everything: DataFrame) -> LabeledDataset:
    """``split_views`` of a stored table; frames that leave nothing to train or test on are errors."""
    data = split_views(everything)
    for rows, what in ((data.train, "train on"), (data.test_labeled, "test on")):
        if rows.isEmpty():
            raise ValueError(f"no labelled bar is left to {what}: give more ticks or a shorter horizon")
    if data.test_continuous.isEmpty():
        raise ValueError("no test bar has all features: give more ticks")
    return data


def dataset_summary(everything: DataFrame) -> DataFrame:
    """Rows, labels and date range per symbol and frame, from one aggregate pass."""
    clean = [F.col(c).isNotNull() for c in everything.columns if c not in (*HELPERS, *LABEL_COLUMNS)]
    complete = F.lit(True)
    for c in clean:
        complete = complete & c
    labeled = complete & F.col("label_is_valid")
    names = F.array_compact(
        F.array(
            F.lit("featured"),
            F.when((F.col("part") == TRAIN) & labeled, "train"),
            F.when((F.col("part") == TEST) & labeled, "test_labeled"),
            F.when((F.col("part") == TEST) & complete, "test_continuous"),
            F.when(F.col("part").isin(TRAIN, TEST) & labeled, "labeled_total"),
        )
    )
    rows = everything.select(
        SYMBOL, BAR_START, F.explode(names).alias("dataset"), F.when(labeled, F.col("label")).alias("label")
    )
    return (
        rows.groupBy(SYMBOL, "dataset")
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.min(BAR_START).alias("start"),
            F.max(BAR_START).alias("end"),
            F.count_if(F.col("label") == 1).alias("buy"),
            F.count_if(F.col("label") == -1).alias("sell"),
        )
        .withColumn("feature_count", F.lit(len(FEATURES)))
    )


def split_distributions(data: LabeledDataset) -> DataFrame:
    """Label distribution of train and test side by side."""
    train = label_distribution(data.train).withColumn("part", F.lit(TRAIN))
    test = label_distribution(data.test_labeled).withColumn("part", F.lit(TEST))
    return train.unionByName(test)
