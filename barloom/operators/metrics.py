"""Classification metrics as aggregates over ``(y, pred, p_buy)`` rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import BUY, SELL
from barloom.operators.quantiles import with_cells
from barloom.operators.series import prefix_over_chunks
from barloom.session import materialize

CLASSES = {"sell": SELL, "buy": BUY}


def _counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    y, pred = F.col("y"), F.col("pred")
    aggregates = [F.count(F.lit(1)).alias("n"), F.count_if(y == pred).alias("correct")]
    for name, label in CLASSES.items():
        aggregates += [
            F.count_if((y == label) & (pred == label)).alias(f"tp_{name}"),
            F.count_if((y != label) & (pred == label)).alias(f"fp_{name}"),
            F.count_if((y == label) & (pred != label)).alias(f"fn_{name}"),
        ]
    return scored.groupBy(*by).agg(*aggregates)


def _ratio(num: Column, den: Column) -> Column:
    """0 on an empty denominator."""
    return F.coalesce(num / F.nullif(den, F.lit(0)), F.lit(0.0))


def _precision(name: str) -> Column:
    return _ratio(F.col(f"tp_{name}"), F.col(f"tp_{name}") + F.col(f"fp_{name}"))


def _recall(name: str) -> Column:
    return _ratio(F.col(f"tp_{name}"), F.col(f"tp_{name}") + F.col(f"fn_{name}"))


def _seen(name: str) -> Column:
    return 2 * F.col(f"tp_{name}") + F.col(f"fp_{name}") + F.col(f"fn_{name}")


def _f1(name: str) -> Column:
    return _ratio(2 * F.col(f"tp_{name}"), _seen(name))


def _f1_macro() -> Column:
    """Mean over the classes that occur in ``y`` or ``pred``."""
    present = sum(((_seen(c) > 0).cast("int") for c in CLASSES), F.lit(0))
    return _ratio(_f1("sell") + _f1("buy"), present)


def class_metrics(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Accuracy, macro F1 and precision/recall per class, in one aggregate."""
    return _counts(scored, by).select(
        *by,
        _ratio(F.col("correct"), F.col("n")).alias("accuracy"),
        _f1_macro().alias("f1_macro"),
        *[
            fn(c).alias(f"{label}_{c}")
            for c in CLASSES
            for label, fn in (("precision", _precision), ("recall", _recall))
        ],
    )


def class_report(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per class: precision, recall, F1 (6 decimals) and support."""
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            F.bround(_precision(c), 6).alias("precision"),
            F.bround(_recall(c), 6).alias("recall"),
            F.bround(_f1(c), 6).alias("f1"),
            (F.col(f"tp_{c}") + F.col(f"fn_{c}")).alias("support"),
        )
        for c, label in CLASSES.items()
    ]
    return _counts(scored, by).select(*by, F.inline(F.array(*rows)))


def confusion_matrix(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """All label pairs with their counts, zeros included."""
    cell = lambda y, p, n: F.struct(
        F.lit(y).alias("y"), F.lit(p).alias("pred"), F.col(n).alias("rows")
    )
    grid = F.array(
        cell(SELL, SELL, "tp_sell"),
        cell(SELL, BUY, "fn_sell"),
        cell(BUY, SELL, "fn_buy"),
        cell(BUY, BUY, "tp_buy"),
    )
    return _counts(scored, by).select(*by, F.inline(grid))


def roc_auc(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Exact area under the ROC curve, ties counted half; NULL with one class.

    Equal scores are merged first. The running count of negatives goes over
    evenly filled score ranges, so no task orders all scores of a model, even
    where a weak model puts all of them next to 0.5.
    """
    by = list(by)
    scores = scored.groupBy(*by, "p_buy").agg(
        F.count_if(F.col("y") == BUY).alias("pos"),
        F.count_if(F.col("y") != BUY).alias("neg"),
    )
    cells = with_cells(materialize(scores, "scores"), by, "p_buy", "neg")
    ranked = prefix_over_chunks(cells, "_cell", ["p_buy"], "neg", "neg_to", by)
    below = F.col("neg_to") - F.col("neg") + F.col("neg") / 2
    area = F.sum(F.col("pos") * below)
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return ranked.groupBy(*by).agg((area / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"))


def metric_rows(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """``class_metrics`` with ``roc_auc``. ``scored`` is read more than once."""
    return class_metrics(scored, by).join(roc_auc(scored, by), list(by), "left")
