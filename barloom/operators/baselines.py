"""Naive Buy/Sell predictors and prediction rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.config import BUY, SELL
from barloom.schema import BAR_START, SYMBOL


def signal_from_probabilities(p_sell: Column | str, p_buy: Column | str) -> Column:
    """Trading signal: a tie buys."""
    p_sell, p_buy = (F.col(p) if isinstance(p, str) else p for p in (p_sell, p_buy))
    return F.when(p_buy >= p_sell, BUY).otherwise(SELL)


def label_from_probabilities(p_sell: Column | str, p_buy: Column | str) -> Column:
    """Predicted class: the first maximum wins, so a tie sells."""
    p_sell, p_buy = (F.col(p) if isinstance(p, str) else p for p in (p_sell, p_buy))
    return F.when(p_buy > p_sell, BUY).otherwise(SELL)


def momentum_signal(ret: Column | str = "return_4") -> Column:
    """Buy when the return is at least zero; NULL and NaN sell."""
    ret = F.col(ret) if isinstance(ret, str) else ret
    return F.when(~F.isnan(ret) & (ret >= 0), BUY).otherwise(SELL)


def hash_uniform(seed: int, *keys: Column) -> Column:
    """Number in [0, 1) from the row's key: the same on any partitioning and retry."""
    text = F.concat_ws(":", F.lit(str(seed)), *keys)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 2**32


def class_priors(train: DataFrame, by: Sequence[str] = (SYMBOL,)) -> DataFrame:
    sell, buy = (F.count_if(F.col("label") == v) for v in (SELL, BUY))
    counts = train.groupBy(*by).agg(sell.alias("n_sell"), buy.alias("n_buy"))
    total = F.col("n_sell") + F.col("n_buy")
    return counts.select(
        *by,
        "n_sell",
        "n_buy",
        F.when(total > 0, F.col("n_sell") / F.nullif(total, F.lit(0))).otherwise(0.5).alias("prior_sell"),
    )


def baseline_predictions(
    train: DataFrame, test: DataFrame, seed: int = 42, by: Sequence[str] = (SYMBOL,)
) -> DataFrame:
    """Long frame ``(model, keys, y, pred, p_sell, p_buy)`` of the four naive models.

    ``test`` needs ``label`` and ``return_4``. Groups without train labels use
    even priors. The four rows per bar come from one array, not four scans.
    """
    if "return_4" not in test.columns:
        raise KeyError("baseline_predictions requires a return_4 feature")
    rows = test.join(class_priors(train, by), list(by), "left")
    prior_sell = F.coalesce("prior_sell", F.lit(0.5))
    majority = F.when(F.coalesce("n_buy", F.lit(0)) > F.coalesce("n_sell", F.lit(0)), BUY).otherwise(SELL)
    draw = hash_uniform(seed, F.col(SYMBOL), F.unix_micros(BAR_START).cast("string"))
    random_pred = F.when(draw < prior_sell, SELL).otherwise(BUY)
    momentum = momentum_signal()

    def row(model: str, pred: Column, p_sell: Column) -> Column:
        return F.struct(F.lit(model).alias("model"), pred.alias("pred"), p_sell.alias("p_sell"))

    def one_hot(pred: Column) -> Column:
        return (pred == SELL).cast("double")

    models = F.array(
        row("naive_majority", majority, prior_sell),
        row("naive_random_prior", random_pred, prior_sell),
        row("naive_momentum_return_4", momentum, one_hot(momentum)),
        row("naive_buy_only", F.lit(BUY), F.lit(0.0)),
    )
    m = F.col("_m")
    return rows.withColumn("_m", F.explode(models)).select(
        m["model"].alias("model"),
        SYMBOL,
        BAR_START,
        F.col("label").alias("y"),
        m["pred"].alias("pred"),
        m["p_sell"].alias("p_sell"),
        (1 - m["p_sell"]).alias("p_buy"),
    )
