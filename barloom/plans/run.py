"""Train, predict, backtest and publish one run over all symbols."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.operators import backtest, metrics
from barloom.operators.baselines import (
    baseline_predictions,
    label_from_probabilities,
    signal_from_probabilities,
)
from barloom.operators.backtest import TradingOptions
from barloom.operators.bars import store_bars
from barloom.operators.labels import LabelOptions, SplitOptions
from barloom.operators.series import index_series
from barloom.plans.dataset import LabeledDataset, checked_views, dataset_summary, label_and_split
from barloom.plans.stacking import (
    StackingClassifier,
    TrainingOptions,
    feature_importance,
    long_predictions,
    oof_scores,
)
from barloom.schema import BAR_START, IDX, SERIES_LEN, SYMBOL
from barloom.session import materialize
from barloom.sources import write_csv, write_json

STACKED = "hybrid_stacking"


@dataclass(frozen=True)
class RunOptions:
    """The options of the operators a run is made of."""

    timeframe: str = "1h"
    labels: LabelOptions = field(default_factory=LabelOptions)
    split: SplitOptions = field(default_factory=SplitOptions)
    training: TrainingOptions = field(default_factory=TrainingOptions)
    trading: TradingOptions = field(default_factory=TradingOptions)


@dataclass(frozen=True)
class RunOutputs:
    options: RunOptions
    everything: DataFrame
    data: LabeledDataset
    model: StackingClassifier
    scored: DataFrame
    predictions: DataFrame
    curve: DataFrame
    trades: DataFrame


def fit_model(data: LabeledDataset, options: TrainingOptions) -> tuple[StackingClassifier, DataFrame]:
    train = materialize(data.train, "train")
    return StackingClassifier(options).fit(train), train


def score_test(model: StackingClassifier, data: LabeledDataset) -> DataFrame:
    """Continuous test bars with probabilities and the trading signal.

    The labelled test bars are a subset of these, so they are scored here too.
    """
    bars = data.test_continuous.drop(IDX, SERIES_LEN)
    scored = model.predict_proba(bars).withColumn(
        "raw_signal", signal_from_probabilities("p_sell", "p_buy")
    )
    return materialize(scored, "scored")


def labeled_predictions(data: LabeledDataset, scored: DataFrame) -> DataFrame:
    labels = data.test_labeled.select(SYMBOL, BAR_START, "label")
    return scored.join(labels, [SYMBOL, BAR_START]).withColumn(
        "prediction", label_from_probabilities("p_sell", "p_buy")
    )


def backtest_signals(scored: DataFrame, options: TradingOptions) -> DataFrame:
    """Stored equity curve of the held signals; positions count from the first test bar."""
    bars = index_series(scored.select(SYMBOL, BAR_START, "close", "spread", "raw_signal"))
    curve = backtest.run_signal_backtest(
        bars,
        "raw_signal",
        hold_bars=options.hold_bars,
        initial_balance=options.balance,
        keep=["raw_signal"],
    )
    return materialize(curve, "curve")


def run(ticks: DataFrame, options: RunOptions | None = None) -> RunOutputs:
    """Ticks to a fitted model, its predictions and the backtest of its signals."""
    options = options or RunOptions()
    bars = store_bars(ticks, options.timeframe)
    everything = materialize(label_and_split(bars, options.labels, options.split), "labeled")
    data = checked_views(everything)
    model, _ = fit_model(data, options.training)
    return evaluate(everything, data, model, options)


def evaluate(
    everything: DataFrame, data: LabeledDataset, model: StackingClassifier, options: RunOptions
) -> RunOutputs:
    scored = score_test(model, data)
    curve = backtest_signals(scored, options.trading)
    return RunOutputs(
        options=options,
        everything=everything,
        data=data,
        model=model,
        scored=scored,
        predictions=labeled_predictions(data, scored),
        curve=curve,
        trades=materialize(backtest.extract_trades(curve), "trades"),
    )


def metric_table(out: RunOutputs) -> DataFrame:
    """Naive, base and stacked models in fixed order."""
    naive = ["naive_majority", "naive_random_prior", "naive_momentum_return_4", "naive_buy_only"]
    columns = {name: f"p_{name}" for name in out.model.active} | {STACKED: "p_buy"}
    naive_rows = baseline_predictions(out.data.train, out.data.test_labeled, out.options.training.seed)
    rows = long_predictions(out.predictions, columns).unionByName(
        naive_rows.select("model", "y", "pred", "p_buy")
    )
    table = metrics.metric_rows(materialize(rows, "predictions_long"))
    order = F.array_position(F.array(*[F.lit(n) for n in (*naive, *columns)]), F.col("model"))
    return table.orderBy(order)


def _document(df: DataFrame, name: str) -> DataFrame:
    return df.select(SYMBOL, F.struct(*[c for c in df.columns if c != SYMBOL]).alias(name))


def _entries(df: DataFrame, key: str, name: str) -> DataFrame:
    """Rows of one symbol as a map by ``key``; the number of keys is fixed."""
    value = F.struct(*[c for c in df.columns if c not in (SYMBOL, key)])
    entries = F.collect_list(F.struct(F.col(key).cast("string"), value))
    return df.groupBy(SYMBOL).agg(F.map_from_entries(entries).alias(name))


def _constant_map(pairs: dict[str, float]) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def _constant_struct(values: dict) -> Column:
    return F.struct(
        *[(_constant_struct(v) if isinstance(v, dict) else F.lit(v)).alias(k) for k, v in values.items()]
    )


def run_metadata(out: RunOutputs, run_id: str = "run") -> DataFrame:
    """One nested document per symbol: config, data, training, evaluation, backtest."""
    by = [SYMBOL]
    evaluated = out.predictions.select(
        SYMBOL, F.col("label").alias("y"), F.col("prediction").alias("pred"), "p_buy"
    )
    rounded = lambda df, digits: df.select(
        *[F.bround(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes]
    )
    confusion = metrics.confusion_matrix(evaluated, by).withColumn(
        "cell", F.concat_ws(">", F.col("y").cast("string"), F.col("pred").cast("string"))
    )
    summary = dataset_summary(out.everything)
    parts = [
        _entries(summary, "dataset", "dataset"),
        _document(rounded(metrics.metric_rows(evaluated, by), 6), "evaluation"),
        _entries(metrics.class_report(evaluated, by), "label", "per_class_metrics"),
        _entries(confusion.select(SYMBOL, "cell", "rows"), "cell", "confusion_matrix"),
        _document(rounded(backtest.backtest_metrics(out.curve, out.trades, out.options.trading.balance), 6), "backtest"),
        _document(backtest.turnover(out.curve, out.trades), "win_rate_meta"),
        _document(backtest.trade_summary(out.trades, curve=out.curve), "trade_summary"),
        _document(backtest.exposure(out.curve), "exposure"),
    ]
    document = parts[0]
    for part in parts[1:]:
        document = document.join(part, SYMBOL, "left")
    scores = {r["model"]: r["f1_macro"] for r in oof_scores(out.model.oof, out.model.base_models).collect()}
    importance = {
        r["feature"]: round(r["pct"], 2) for r in feature_importance(out.model, out.everything).collect()
    }
    return document.withColumns(
        {
            "run_id": F.lit(run_id),
            "options": _constant_struct(asdict(out.options)),
            "oof_scores": _constant_map(scores),
            "active_models": F.array(*[F.lit(n) for n in out.model.active]),
            "feature_importance": _constant_map(importance),
        }
    )


def predictions_of(out: RunOutputs) -> DataFrame:
    labeled = out.predictions.select(SYMBOL, BAR_START, "label", "prediction")
    return backtest.predictions_table(out.curve, labeled)


def publish_run(out: RunOutputs, folder: str, run_id: str = "run", parallelism: int = 6) -> None:
    """CSV tables and the JSON document of a run; the independent jobs overlap."""
    balance = out.options.trading.balance
    tables: dict[str, Callable[[], DataFrame]] = {
        "baseline_metrics": lambda: metric_table(out),
        "predictions": lambda: predictions_of(out),
        "trades": lambda: backtest.trades_table(out.trades),
        "backtest_metrics": lambda: backtest.backtest_metrics(out.curve, out.trades, balance),
        "feature_importance": lambda: feature_importance(out.model, out.everything),
    }
    with ThreadPoolExecutor(parallelism) as pool:
        document = pool.submit(lambda: write_json(run_metadata(out, run_id), f"{folder}/run_data"))
        written = [
            pool.submit(lambda n=name, t=table: write_csv(t(), f"{folder}/tables/{n}"))
            for name, table in tables.items()
        ]
        for job in (document, *written):
            job.result()
