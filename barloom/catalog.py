"""Every operator as a named query over the analytics tables.

Each entry maps ``(spark, sf_dir)`` to a DataFrame over whole tables. ``publish``
prepares results for comparison with another engine: doubles are rounded,
non-finite values become NULL, timestamps lose their zone.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom import config as C
from barloom.functions import drop_null_rows, is_finite, month_key, replace_infinite_with_nan
from barloom.operators import archive, backtest, baselines, folds, indicators, labels, metrics, profile, sketches, state
from barloom.operators.bars import between, build_bars, project_ticks, store_bars
from barloom.operators.quantiles import LINEAR, NEAREST, exact_quantiles
from barloom.operators.series import index_series
from barloom.plans import dataset, run, stacking
from barloom.plans.views import event_ticks, line_ticks, order_ticks, table, vendor_ticks
from barloom.schema import BAR_START, SYMBOL, TIMESTAMP, schema_report
from barloom.session import materialize, workspace
from barloom.sources import (
    latest_months,
    list_months,
    normalize_ticks,
    read_csv,
    read_json,
    read_ledger,
    read_ticks,
    unreadable_months,
    write_csv,
    write_json,
    write_ticks,
)
from barloom.sources.sinks import as_json

Query = Callable[[SparkSession, str], DataFrame]
LEDGER_NOW = datetime(2024, 3, 1)
DEFAULT_DIGITS = 6

RAW: dict[str, Query] = {}
DIGITS: dict[str, int] = {}


def query(name: str, digits: int = DEFAULT_DIGITS) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        RAW[name], DIGITS[name] = fn, digits
        return fn

    return register


def publish(df: DataFrame, digits: int = DEFAULT_DIGITS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.DoubleType):
            c = F.when(is_finite(c), F.round(c, digits) + 0.0)
        elif isinstance(f.dataType, T.TimestampType):
            c = c.cast("timestamp_ntz")
        out.append(c.alias(f.name))
    return df.select(*out)


# --- ticks and bars ----------------------------------------------------------
@query("tick_projection", 8)
def _(spark, sf):
    return project_ticks(event_ticks(spark, sf))


@query("normalize_ticks", 8)
def _(spark, sf):
    return normalize_ticks(vendor_ticks(spark, sf))


def _bars_query(timeframe: str) -> Query:
    return lambda spark, sf: build_bars(event_ticks(spark, sf), timeframe)


for _timeframe in ("1h", "15m", "1d", "1w", "1mo"):
    query(f"bars_{_timeframe}")(_bars_query(_timeframe))


@query("bars_of_tied_ticks")
def _(spark, sf):
    return build_bars(order_ticks(spark, sf), "1d")


@query("latest_months", 4)
def _(spark, sf):
    ticks = order_ticks(spark, sf).withColumn("month", month_key(TIMESTAMP))
    return latest_months(ticks, 6).groupBy("month").agg(
        F.count(F.lit(1)).alias("ticks"), F.avg("ask").alias("avg_ask")
    )


@query("schema_check")
def _(spark, sf):
    return schema_report(event_ticks(spark, sf))


# --- profiles ----------------------------------------------------------------
@query("tick_overview")
def _(spark, sf):
    return profile.tick_overview(event_ticks(spark, sf))


@query("tick_quality")
def _(spark, sf):
    return profile.tick_quality(line_ticks(spark, sf))


SKETCH_CUT = datetime(1996, 1, 1)
SKETCH_QUANTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def _stored_sketches(spark, sf) -> DataFrame:
    """Sketches of the months before a cut, and those of the later months added to them."""
    ticks = line_ticks(spark, sf)
    early = sketches.tick_sketches(between(ticks, None, SKETCH_CUT))
    late = materialize(sketches.tick_sketches(between(ticks, SKETCH_CUT, None)), "late-sketches")
    return materialize(sketches.replace_sketches(materialize(early, "early-sketches"), late), "sketches")


@query("spread_sketches")
def _(spark, sf):
    """Quantiles from merged monthly sketches, and whether their exact ranks keep the bound."""
    merged = sketches.merge_months(_stored_sketches(spark, sf))
    estimates = materialize(sketches.sketch_quantiles(merged, SKETCH_QUANTILES), "sketch-quantiles")
    ranked = sketches.exact_ranks(line_ticks(spark, sf), estimates)
    low, high = F.col("quantile") - sketches.RANK_ERROR, F.col("quantile") + sketches.RANK_ERROR
    within = (F.col("below") <= high) & (F.col("up_to") >= low)
    return ranked.select(SYMBOL, "quantile", "n", within.alias("within_bound"))


@query("distinct_time_sketches")
def _(spark, sf):
    """Exact distinct times next to whether the merged monthly sketches are within their bound."""
    found = sketches.sketch_distinct(sketches.merge_months(_stored_sketches(spark, sf)))
    exact = line_ticks(spark, sf).groupBy(SYMBOL).agg(F.count_distinct(TIMESTAMP).alias("distinct_times"))
    off = F.abs(F.col("distinct") - F.col("distinct_times"))
    within = off <= sketches.COUNT_ERROR * F.col("distinct_times")
    return found.join(exact, SYMBOL).select(SYMBOL, "ticks", "distinct_times", within.alias("within_bound"))


@query("spread_quantiles")
def _(spark, sf):
    return profile.spread_quantiles(event_ticks(spark, sf))


@query("spread_quantiles_lineitem")
def _(spark, sf):
    return profile.spread_quantiles(line_ticks(spark, sf))


@query("gap_summary")
def _(spark, sf):
    return profile.gap_summary(profile.tick_gaps(event_ticks(spark, sf)))


@query("large_gaps_top20")
def _(spark, sf):
    return profile.large_gaps(profile.tick_gaps(event_ticks(spark, sf)), TIMESTAMP)


@query("bar_gaps_top20")
def _(spark, sf):
    return profile.large_gaps(profile.bar_gaps(_hourly(spark, sf)), BAR_START)


@query("duplicate_timestamps")
def _(spark, sf):
    return profile.duplicate_timestamps(line_ticks(spark, sf))


@query("first_ticks")
def _(spark, sf):
    return profile.first_rows(event_ticks(spark, sf), [TIMESTAMP, "seq"])


@query("last_bars")
def _(spark, sf):
    return profile.last_rows(build_bars(event_ticks(spark, sf)), [BAR_START, SYMBOL])


@query("date_range")
def _(spark, sf):
    return profile.date_range(build_bars(order_ticks(spark, sf), "1d"))


@query("bar_summary")
def _(spark, sf):
    return profile.bar_summary(_hourly(spark, sf))


@query("seasonality")
def _(spark, sf):
    return profile.seasonality(_hourly(spark, sf))


@query("seasonality_pivot")
def _(spark, sf):
    return profile.seasonality_pivot(profile.seasonality(_hourly(spark, sf)))


@query("return_histogram")
def _(spark, sf):
    return profile.histogram(profile.with_hourly_return(_hourly(spark, sf)), "return_1h")


@query("spread_histogram")
def _(spark, sf):
    return profile.histogram(build_bars(event_ticks(spark, sf)), "spread")


@query("tick_count_histogram")
def _(spark, sf):
    return profile.histogram(build_bars(event_ticks(spark, sf)), "tick_count")


# --- indicators --------------------------------------------------------------
def _hourly(spark, sf) -> DataFrame:
    return store_bars(event_ticks(spark, sf))


def _indicator_query(groups: tuple[indicators.Group, ...]) -> Query:
    def run(spark, sf):
        outputs = [c for g in groups for c in g.outputs]
        bars = indicators.add_groups(index_series(_hourly(spark, sf)), groups)
        return bars.select(SYMBOL, BAR_START, *outputs)

    return run


for _name, _group in {
    "return_1h": indicators.HOURLY_RETURN,
    "ret_features": indicators.RETURNS,
    "ema_macd": indicators.TREND,
    "rsi": indicators.RSI,
    "adx": indicators.ADX,
    "atr": indicators.ATR,
    "bollinger": indicators.BOLLINGER,
    "volatility": indicators.VOLATILITY,
    "spread_z": indicators.SPREAD_Z,
    "range_position": indicators.RANGE_POSITION,
    "obv": indicators.OBV,
    "candle_structure": indicators.CANDLE,
    "microstructure": indicators.MICROSTRUCTURE,
    "calendar": indicators.CALENDAR,
}.items():
    query(_name)(_indicator_query((_group,)))


@query("all_features")
def _(spark, sf):
    return indicators.combine_market_features(_hourly(spark, sf)).select(SYMBOL, BAR_START, *C.FEATURES)


@query("present_features")
def _(spark, sf):
    groups = (indicators.RSI, indicators.RETURNS, indicators.HOURLY_RETURN)
    return indicators.select_features(indicators.add_groups(index_series(_hourly(spark, sf)), groups))


#: Bars before this time give the state from which the later ones go on.
STATE_CUT = datetime(2024, 1, 20)


@query("features_from_state")
def _(spark, sf):
    """Features of the last days from the state of the days before, in two steps."""
    ticks = event_ticks(spark, sf)
    known = state.series_state(indicators.combine_market_features(store_bars(between(ticks, None, datetime(2024, 1, 15)))))
    middle = state.continue_series(known, store_bars(between(ticks, datetime(2024, 1, 15), STATE_CUT)))
    known = materialize(state.series_state(middle), "series-state")
    last = state.continue_series(known, store_bars(between(ticks, STATE_CUT, None)))
    return last.where(state.IS_NEW).select(SYMBOL, BAR_START, *C.FEATURES)


@query("daily_order_features")
def _(spark, sf):
    bars = materialize(build_bars(order_ticks(spark, sf), "1d"), "bars_1d")
    groups = (indicators.RETURNS, indicators.TREND, indicators.RSI, indicators.BOLLINGER)
    outputs = [c for g in groups for c in g.outputs]
    return indicators.add_groups(index_series(bars), groups).select(SYMBOL, BAR_START, *outputs)


@query("clean_features")
def _(spark, sf):
    featured = indicators.combine_market_features(_hourly(spark, sf))
    return drop_null_rows(replace_infinite_with_nan(featured)).select(SYMBOL, BAR_START, *C.FEATURES)


# --- labels, split, folds ----------------------------------------------------
LABEL_OPTIONS = {"horizon": 4, "threshold": 0.0005, "max_gap_hours": 5.0}


def _everything(spark, sf) -> DataFrame:
    return materialize(dataset.label_and_split(_hourly(spark, sf)), "labeled")


def _labels(spark, sf) -> DataFrame:
    return labels.assign_future_return_labels(_hourly(spark, sf), **LABEL_OPTIONS)


@query("labels_fixed_horizon")
def _(spark, sf):
    return _labels(spark, sf).select(SYMBOL, BAR_START, *labels.LABEL_COLUMNS)


@query("labels_without_gap_limit")
def _(spark, sf):
    labeled = labels.assign_future_return_labels(_hourly(spark, sf), horizon=8, threshold=0.001)
    return labeled.select(SYMBOL, BAR_START, "future_return", "label", "event_start", "event_end")


@query("labeled_features")
def _(spark, sf):
    bars = labels.whole_series_slice(index_series(_hourly(spark, sf)))
    groups = (*indicators.MARKET_GROUPS, labels.label_group(**LABEL_OPTIONS))
    labeled = labels.keep_labeled(indicators.add_groups(bars, groups))
    labeled = drop_null_rows(replace_infinite_with_nan(labeled))
    return labeled.select(SYMBOL, BAR_START, *labels.LABEL_COLUMNS, *C.FEATURES)


@query("label_distribution")
def _(spark, sf):
    return labels.label_distribution(_labels(spark, sf))


@query("label_counts")
def _(spark, sf):
    return labels.label_counts(_labels(spark, sf))


@query("label_quantiles")
def _(spark, sf):
    spots = {
        "min_future_return": (0.0, NEAREST),
        "p01_future_return": (0.01, NEAREST),
        "median_future_return": (0.5, LINEAR),
        "p99_future_return": (0.99, NEAREST),
        "max_future_return": (1.0, NEAREST),
    }
    return exact_quantiles(materialize(_labels(spark, sf), "labels"), "future_return", spots)


@query("chrono_split")
def _(spark, sf):
    parts = labels.chronological_split(index_series(_hourly(spark, sf)))
    return parts.select(SYMBOL, BAR_START, "idx", "part", labels.SLICE_START, labels.SLICE_END)


@query("split_info")
def _(spark, sf):
    return labels.split_info(labels.chronological_split(index_series(_hourly(spark, sf))))


@query("dataset_summary")
def _(spark, sf):
    return dataset.dataset_summary(dataset.label_and_split(_hourly(spark, sf)))


@query("split_distributions")
def _(spark, sf):
    return dataset.split_distributions(dataset.split_views(_everything(spark, sf)))


def _folds(spark, sf) -> DataFrame:
    train = dataset.split_views(_everything(spark, sf)).train
    numbered = materialize(folds.number_rows(materialize(train, "train")), "numbered")
    return folds.purged_folds(numbered)


MANY_BLOCKS = 50


@query("purged_rows_of_many_blocks")
def _(spark, sf):
    """Which rows are kept from training for the sake of each of many test blocks."""
    train = dataset.split_views(_everything(spark, sf)).train
    numbered = materialize(folds.number_rows(materialize(train, "train")), "numbered")
    return folds.purged_rows(numbered, MANY_BLOCKS)


@query("purged_folds")
def _(spark, sf):
    return _folds(spark, sf).select(SYMBOL, "fold", "role", "row", BAR_START, "event_start", "event_end")


@query("fold_sizes")
def _(spark, sf):
    return _folds(spark, sf).groupBy(SYMBOL, "fold", "role").agg(
        F.count(F.lit(1)).alias("rows"), F.min("row").alias("first_row"), F.max("row").alias("last_row")
    )


# --- baselines and metrics ---------------------------------------------------
def _scored(spark, sf) -> DataFrame:
    data = dataset.split_views(_everything(spark, sf))
    return baselines.baseline_predictions(data.train, data.test_labeled)


@query("class_priors")
def _(spark, sf):
    return baselines.class_priors(dataset.split_views(_everything(spark, sf)).train)


@query("baseline_predictions")
def _(spark, sf):
    return _scored(spark, sf)


@query("class_metrics")
def _(spark, sf):
    return metrics.class_metrics(_scored(spark, sf), ["model", SYMBOL])


@query("class_report")
def _(spark, sf):
    return metrics.class_report(_scored(spark, sf))


@query("confusion_matrix")
def _(spark, sf):
    return metrics.confusion_matrix(_scored(spark, sf))


@query("roc_auc")
def _(spark, sf):
    return metrics.roc_auc(_feature_scores(spark, sf))


def _feature_scores(spark, sf) -> DataFrame:
    """Indicators in [0, 1] read as buy scores: many distinct values, some ties."""
    test = dataset.split_views(_everything(spark, sf)).test_labeled
    scores = F.array(
        F.struct(F.lit("rsi").alias("model"), (F.col("rsi_14") / 100).alias("p_buy")),
        F.struct(F.lit("range").alias("model"), F.col("close_in_range_24").alias("p_buy")),
        F.struct(F.lit("hour").alias("model"), (F.hour(BAR_START) / 24).alias("p_buy")),
    )
    return test.select(F.col("label").alias("y"), F.inline(scores))


@query("baseline_metrics")
def _(spark, sf):
    return metrics.metric_rows(materialize(_scored(spark, sf), "scored_baselines"))


# --- backtest ----------------------------------------------------------------
def _signals(spark, sf) -> DataFrame:
    """Momentum signals; every series decides without a model."""
    return indicators.add_return_features(_hourly(spark, sf)).withColumn(
        "signal", baselines.momentum_signal()
    )


def _curve(spark, sf) -> DataFrame:
    return backtest.run_signal_backtest(_signals(spark, sf), hold_bars=4, keep=["signal"])


def _stored_curve(spark, sf) -> DataFrame:
    return materialize(_curve(spark, sf), "curve")


@query("held_positions")
def _(spark, sf):
    return backtest.bar_returns(_signals(spark, sf), hold_bars=4, keep=["signal"]).select(
        SYMBOL, BAR_START, "signal", "position", "prev_position"
    )


@query("strategy_returns")
def _(spark, sf):
    return backtest.bar_returns(_signals(spark, sf), hold_bars=4).select(SYMBOL, BAR_START, "strategy_return")


@query("equity_curve", 4)
def _(spark, sf):
    return _curve(spark, sf).select(SYMBOL, BAR_START, "equity", "peak", "bar_pnl")


@query("drawdown")
def _(spark, sf):
    return backtest.max_drawdown(_curve(spark, sf))


@query("sharpe")
def _(spark, sf):
    return backtest.sharpe_ratio(_curve(spark, sf))


@query("trades")
def _(spark, sf):
    return backtest.extract_trades(_stored_curve(spark, sf))


@query("trades_table")
def _(spark, sf):
    return backtest.trades_table(backtest.extract_trades(_stored_curve(spark, sf)))


@query("trade_ratios")
def _(spark, sf):
    return backtest.trade_ratios(backtest.extract_trades(_stored_curve(spark, sf)))


@query("trade_summary", 4)
def _(spark, sf):
    return backtest.trade_summary(backtest.extract_trades(_stored_curve(spark, sf)))


@query("exposure")
def _(spark, sf):
    return backtest.exposure(_curve(spark, sf))


@query("turnover")
def _(spark, sf):
    curve = _stored_curve(spark, sf)
    return backtest.turnover(curve, backtest.extract_trades(curve))


@query("backtest_metrics")
def _(spark, sf):
    curve = _stored_curve(spark, sf)
    return backtest.backtest_metrics(curve, backtest.extract_trades(curve))


@query("buy_hold_curve", 4)
def _(spark, sf):
    return backtest.buy_hold_curve(_stored_curve(spark, sf))


@query("predictions_table")
def _(spark, sf):
    curve = _stored_curve(spark, sf)
    labeled = labels.assign_future_return_labels(curve.drop("block"), **LABEL_OPTIONS)
    predicted = labeled.select(SYMBOL, BAR_START, "label", F.col("signal").alias("prediction"))
    return backtest.predictions_table(curve, predicted, "signal")


# --- archive -----------------------------------------------------------------
def _without_two_hours(ticks: DataFrame) -> DataFrame:
    """An archive with holes: the 03:00 and 07:00 hours are absent."""
    return ticks.where(~F.hour(TIMESTAMP).isin(3, 7))


def _patches(ticks: DataFrame) -> DataFrame:
    """A second source for all hours: other prices, and no bid volume."""
    return ticks.withColumn("ask", F.col("ask") + 1).drop("bid_volume")


@query("trading_calendar")
def _(spark, sf):
    months = archive.covered_months(archive.covered_slots(event_ticks(spark, sf)))
    return archive.trading_calendar(months)


@query("crypto_calendar")
def _(spark, sf):
    months = archive.covered_months(archive.covered_slots(order_ticks(spark, sf)))
    slots = archive.trading_calendar(months, "crypto")
    return slots.groupBy(SYMBOL, month_key("slot").alias("month")).agg(F.count(F.lit(1)).alias("slots"))


@query("covered_hours")
def _(spark, sf):
    return archive.covered_slots(event_ticks(spark, sf))


@query("missing_hours")
def _(spark, sf):
    return archive.missing_hours(event_ticks(spark, sf))


def _ledger(spark, sf) -> DataFrame:
    return archive.month_ledger(event_ticks(spark, sf), LEDGER_NOW)


@query("month_ledger")
def _(spark, sf):
    return _ledger(spark, sf)


@query("order_month_ledger")
def _(spark, sf):
    return archive.month_ledger(order_ticks(spark, sf), LEDGER_NOW, "crypto")


@query("ledger_upsert")
def _(spark, sf):
    holes = _without_two_hours(event_ticks(spark, sf)).unionByName(order_ticks(spark, sf))
    return archive.upsert_ledger(archive.month_ledger(holes, LEDGER_NOW), _ledger(spark, sf))


@query("pending_months")
def _(spark, sf):
    ledger = archive.month_ledger(event_ticks(spark, sf), LEDGER_NOW)
    return archive.pending_months(ledger.select(SYMBOL, "month"), ledger)


@query("archive_totals")
def _(spark, sf):
    return archive.archive_totals(_ledger(spark, sf))


@query("dedup_keep_first")
def _(spark, sf):
    ticks = order_ticks(spark, sf).withColumn("source", F.lit(0))
    return archive.dedup_keep_first(ticks, "source").drop("source")


@query("patch_merge")
def _(spark, sf):
    ticks = event_ticks(spark, sf)
    return archive.patch_merge(_without_two_hours(ticks), _patches(ticks))


def _repaired(spark, sf) -> DataFrame:
    ticks = event_ticks(spark, sf)
    return archive.repair_missing_hours(_without_two_hours(ticks), _patches(ticks))


@query("repair_missing_hours")
def _(spark, sf):
    return _repaired(spark, sf)


@query("repair_report")
def _(spark, sf):
    repaired = materialize(_repaired(spark, sf), "repaired")
    return archive.repair_report(_without_two_hours(event_ticks(spark, sf)), repaired)


# Four months of which January has ticks, February no more than a patch, and April is not over.
LISTED_MONTHS = ((2023, 12), (2024, 4))


@query("month_enumeration")
def _(spark, sf):
    """Months of the archive's symbols up to ``LEDGER_NOW``, without the current one."""
    months = archive.enumerate_months(spark, *LISTED_MONTHS, LEDGER_NOW, skip_current=True)
    pairs = archive.symbol_months(event_ticks(spark, sf), months)
    return pairs.select(SYMBOL, month_key("month_start").alias("month"), "month_start")


def _listed(spark, sf) -> DataFrame:
    months = archive.enumerate_months(spark, *LISTED_MONTHS, LEDGER_NOW, skip_current=True)
    return archive.symbol_months(event_ticks(spark, sf), months)


@query("absent_month_ledger")
def _(spark, sf):
    return archive.month_ledger(event_ticks(spark, sf), LEDGER_NOW, months=_listed(spark, sf))


@query("absent_month_totals")
def _(spark, sf):
    ledger = archive.month_ledger(event_ticks(spark, sf), LEDGER_NOW, months=_listed(spark, sf))
    return archive.archive_totals(ledger)


@query("repair_absent_month")
def _(spark, sf):
    """January is whole but for two hours a day; a patch has those and all of February."""
    ticks = event_ticks(spark, sf)
    shifted = _patches(ticks).withColumn(TIMESTAMP, F.col(TIMESTAMP) + F.expr("interval 31 days"))
    base, patches = _without_two_hours(ticks), _patches(ticks).unionByName(shifted)
    ledger = archive.month_ledger(base, LEDGER_NOW)
    return archive.repair_months(base, patches, _listed(spark, sf), ledger)


@query("repair_tied_ticks")
def _(spark, sf):
    """Three months in which one of three symbols gets patches; the others keep all ticks of equal time."""
    ticks = order_ticks(spark, sf)
    months = archive.symbol_months(ticks, archive.enumerate_months(spark, (1995, 1), (1995, 3), LEDGER_NOW))
    quarter = between(ticks.where("symbol = 'F'"), datetime(1995, 1, 1), datetime(1995, 4, 1))
    later = F.col(TIMESTAMP) + F.expr("interval 5 hours")
    patches = quarter.withColumns({TIMESTAMP: later, "ask": F.col("ask") + 1})
    ledger = archive.month_ledger(ticks, LEDGER_NOW, months=months)
    return archive.repair_months(ticks, patches, months, ledger)


# --- archives and text formats, written and read back -------------------------
BROKEN_MONTH = "1995-03"


def _folder(spark, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"


@query("archive_round_trip", 8)
def _(spark, sf):
    """The latest six months of an archive in month folders; other folders are not opened."""
    folder = _folder(spark, "archive")
    write_ticks(order_ticks(spark, sf), folder)
    return read_ticks(spark, folder, months=6)


def _archive_with_broken_month(spark, sf) -> str:
    """An archive in which one month's folder holds a text file instead of parquet."""
    folder = _folder(spark, "archive")
    write_ticks(order_ticks(spark, sf), folder)
    month = order_ticks(spark, sf).where(month_key(TIMESTAMP) == BROKEN_MONTH)
    lines = month.select(F.concat_ws(" ", SYMBOL, F.col("seq").cast("string")).alias("value"))
    lines.coalesce(1).write.mode("overwrite").text(f"{folder}/month={BROKEN_MONTH}")
    return folder


@query("unreadable_months")
def _(spark, sf):
    return unreadable_months(spark, _archive_with_broken_month(spark, sf))


@query("unreadable_month_ledger")
def _(spark, sf):
    """The ledger of all listed months, in which the unreadable one has no rows and misses all hours."""
    folder = _archive_with_broken_month(spark, sf)
    names = [n.removeprefix("month=") for n in list_months(spark, folder)]
    listed = spark.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("month"))
    ticks = read_ticks(spark, folder, skip_corrupt=True)
    pairs = archive.symbol_months(ticks, listed.select(F.to_timestamp("month", "yyyy-MM").alias("month_start")))
    return archive.month_ledger(ticks, LEDGER_NOW, "crypto", months=pairs)


@query("csv_round_trip", 8)
def _(spark, sf):
    """NULL, empty, quoted and blank texts, NaN, infinities and times through CSV."""
    n, value = F.col("event_id"), F.col("value")
    note = F.when(n % 5 == 0, F.lit(None)).when(n % 5 == 1, "").when(n % 5 == 2, F.col("props")).when(n % 5 == 3, ' , "a"" ')
    number = F.when(n % 6 == 0, F.lit(None))
    for rest, special in ((1, "nan"), (2, "inf"), (3, "-inf")):
        number = number.when(n % 6 == rest, F.lit(float(special)))
    rows = table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), note.otherwise(F.col("event_type")).alias("note"), number.otherwise(value).alias("number")
    )
    folder = _folder(spark, "csv")
    write_csv(rows, folder)
    x = F.col("number")
    kind = F.when(x.isNull(), "null").when(F.isnan(x), "nan").when(is_finite(x), "finite").when(x > 0, "inf").otherwise("-inf")
    return read_csv(spark, folder, rows.schema).withColumn("kind", kind)


@query("ledger_json_read")
def _(spark, sf):
    """A ledger in which odd months are cut off, and entries of October do not name their month."""
    ledger = archive.month_ledger(order_ticks(spark, sf), LEDGER_NOW, "crypto")
    number = F.substring("month", 6, 2).cast("int")
    entry = as_json(ledger.withColumn("cut", number % 2 == 1).withColumn("month", F.when(number != 10, F.col("month"))))
    line = F.when(F.get_json_object("document", "$.cut") == "true", F.expr("substring(document, 1, length(document) - 9)"))
    folder = _folder(spark, "ledger")
    entry.select(line.otherwise(F.col("document")).alias("value")).write.text(folder)
    return read_ledger(spark, folder)


@query("json_round_trip")
def _(spark, sf):
    """One nested document per symbol, its months in a map of records, written and taken apart again."""
    ledger = archive.month_ledger(order_ticks(spark, sf), LEDGER_NOW, "crypto")
    record = F.struct("rows", F.when(F.col("rows") > 100, F.col("missing_hours")).alias("missing_hours"))
    entries = F.collect_list(F.struct("month", record.alias("record")))
    documents = ledger.groupBy(SYMBOL).agg(F.map_from_entries(entries).alias("months"))
    folder = _folder(spark, "json")
    write_json(documents, folder)
    schema = "symbol string, months map<string, struct<rows: bigint, missing_hours: bigint>>"
    found = read_json(spark, folder, schema).select(SYMBOL, F.explode("months").alias("month", "record"), "_corrupt")
    return found.select(SYMBOL, "month", "record.rows", "record.missing_hours", F.col("_corrupt").isNotNull().alias("broken"))


# --- stacked model -----------------------------------------------------------
_RUNS: dict[tuple[str, str], run.RunOutputs] = {}


def _run(spark, sf) -> run.RunOutputs:
    """One fitted run per work folder and data folder: several queries report on it.

    The key goes with the stored tables, so a run is fitted anew when they are dropped.
    """
    key = (workspace(spark), sf)
    if key not in _RUNS:
        _RUNS[key] = run.run(event_ticks(spark, sf))
    return _RUNS[key]


@query("stacking_oof")
def _(spark, sf):
    model = _run(spark, sf).model
    return model.oof.select(SYMBOL, BAR_START, "fold", "row", "label", *model.probability_columns)


@query("oof_rows")
def _(spark, sf):
    """Which rows each fold tests; the fitted scores themselves depend on the solver."""
    return _folds(spark, sf).where("role = 'test'").select(SYMBOL, BAR_START, "fold", "row", "label")


@query("class_weights")
def _(spark, sf):
    return stacking.class_weights(dataset.split_views(_everything(spark, sf)).train)


@query("feature_medians")
def _(spark, sf):
    train = materialize(dataset.split_views(_everything(spark, sf)).train, "train")
    return stacking.feature_medians(train)


@query("signal_rules")
def _(spark, sf):
    """Both tie rules on probabilities in eighths, which meet a tie exactly."""
    p = (F.col("event_id") % 9) / 8
    return table(spark, sf, "events").select(
        "event_id",
        baselines.signal_from_probabilities(1 - p, p).alias("signal"),
        baselines.label_from_probabilities(1 - p, p).alias("prediction"),
    )


@query("oof_scores")
def _(spark, sf):
    model = _run(spark, sf).model
    return stacking.oof_scores(model.oof, model.base_models)


@query("stacking_predictions")
def _(spark, sf):
    return _run(spark, sf).predictions.select(
        SYMBOL, BAR_START, "label", "prediction", "raw_signal", "p_sell", "p_buy"
    )


@query("model_metrics")
def _(spark, sf):
    return run.metric_table(_run(spark, sf))


@query("feature_importance")
def _(spark, sf):
    outputs = _run(spark, sf)
    return stacking.feature_importance(outputs.model, outputs.everything)


@query("stacking_backtest")
def _(spark, sf):
    outputs = _run(spark, sf)
    return backtest.backtest_metrics(outputs.curve, outputs.trades)


@query("stacking_predictions_table")
def _(spark, sf):
    return run.predictions_of(_run(spark, sf))


@query("run_metadata")
def _(spark, sf):
    return as_json(run.run_metadata(_run(spark, sf)))
