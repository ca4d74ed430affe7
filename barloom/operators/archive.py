"""Completeness and repair of a tick archive."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from barloom.functions import month_key, utc_literal
from barloom.schema import SYMBOL, TIMESTAMP
from barloom.session import materialize

SLOT = "slot"
MONTH = "month"


def _hour(ts: str) -> Column:
    return F.date_trunc("hour", ts)


def is_trading_hour(slot: Column, asset_class: str = "fx") -> Column:
    """Forex trades Monday to Friday and from 21:00 on Sunday; crypto always."""
    if asset_class == "crypto":
        return F.lit(True)
    day = F.weekday(slot)
    return (day < 5) | ((day == 6) & (F.hour(slot) >= 21))


def trading_calendar(months: DataFrame, asset_class: str = "fx") -> DataFrame:
    """Expected hour slots of ``(symbol, month_start)`` rows."""
    last = F.col("month_start") + F.expr("interval 1 month") - F.expr("interval 1 hour")
    hours = F.explode(F.sequence("month_start", last, F.expr("interval 1 hour")))
    return months.select(SYMBOL, hours.alias(SLOT)).where(is_trading_hour(F.col(SLOT), asset_class))


def slot_counts(ticks: DataFrame) -> DataFrame:
    """Ticks per covered hour: the one aggregate over ticks that all checks share."""
    return ticks.groupBy(SYMBOL, _hour(TIMESTAMP).alias(SLOT)).agg(F.count(F.lit(1)).alias("ticks"))


def covered_slots(ticks: DataFrame) -> DataFrame:
    return slot_counts(ticks).select(SYMBOL, SLOT)


def covered_months(slots: DataFrame) -> DataFrame:
    return slots.select(SYMBOL, F.date_trunc("month", SLOT).alias("month_start")).distinct()


def missing_hours(
    ticks: DataFrame, asset_class: str = "fx", months: DataFrame | None = None
) -> DataFrame:
    """Expected slots without a tick, for ``months`` or every month that has ticks.

    A month without any tick can only be missed if ``months`` (symbol, month_start) names it.
    """
    covered = covered_slots(ticks)
    months = covered_months(covered) if months is None else months
    return trading_calendar(months, asset_class).join(covered, [SYMBOL, SLOT], "left_anti")


def enumerate_months(
    spark: SparkSession,
    start: tuple[int, int],
    end: tuple[int, int],
    now: datetime,
    skip_current: bool = False,
) -> DataFrame:
    """Months from ``start`` to ``end`` as ``month_start``; future months are left out."""
    first, last = (F.make_date(F.lit(y), F.lit(m), F.lit(1)).cast("timestamp") for y, m in (start, end))
    months = spark.range(1).select(
        F.explode(F.sequence(first, last, F.expr("interval 1 month"))).alias("month_start")
    )
    current = F.date_trunc("month", utc_literal(now))
    months = months.where(F.col("month_start") <= utc_literal(now))
    return months.where(F.col("month_start") != current) if skip_current else months


def symbol_months(symbols: DataFrame, months: DataFrame) -> DataFrame:
    """(symbol, month_start) of every symbol and every listed month; ``months`` is a short list."""
    listed = [r["month_start"] for r in months.orderBy("month_start").collect()]
    each = F.explode(F.array(*[F.lit(m) for m in listed]).cast("array<timestamp>"))
    return symbols.select(SYMBOL).distinct().select(SYMBOL, each.alias("month_start"))


def month_ledger(
    ticks: DataFrame,
    now: datetime,
    asset_class: str = "fx",
    verify: bool = True,
    months: DataFrame | None = None,
) -> DataFrame:
    """Rows and missing hours per closed month of ``months``, or of every month that has ticks.

    Listed months without a tick have 0 rows and miss all their hours. A slot still missing when the archive has been checked against its source
    is confirmed absent. Without ``verify`` nothing was checked and both are 0.
    """
    slots = materialize(slot_counts(ticks), "slots")
    month_start = F.date_trunc("month", SLOT).alias("month_start")
    rows = slots.groupBy(SYMBOL, month_start).agg(F.sum("ticks").alias("rows"))
    if months is None:
        months = covered_months(slots)
    else:
        months = months.select(SYMBOL, "month_start").distinct()
        rows = months.join(rows, [SYMBOL, "month_start"], "left").fillna(0, ["rows"])
    expected = trading_calendar(months, asset_class)
    missing = (
        expected.join(slots, [SYMBOL, SLOT], "left")
        .groupBy(SYMBOL, month_start)
        .agg(F.count_if(F.col("ticks").isNull()).alias("missing_hours"))
    )
    gone = F.coalesce("missing_hours", F.lit(0)) if verify else F.lit(0)
    closed = F.col("month_start") + F.expr("interval 1 month") < utc_literal(now)
    return (
        rows.join(missing, [SYMBOL, "month_start"], "left")
        .where(closed)
        .select(
            SYMBOL,
            month_key("month_start").alias(MONTH),
            "rows",
            gone.cast("bigint").alias("missing_hours"),
            gone.cast("bigint").alias("confirmed_absent"),
        )
    )


def upsert_ledger(ledger: DataFrame, updates: DataFrame) -> DataFrame:
    """Rows of ``updates`` replace rows of the same symbol and month."""
    return ledger.join(updates, [SYMBOL, MONTH], "left_anti").unionByName(updates)


def pending_months(months: DataFrame, ledger: DataFrame, force: bool = False) -> DataFrame:
    """Months that still need work: all if forced, else those not marked complete."""
    if force:
        return months
    return months.join(ledger.where("missing_hours = 0"), [SYMBOL, MONTH], "left_anti")


def archive_totals(ledger: DataFrame) -> DataFrame:
    """Rows, missing hours and failed months (no rows, hours missing) of the ledger."""
    failed = (F.col("rows") == 0) & (F.col("missing_hours") > 0)
    return ledger.agg(
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum("missing_hours"), F.lit(0)).alias("total_missing"),
        F.count_if(failed).alias("total_errors"),
    )


def dedup_keep_first(ticks: DataFrame, priority: str, seq: str = "seq") -> DataFrame:
    """One row per symbol and timestamp: lowest ``priority``, then lowest ``seq``; rows without a ``seq`` come last."""
    order = Window.partitionBy(SYMBOL, TIMESTAMP).orderBy(priority, F.col(seq).asc_nulls_last())
    return ticks.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def patch_merge(base: DataFrame, patches: DataFrame) -> DataFrame:
    """Union of both with existing rows winning; columns a side lacks become NULL.

    Only months that get a patch row are merged and deduplicated. Other months
    pass through without a shuffle: the list of touched months is stored, so it
    is broadcast by its measured size.
    """
    month = F.date_trunc("month", TIMESTAMP)
    touched = materialize(patches.select(SYMBOL, month.alias("_month")).distinct(), "touched")
    keyed = base.withColumn("_month", month)
    untouched = keyed.join(touched, [SYMBOL, "_month"], "left_anti")
    affected = keyed.join(touched, [SYMBOL, "_month"], "left_semi").drop("_month")
    union = affected.withColumn("_source", F.lit(0)).unionByName(
        patches.withColumn("_source", F.lit(1)), allowMissingColumns=True
    )
    merged = dedup_keep_first(union, "_source").drop("_source")
    return untouched.drop("_month").unionByName(merged, allowMissingColumns=True)


def _usable(patches: DataFrame, missing: DataFrame) -> DataFrame:
    return patches.withColumn(SLOT, _hour(TIMESTAMP)).join(missing, [SYMBOL, SLOT], "left_semi").drop(SLOT)


def repair_missing_hours(
    base: DataFrame, patches: DataFrame, asset_class: str = "fx", months: DataFrame | None = None
) -> DataFrame:
    """The whole archive with missing slots filled from ``patches``; rows for covered slots are not used.

    Give ``months`` to fill months of which the archive has nothing.
    """
    return patch_merge(base, _usable(patches, missing_hours(base, asset_class, months)))


def repair_months(
    base: DataFrame,
    patches: DataFrame,
    months: DataFrame,
    ledger: DataFrame,
    asset_class: str = "fx",
    force: bool = False,
) -> DataFrame:
    """Only the months that a repair changes, with all their symbols and their ``month`` key.

    ``months`` (symbol, month_start) is what there should be. Months that ``ledger`` marks complete are
    not looked at unless ``force``. Ticks are matched by the ``month`` column, so an archive laid out
    in month folders is read in the months at work only. Equal timestamps are reduced to one row only in the series
    that get a patch; the other symbols of these months pass through. ``sources.replace_months`` writes the result back.
    """
    keyed = base if MONTH in base.columns else base.withColumn(MONTH, month_key(TIMESTAMP))
    wanted = months.select(SYMBOL, "month_start", month_key("month_start").alias(MONTH)).distinct()
    work = materialize(pending_months(wanted, ledger, force), "pending")
    ticks = keyed.join(work.select(SYMBOL, MONTH), [SYMBOL, MONTH], "left_semi")
    missing = missing_hours(ticks, asset_class, work.select(SYMBOL, "month_start"))
    usable = materialize(_usable(patches, missing).withColumn(MONTH, month_key(TIMESTAMP)), "usable")
    series = materialize(usable.select(SYMBOL, MONTH).distinct(), "patched-series")
    changed = keyed.join(series.select(MONTH).distinct(), MONTH, "left_semi")
    patched = changed.join(series, [SYMBOL, MONTH], "left_semi").withColumn("_source", F.lit(0))
    others = changed.join(series, [SYMBOL, MONTH], "left_anti")
    union = patched.unionByName(usable.withColumn("_source", F.lit(1)), allowMissingColumns=True)
    return dedup_keep_first(union, "_source").drop("_source").unionByName(others, allowMissingColumns=True)


def repair_report(base: DataFrame, repaired: DataFrame, asset_class: str = "fx") -> DataFrame:
    """Rows added and hours still missing per symbol and month."""
    def per_month(slots: DataFrame, what: Column, name: str) -> DataFrame:
        return slots.groupBy(SYMBOL, month_key(SLOT).alias(MONTH)).agg(what.alias(name))

    before = per_month(slot_counts(base), F.sum("ticks"), "_before")
    after = per_month(slot_counts(repaired), F.sum("ticks"), "_after")
    missing = per_month(missing_hours(repaired, asset_class), F.count(F.lit(1)), "still_missing")
    key = [SYMBOL, MONTH]
    return (
        after.join(before, key, "left")
        .join(missing, key, "left")
        .select(
            *key,
            (F.col("_after") - F.coalesce("_before", F.lit(0))).alias("rows_added"),
            F.coalesce("still_missing", F.lit(0)).alias("still_missing"),
        )
    )
