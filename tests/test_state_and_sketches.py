from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from barloom import config as C
from barloom.operators import archive as A
from barloom.operators import indicators, sketches, state
from barloom.operators.bars import build_bars

START = datetime(2024, 1, 1)


def tick(hour, seq=0, symbol="A", ask=None):
    price = ask if ask is not None else 1.0 + (hour * 37 % 101) / 50
    return (symbol, START + timedelta(hours=hour), seq, price, price - 0.1, 1.0 + hour % 3, 2.0)


@pytest.mark.parametrize("cuts", [(200,), (60, 61, 200), (10, 30)])
def test_continued_features_equal_those_of_the_full_history(make_ticks, cuts):
    ticks = [tick(h) for h in range(260)] + [tick(h, symbol="B") for h in range(100, 230)] + [tick(h, symbol="C") for h in range(250, 255)]
    bars = build_bars(make_ticks(ticks))
    full = {(r.symbol, r.bar_start): r for r in indicators.combine_market_features(bars).collect()}
    part = lambda a, b: bars.where((F.col("bar_start") >= START + timedelta(hours=a)) & (F.col("bar_start") < START + timedelta(hours=b)))
    edges = [*cuts, 260]
    known = state.series_state(indicators.combine_market_features(part(0, cuts[0])))
    for a, b in zip(edges, edges[1:]):
        got = state.continue_series(known, part(a, b))
        known = state.series_state(got)
    rows = [r for r in got.collect() if r.is_new]
    assert len(rows) == sum(1 for s, t in full if t >= START + timedelta(hours=edges[-2]))
    for r in rows:
        for c in C.FEATURES:
            want, have = full[r.symbol, r.bar_start][c], r[c]
            assert (have is None) == (want is None) and (want is None or have == pytest.approx(want, abs=1e-9, nan_ok=True)), c


def test_state_keeps_a_bounded_tail(make_ticks):
    row = state.series_state(indicators.combine_market_features(build_bars(make_ticks([tick(h) for h in range(80)])))).first()
    assert len(row.bars) == state.HISTORY == 48 and row.bars[-1]["bar_start"] == START + timedelta(hours=79)


def test_sketches_replace_months_and_keep_the_bound(spark, make_ticks, tmp_path):
    rows = [("A", START + timedelta(minutes=20 * i), i, 2.0 + i % 997, 1.0, 1.0, 1.0) for i in range(6000)]
    ticks = make_ticks(rows + [("B", START, 0, None, 1.0, 1.0, 1.0)])
    folder = str(tmp_path / "sketches")
    made = sketches.tick_sketches(ticks)
    sketches.write_sketches(made, folder)
    sketches.write_sketches(made.where("month = '2024-02'"), folder)
    stored = spark.read.parquet(folder).withColumn("month", F.col("month").cast("string"))
    again = sketches.replace_sketches(stored, made.where("month = '2024-01'"))
    merged = sketches.merge_months(again).cache()
    assert {r.symbol: r.ticks for r in merged.collect()} == {"A": 6000, "B": 1}
    found = sketches.sketch_quantiles(merged, [0.0, 0.1, 0.5, 1.0])
    assert [r.value for r in found.where("symbol = 'B'").collect()] == [None] * 4
    ranked = sketches.exact_ranks(ticks, found).collect()
    assert len(ranked) == 4
    assert all(r.below <= r.quantile + sketches.RANK_ERROR and r.up_to >= r.quantile - sketches.RANK_ERROR for r in ranked)
    distinct = {r.symbol: r.distinct for r in sketches.sketch_distinct(merged).collect()}
    assert distinct["B"] == 1 and abs(distinct["A"] - 6000) <= 6000 * sketches.COUNT_ERROR


def test_ticks_without_seq_keep_their_bar(make_ticks):
    bare = [tick(0, None, ask=1.0 + i) for i in range(3)]
    bare = [(s, t + timedelta(minutes=i), *rest) for i, (s, t, *rest) in enumerate(bare)]
    row = build_bars(make_ticks(bare)).first()
    assert (row.open, row.close) == (pytest.approx(0.95), pytest.approx(2.95))
    mixed = [tick(0, 5, ask=3.0), tick(0, None, ask=9.0), tick(0, -(2**63), ask=1.0)]
    row = build_bars(make_ticks(mixed)).first()
    assert (row.open, row.close) == (pytest.approx(0.95), pytest.approx(8.95))


def test_repair_keeps_ties_of_series_without_patches(spark, make_ticks):
    at = datetime(2024, 2, 5, 1)
    base = make_ticks([("A", at, 1, 1.1, 1.0, 1.0, 1.0), ("B", at, 1, 1.1, 1.0, 1.0, 1.0), ("B", at, 2, 1.2, 1.0, 1.0, 1.0)])
    patches = make_ticks([("A", at + timedelta(hours=2), 7, 1.1, 1.0, 1.0, 1.0)])
    months = base.select("symbol", F.lit(datetime(2024, 2, 1)).alias("month_start")).distinct()
    ledger = spark.createDataFrame([], "symbol string, month string, rows bigint, missing_hours bigint, confirmed_absent bigint")
    fixed = A.repair_months(base, patches, months, ledger, "fx")
    assert sorted((r.symbol, r.seq) for r in fixed.collect()) == [("A", 1), ("A", 7), ("B", 1), ("B", 2)]
