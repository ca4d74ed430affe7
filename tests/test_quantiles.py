import math

import numpy as np
import pytest

from barloom.operators.profile import (
    bar_gaps,
    duplicate_timestamps,
    gap_summary,
    histogram,
    large_gaps,
    tick_gaps,
    tick_overview,
    tick_quality,
)
from barloom.operators.quantiles import LINEAR, NEAREST, exact_quantiles
from datetime import timedelta
from tests.conftest import T0

SPOTS = (0.0, 0.01, 0.05, 0.25, 0.5, 0.95, 0.99, 1.0)


def nearest(values, q):
    return sorted(values)[int(math.floor((len(values) - 1) * q + 0.5))]


def samples():
    rng = np.random.default_rng(3)
    return {
        "normal": rng.normal(0, 1, 3000).tolist(),
        "heavy": np.exp(rng.normal(0, 6, 3000)).tolist(),
        "ties": rng.choice([1.0, 2.0, 5.0], 3000, p=[0.9, 0.05, 0.05]).tolist(),
        "constant": [4.25] * 100,
        "single": [1.5],
        "pair": [1.0, 2.0],
        "tiny_range": (1e9 + rng.integers(0, 50, 500) * 1e-7).tolist(),
    }


@pytest.mark.parametrize("how", [NEAREST, LINEAR])
def test_exact_quantiles(spark, how):
    data = samples()
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs], "symbol string, v double")
    names = {f"q{i}": (q, how) for i, q in enumerate(SPOTS)}
    rows = {r["symbol"]: r for r in exact_quantiles(df, "v", names).collect()}
    assert set(rows) == set(data)
    for key, values in data.items():
        for name, (q, _) in names.items():
            expected = nearest(values, q) if how == NEAREST else float(np.quantile(values, q))
            assert rows[key][name] == pytest.approx(expected, rel=1e-12), (key, q)


def test_infinities_and_nulls(spark):
    inf = math.inf
    values = [None, -inf, -inf, 1.0, 2.0, 3.0, inf, None]
    df = spark.createDataFrame([("A", v) for v in values], "symbol string, v double")
    got = exact_quantiles(df, "v", {f"q{i}": (i / 5, NEAREST) for i in range(6)}).first()
    assert [got[f"q{i}"] for i in range(6)] == [-inf, -inf, 1.0, 2.0, 3.0, inf]


def test_quantiles_do_not_hold_a_group_in_one_buffer(spark):
    df = spark.range(10).selectExpr("if(id < 0, 'B', 'A') as symbol", "cast(id as double) as v")
    plan = exact_quantiles(df, "v", {"p50": (0.5, NEAREST)})._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def quote(seconds, seq=0, ask=1.01, bid=1.0, ask_volume=1.0, bid_volume=1.0, symbol="A"):
    ts = None if seconds is None else T0 + timedelta(seconds=seconds)
    return (symbol, ts, seq, ask, bid, ask_volume, bid_volume)


def test_gaps_cross_chunks_and_ties_count_as_zero(make_ticks):
    seconds = [0, 1, 1, 3599, 3601, 30_000, 200_000]
    ticks = make_ticks([quote(t, i) for i, t in enumerate(seconds)] + [quote(5, symbol="B")])
    gaps = tick_gaps(ticks)
    got = sorted(r["gap_us"] // 1_000_000 for r in gaps.collect())
    assert got == sorted(np.diff(seconds).tolist())
    summary = gap_summary(gaps).collect()
    assert len(summary) == 1 and summary[0]["max_gap"] == 170_000 * 10**6 and summary[0]["min_gap"] == 0
    assert [r["gap_us"] for r in large_gaps(gaps, "timestamp").collect()] == [170_000 * 10**6, 26_399 * 10**6]


def test_bar_gaps(make_bars):
    gaps = bar_gaps(make_bars([1.0, 1.0, 1.0], hours=[0, 1, 5])).orderBy("bar_start").collect()
    assert [r["gap_us"] for r in gaps] == [3600 * 10**6, 4 * 3600 * 10**6]


def test_overview_counts_null_timestamps_as_a_value(make_ticks):
    ticks = make_ticks([quote(0), quote(0, 1), quote(1, 2, ask=None), quote(None, 3)])
    row = tick_overview(ticks).first()
    assert (row["rows"], row["unique_timestamps"], row["ask_nulls"]) == (4, 3, 1)
    assert tick_overview(ticks, approximate=True).first()["unique_timestamps"] == 3


def test_quality_counters(make_ticks):
    bad = [
        quote(0, ask=0.0, bid=-1.0),
        quote(1, ask=1.0, bid=2.0),
        quote(2, ask=1.0, bid=1.0),
        quote(3, ask_volume=-1.0, bid_volume=-1.0),
        quote(4, ask=None),
    ]
    row = tick_quality(make_ticks(bad)).first().asDict()
    assert row == {
        "symbol": "A", "ask_non_positive": 1, "bid_non_positive": 1, "ask_below_bid": 1, "negative_spread": 1,
        "zero_spread": 1, "negative_ask_volume": 1, "negative_bid_volume": 1,
    }


def test_duplicates(make_ticks):
    rows = duplicate_timestamps(make_ticks([quote(t, i) for i, t in enumerate([1, 2, 2, 3, 3, 3])])).collect()
    assert [r["n"] for r in rows] == [3, 2]


def test_histogram_includes_the_top_edge(spark):
    df = spark.createDataFrame([("A", float(v)) for v in [0, 1, 2, 9, 10, 10]], "symbol string, v double")
    rows = {r["bin"]: r["rows"] for r in histogram(df, "v", bins=10).collect()}
    counts, _ = np.histogram([0, 1, 2, 9, 10, 10], bins=10)
    assert rows == {i: int(n) for i, n in enumerate(counts) if n}


def test_histogram_holds_finite_values_only(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("A", v) for v in (1.0, 2.0, inf, -inf, nan, None)], "symbol string, v double")
    assert {(r["bin"], r["rows"]) for r in histogram(df, "v", bins=2).collect()} == {(0, 1), (1, 1)}


def test_crowded_cells_are_cut_again(spark, monkeypatch):
    from barloom.operators import quantiles as Q

    monkeypatch.setattr(Q, "FULL_CELL", 20)
    values = [1e9, -1e9, *[float(i) for i in range(3)], *[0.5 + i * 1e-9 for i in range(3000)], *[7.0] * 500]
    df = spark.createDataFrame([(s, v) for s in "AB" for v in values], "symbol string, v double").repartition(5)
    spots = {"p10": (0.1, NEAREST), "p50": (0.5, LINEAR), "p99": (0.99, NEAREST), "max": (1.0, NEAREST)}
    ordered = sorted(values)
    n = len(values) - 1
    low = int(n * 0.5)
    mid = ordered[low] + (ordered[min(low + 1, n)] - ordered[low]) * (n * 0.5 - low)
    for r in exact_quantiles(df, "v", spots).collect():
        assert (r["p10"], r["p99"], r["max"]) == (ordered[int(n * 0.1 + 0.5)], ordered[int(n * 0.99 + 0.5)], 1e9)
        assert r["p50"] == pytest.approx(mid, abs=1e-15)


def test_only_wanted_cells_are_shuffled_by_value(spark):
    df = spark.range(200_000).selectExpr("'A' as symbol", "cast(id as double) as v")
    out = exact_quantiles(df, "v", {"p50": (0.5, NEAREST)})
    assert out.first()["p50"] == 100_000.0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "value_counts" not in plan
