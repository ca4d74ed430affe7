import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom import config as C
from barloom.operators.indicators import combine_market_features
from barloom.operators.series import (
    ema_history,
    index_series,
    prefix_over_chunks,
    shift_across,
    time_chunk,
    with_halo,
)


@pytest.mark.parametrize("seconds", [3600 * 7, 3600 * 24 * 400])
def test_index_matches_row_order_for_any_chunk(long_bars, seconds):
    got = index_series(long_bars, chunk=time_chunk("bar_start", seconds)).toPandas()
    for _, g in got.sort_values("bar_start").groupby("symbol"):
        assert g["idx"].tolist() == list(range(len(g)))
        assert (g["series_len"] == len(g)).all()


def test_halo_copies_only_edges(long_bars):
    indexed = index_series(long_bars)
    haloed = with_halo(indexed, before=5, after=3, block_rows=100).toPandas()
    own = haloed[haloed.is_own]
    assert len(own) == 2670 and (own.block == own.idx // 100).all()
    long = haloed[(haloed.symbol == "LONG") & ~haloed.is_own]
    assert len(long) == 25 * (5 + 3)
    assert set(long[long.block == 1].idx) == set(range(95, 100)) | set(range(200, 203))


def test_halo_longer_than_block_is_an_error(long_bars):
    with pytest.raises(ValueError):
        with_halo(index_series(long_bars), before=11, block_rows=10)


@pytest.mark.parametrize("forward", [False, True])
def test_shift_skips_empty_chunks(spark, forward):
    rows = [("A", t, float(t)) for t in (0, 1, 2, 50, 51, 400)] + [("B", 7, 7.0)]
    df = spark.createDataFrame(rows, "symbol string, t bigint, v double")
    got = shift_across(df, F.floor(F.col("t") / 10), ["t"], {"v": "near"}, forward).orderBy("symbol", "t")
    near = [r["near"] for r in got.collect()]
    assert near == ([1, 2, 50, 51, 400, None, None] if forward else [None, 0, 1, 2, 50, 51, None])


def test_prefix_sum_over_chunks(spark):
    df = spark.createDataFrame([("A", i, i // 4, i) for i in range(11)], "symbol string, t int, c int, v int")
    got = prefix_over_chunks(df, "c", ["t"], "v", "run").orderBy("t").collect()
    assert [r["run"] for r in got] == np.cumsum(range(11)).tolist()
    assert {r["run_total"] for r in got} == {55}


def test_ema_history():
    assert ema_history((12, 26)) == 512
    with pytest.raises(ValueError):
        ema_history((2, 500))


def pandas_features(g: pd.DataFrame) -> pd.DataFrame:
    """Each indicator from its definition, on one whole series."""
    close, high, low, prev = g.close, g.high, g.low, g.close.shift(1)
    out = pd.DataFrame(index=g.index)
    out["return_4"] = close / close.shift(4) - 1
    out["return_12"] = close / close.shift(12) - 1
    fast = close.ewm(span=12, adjust=False).mean()
    slow = close.ewm(span=26, adjust=False).mean()
    out["ema_12"], out["ema_26"], out["macd_pct"] = fast / close - 1, slow / close - 1, (fast - slow) / close
    delta = close.diff()
    gain, loss = delta.clip(lower=0).rolling(14).mean(), (-delta.clip(upper=0)).rolling(14).mean()
    out["rsi_14"] = 100 - 100 / (1 + gain / loss)
    tr = pd.concat([high - low, (high - prev).abs(), (low - prev).abs()], axis=1).max(axis=1)
    atr = tr.rolling(14).mean()
    up, down = high.diff(), -low.diff()
    plus = up.clip(lower=0).where(up > down, 0.0).rolling(14).mean()
    minus = down.clip(lower=0).where(down > up, 0.0).rolling(14).mean()
    pdi, mdi = 100 * plus / atr, 100 * minus / atr
    out["adx_14"] = ((pdi - mdi).abs() / (pdi + mdi).clip(lower=1e-8) * 100).rolling(14).mean()
    out["atr_14"] = atr / close
    mid, std = close.rolling(20).mean(), close.rolling(20).std()
    out["bb_width"], out["bb_position"] = 4 * std / mid, (close - mid) / (2 * std)
    ret = close / prev - 1
    out["volatility_24"] = ret.rolling(24).std()
    out["vol_ratio_6_24"] = ret.rolling(6).std() / out["volatility_24"]
    z = lambda x, w: (x - x.rolling(w).mean()) / x.rolling(w).std()
    out["spread_z_24"], out["tick_count_z_24"] = z(g.spread, 24), z(g.tick_count, 24)
    lo, hi = low.rolling(24).min(), high.rolling(24).max()
    out["close_in_range_24"] = (close - lo) / (hi - lo)
    obv = (np.sign(delta.fillna(0)) * g.volume).cumsum()
    out["obv_z_48"], out["obv_delta_12"] = z(obv, 48), obv - obv.shift(12)
    return out


@pytest.mark.parametrize("block_rows", [512, 1024, 8192])
def test_features_do_not_depend_on_blocks(long_bars, block_rows):
    got = combine_market_features(long_bars, block_rows).toPandas().sort_values(["symbol", "idx"])
    assert [c for c in got.columns if c in C.FEATURES] == list(C.FEATURES)
    for _, g in got.groupby("symbol"):
        g = g.reset_index(drop=True)
        expected = pandas_features(g)
        for c in expected.columns:
            np.testing.assert_allclose(g[c].astype(float), expected[c], rtol=1e-9, atol=1e-11, err_msg=c)


def test_warm_up_lengths(long_bars):
    got = combine_market_features(long_bars).where("symbol = 'SHORT'").toPandas().sort_values("idx")
    first = {c: int(got[c].notna().to_numpy().argmax()) for c in C.FEATURES}
    expected = {"return_4": 4, "return_12": 12, "ema_26": 0, "rsi_14": 14, "atr_14": 13, "adx_14": 26,
                "bb_width": 19, "volatility_24": 24, "spread_z_24": 23, "obv_z_48": 47, "obv_delta_12": 12}
    assert {k: first[k] for k in expected} == expected


def test_flat_prices_give_nan_not_errors(make_bars):
    got = combine_market_features(make_bars([100.0] * 60)).orderBy("idx").toPandas()
    last = got.iloc[-1]
    for c in ("rsi_14", "bb_position", "vol_ratio_6_24", "spread_z_24", "close_in_range_24", "obv_z_48"):
        assert np.isnan(last[c])
    assert last["return_4"] == 0.0 and last["bb_width"] == 0.0 and np.isnan(last["adx_14"])


def test_rising_prices_have_rsi_100(make_bars):
    got = combine_market_features(make_bars([100.0 + i for i in range(60)])).orderBy("idx").toPandas()
    assert got["rsi_14"].iloc[-1] == 100.0


def test_one_exchange_serves_all_features(long_bars):
    plan = combine_market_features(long_bars)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(symbol") == 4  # index: 3, all windows: 1
    assert plan.count("+- Sort [") + plan.count(":- Sort [") <= 3
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
