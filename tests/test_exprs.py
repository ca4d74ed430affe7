import math

import pytest
from pyspark.sql import functions as F

from barloom.functions import (
    clip_lower,
    clip_upper,
    drop_null_rows,
    finite_or_zero,
    ieee_div,
    is_finite,
    iso_weekday,
    log1p_ieee,
    replace_infinite_with_nan,
)
from barloom.operators.baselines import momentum_signal

INF, NAN = math.inf, math.nan


def same(a, b):
    return (a is None and b is None) or (a is not None and b is not None and (a == b or (a != a and b != b)))


@pytest.mark.parametrize(
    "num, den, expected",
    [(1.0, 0.0, INF), (-1.0, 0.0, -INF), (0.0, 0.0, NAN), (NAN, 0.0, NAN), (6.0, 3.0, 2.0),
     (None, 0.0, None), (1.0, None, None), (1.0, -0.0, INF)],
)
def test_division_is_ieee(spark, num, den, expected):
    df = spark.createDataFrame([(num, den)], "a double, b double")
    assert same(df.select(ieee_div("a", "b")).first()[0], expected)


def test_finite_helpers(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (INF,), (-INF,), (None,)], "x double")
    got = [r[0] for r in df.select(is_finite("x")).collect()]
    assert got == [True, False, False, False, False]
    assert [r[0] for r in df.select(finite_or_zero("x")).collect()] == [1.0, 0.0, 0.0, 0.0, None]


def test_infinite_becomes_nan_and_nan_rows_survive_the_null_filter(spark):
    df = spark.createDataFrame([(1.0, "x"), (INF, "y"), (-INF, "z"), (None, "w")], "a double, b string")
    rows = drop_null_rows(replace_infinite_with_nan(df)).collect()
    assert [r["b"] for r in rows] == ["x", "y", "z"]
    assert rows[0]["a"] == 1.0 and all(math.isnan(r["a"]) for r in rows[1:])


def test_clips_keep_null_and_nan(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (NAN,), (None,)], "x double")
    low = [r[0] for r in df.select(clip_lower("x", 0.0)).collect()]
    high = [r[0] for r in df.select(clip_upper("x", 0.0)).collect()]
    assert low[:2] == [0.0, 2.0] and math.isnan(low[2]) and low[3] is None
    assert high[:2] == [-1.0, 0.0] and math.isnan(high[2]) and high[3] is None


def test_weekday_is_iso(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-07",)], "d string")
    assert [r[0] for r in df.select(iso_weekday(F.col("d").cast("timestamp"))).collect()] == [1, 7]


def test_log1p_edges(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-2.0,)], "x double")
    got = [r[0] for r in df.select(log1p_ieee("x")).collect()]
    assert got[0] == 0.0 and got[1] == -INF and math.isnan(got[2])


def test_momentum_sells_on_nan_and_null(spark):
    df = spark.createDataFrame([(0.0,), (0.1,), (-0.1,), (NAN,), (None,)], "return_4 double")
    assert [r[0] for r in df.select(momentum_signal()).collect()] == [1, 1, -1, -1, -1]
