import pytest

from barloom.operators.folds import fold_bounds, fold_rows, number_rows, purged_folds
from barloom.operators.labels import (
    assign_future_return_labels,
    chronological_split,
    label_counts,
    label_distribution,
)
from barloom.operators.series import index_series
from barloom.plans.dataset import checked_views, label_and_split
from barloom.session import materialize


def labelled(df, *columns):
    return [tuple(r[c] for c in columns) for r in df.orderBy("bar_start").collect()]


def test_labels_from_the_next_bar(make_bars):
    got = assign_future_return_labels(make_bars([100.0, 110.0, 99.0, 101.0]), horizon=1, threshold=0.0)
    assert labelled(got, "label", "event_start", "event_end") == [(1, 0, 1), (-1, 1, 2), (1, 2, 3)]
    returns = [r[0] for r in labelled(got, "future_return")]
    assert returns == pytest.approx([0.10, -0.10, 101 / 99 - 1])


def test_small_moves_are_dropped_and_events_keep_bar_positions(make_bars):
    got = assign_future_return_labels(make_bars([100.0, 100.01, 99.0, 101.0]), horizon=1, threshold=0.0005, max_gap_hours=999.0)
    assert labelled(got, "label", "event_start", "event_end") == [(-1, 1, 2), (1, 2, 3)]


@pytest.mark.parametrize("n, horizon", [(2, 2), (3, 10)])
def test_horizon_beyond_the_series(make_bars, n, horizon):
    assert assign_future_return_labels(make_bars([1.0, 2.0, 3.0][:n]), horizon=horizon).count() == 0


def test_horizon_must_be_positive(make_bars):
    with pytest.raises(ValueError):
        assign_future_return_labels(make_bars([1.0]), horizon=0)


def test_gap_limit(make_bars):
    bars = make_bars([100.0, 101.0, 102.0, 103.0], hours=[0, 1, 30, 31])
    got = assign_future_return_labels(bars, horizon=1, threshold=0.0, max_gap_hours=5.0)
    assert labelled(got, "event_start", "future_gap_hours") == [(0, 1.0), (2, 1.0)]


def test_zero_and_nan_closes_have_no_label(make_bars):
    got = assign_future_return_labels(make_bars([0.0, 1.0, float("nan"), 1.0, 2.0]), horizon=1, threshold=0.0)
    assert labelled(got, "event_start") == [(3,)]


@pytest.mark.parametrize("block_rows", [8, 64, 8192])
def test_labels_do_not_depend_on_blocks(long_bars, block_rows):
    got = assign_future_return_labels(long_bars, 4, 0.0005, 5.0, block_rows).toPandas()
    bars = long_bars.toPandas().sort_values(["symbol", "bar_start"])
    ret = bars.groupby("symbol").close.shift(-4) / bars.close - 1
    assert len(got) == int((ret.abs() > 0.0005).sum())
    assert int(got.label.sum()) == int((ret > 0.0005).sum() - (ret < -0.0005).sum())


@pytest.mark.parametrize(
    "labels, expected", [([1, -1, 1, 1, -1], (3, 2, 5, 0.6667)), ([1, 1, 1], (3, 0, 3, 0.0))]
)
def test_label_distribution(spark, labels, expected):
    df = spark.createDataFrame([("A", x) for x in labels], "symbol string, label int")
    row = label_distribution(df).first()
    assert (row["buy"], row["sell"], row["total"], row["balance_ratio"]) == expected
    assert [r["label"] for r in label_counts(df).collect()] == sorted(set(labels))


def test_split_positions(make_bars):
    parts = chronological_split(index_series(make_bars([100.0 + i * 0.1 for i in range(80)])))
    got = {r["part"]: r["count"] for r in parts.groupBy("part").count().collect()}
    assert got == {"train": 64, "purge": 4, "test": 12}
    test = parts.where("part = 'test'").orderBy("idx").first()
    assert (test["slice_start"], test["slice_end"]) == (68, 80)


def test_dataset_frames(long_bars):
    data = checked_views(materialize(label_and_split(long_bars), "labeled"))
    assert data.featured.count() == 2670
    assert "label" not in data.test_continuous.columns
    train = data.train.where("symbol = 'LONG'").toPandas()
    # the last horizon of the train slice has no label, and warm-up rows are gone
    assert train.idx.max() < int(2600 * 0.8) - 4 and train.idx.min() >= 47
    assert (train.event_start == train.idx).all()
    test = data.test_labeled.where("symbol = 'LONG'").toPandas()
    assert (test.event_start == test.idx - 2084).all() and (test.event_end <= 515).all()
    assert data.test_continuous.count() >= data.test_labeled.count() > 0


def test_empty_dataset_is_an_error(make_bars):
    with pytest.raises(ValueError, match="more ticks"):
        checked_views(label_and_split(make_bars([100.0] * 10)))


def events(spark, pairs):
    rows = [("A", i, len(pairs), s, e) for i, (s, e) in enumerate(pairs)]
    return spark.createDataFrame(
        rows, "symbol string, row bigint, n_rows bigint, event_start bigint, event_end bigint"
    )


def test_purge_removes_overlapping_rows(spark):
    df = events(spark, [(0, 1), (2, 6), (4, 5), (8, 12)])
    bounds = fold_bounds(df, 1)
    assert [(r["_first"], r["_test_from"], r["_test_to"]) for r in bounds.collect()] == [(2, 4, 12)]
    assert [r["row"] for r in fold_rows(df, bounds, "train").collect()] == [0]


def reference_folds(es, ee, k):
    """Plain loop over the definition."""
    n, out = len(es), {}
    size = max(1, n // (k + 1))
    for i in range(k):
        lo = (i + 1) * size
        hi = lo + size if i < k - 1 else n
        if lo >= n:
            continue
        train = [r for r in range(lo) if not (es[r] <= ee[hi - 1] and ee[r] >= es[lo])]
        if train:
            out[i] = (train, list(range(lo, hi)))
    return out


@pytest.mark.parametrize("n, h, k", [(50, 1, 3), (103, 4, 5), (7, 9, 5), (5, 1, 5), (61, 12, 5)])
def test_folds_match_a_plain_loop(spark, n, h, k):
    df = events(spark, [(2 * i, 2 * i + h) for i in range(n)])
    rows = purged_folds(df, k).collect()
    expected = reference_folds([2 * i for i in range(n)], [2 * i + h for i in range(n)], k)
    assert {r["fold"] for r in rows} == set(expected)
    for fold, (train, test) in expected.items():
        assert sorted(r["row"] for r in rows if r["fold"] == fold and r["role"] == "train") == train
        assert sorted(r["row"] for r in rows if r["fold"] == fold and r["role"] == "test") == test
        assert max(train) < min(test)


def test_rows_are_numbered_among_labelled_rows(make_bars):
    got = assign_future_return_labels(make_bars([100.0, 100.01, 99.0, 101.0]), horizon=1, threshold=0.0005, max_gap_hours=9.0)
    numbered = number_rows(got).orderBy("row").collect()
    assert [(r["row"], r["n_rows"], r["event_start"]) for r in numbered] == [(0, 2, 1), (1, 2, 2)]
