import numpy as np
import pytest

from barloom.operators.baselines import (
    baseline_predictions,
    class_priors,
    label_from_probabilities,
    signal_from_probabilities,
)
from barloom.operators.metrics import class_metrics, class_report, confusion_matrix, metric_rows, roc_auc


def scored(spark, y, pred, p_buy, model="m"):
    rows = [(model, a, b, float(c)) for a, b, c in zip(y, pred, p_buy)]
    return spark.createDataFrame(rows, "model string, y int, pred int, p_buy double")


def test_a_tie_buys_as_signal_and_sells_as_label(spark):
    df = spark.createDataFrame([(0.6, 0.4), (0.5, 0.5), (0.3, 0.7), (0.49, 0.51)], "p_sell double, p_buy double")
    assert [r[0] for r in df.select(signal_from_probabilities("p_sell", "p_buy")).collect()] == [-1, 1, 1, 1]
    assert [r[0] for r in df.select(label_from_probabilities("p_sell", "p_buy")).collect()] == [-1, -1, 1, 1]


def test_metric_row(spark):
    row = metric_rows(scored(spark, [-1, 1, 1, -1], [-1, 1, -1, -1], [0.3, 0.8, 0.4, 0.2])).first()
    assert row["accuracy"] == 0.75 and row["roc_auc"] == 1.0
    assert row["precision_sell"] == pytest.approx(2 / 3) and row["recall_buy"] == 0.5


def test_macro_f1_averages_the_classes_that_occur(spark):
    assert class_metrics(scored(spark, [1, 1], [1, 1], [1, 1])).first()["f1_macro"] == 1.0
    assert class_metrics(scored(spark, [1, -1], [1, 1], [1, 1])).first()["f1_macro"] == pytest.approx(1 / 3)


def test_report_and_confusion(spark):
    df = scored(spark, [-1, 1, 1, -1], [-1, 1, -1, -1], [0, 0, 0, 0])
    cells = {(r["y"], r["pred"]): r["rows"] for r in confusion_matrix(df).collect()}
    assert cells == {(-1, -1): 2, (-1, 1): 0, (1, -1): 1, (1, 1): 1}
    report = {r["label"]: r for r in class_report(df).collect()}
    assert report[-1]["support"] == 2 and report[1]["recall"] == 0.5 and report[-1]["precision"] == 0.666667


def brute_auc(y, p):
    pos, neg = p[y == 1], p[y != 1]
    return np.mean([(a > neg).mean() + 0.5 * (a == neg).mean() for a in pos])


@pytest.mark.parametrize("digits", [1, 3, 12])
def test_auc_with_ties(spark, digits):
    rng = np.random.default_rng(digits)
    y = rng.choice([-1, 1], 400)
    p = np.clip(np.round(rng.uniform(0, 1, 400) + 0.1 * y, digits), 0, 1)
    got = roc_auc(scored(spark, y.tolist(), y.tolist(), p.tolist())).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(y, p), rel=1e-12)


def test_auc_of_one_class_is_null(spark):
    assert roc_auc(scored(spark, [1, 1], [1, 1], [0.1, 0.9])).first()["roc_auc"] is None


@pytest.fixture(scope="module")
def train_test(spark):
    from tests.conftest import T0
    from datetime import timedelta

    schema = "symbol string, bar_start timestamp, label int, return_4 double"
    train = [("A", T0, x, 0.0) for x in (-1, -1, 1, -1)]
    test = [("A", T0 + timedelta(hours=i), y, r) for i, (y, r) in enumerate([(1, 0.1), (-1, -0.2), (1, float("nan"))])]
    return spark.createDataFrame(train, schema), spark.createDataFrame(test, schema)


def test_baselines(train_test):
    train, test = train_test
    rows = baseline_predictions(train, test).collect()
    by_model = {}
    for r in sorted(rows, key=lambda r: r["bar_start"]):
        by_model.setdefault(r["model"], []).append(r)
    assert [r["pred"] for r in by_model["naive_majority"]] == [-1, -1, -1]
    assert [r["pred"] for r in by_model["naive_buy_only"]] == [1, 1, 1]
    assert [r["pred"] for r in by_model["naive_momentum_return_4"]] == [1, -1, -1]
    assert {r["pred"] for r in by_model["naive_random_prior"]} <= {-1, 1}
    assert {r["p_sell"] for r in by_model["naive_majority"]} == {0.75}
    assert [r["p_buy"] for r in by_model["naive_momentum_return_4"]] == [1.0, 0.0, 0.0]


def test_random_baseline_is_stable_and_follows_the_prior(spark, train_test):
    from tests.conftest import T0
    from datetime import timedelta

    train, _ = train_test
    test = spark.createDataFrame(
        [("A", T0 + timedelta(hours=i), 1, 0.0) for i in range(4000)],
        "symbol string, bar_start timestamp, label int, return_4 double",
    )
    draw = lambda df: sorted(
        (r["bar_start"], r["pred"])
        for r in baseline_predictions(train, df).where("model = 'naive_random_prior'").collect()
    )
    first = draw(test)
    assert first == draw(test.repartition(7))
    assert np.mean([p == -1 for _, p in first]) == pytest.approx(0.75, abs=0.03)


def test_without_train_rows_priors_are_even(spark, train_test):
    train, test = train_test
    none = train.where("label = 0")
    assert class_priors(none).count() == 0
    rows = baseline_predictions(none, test).where("model = 'naive_majority'").collect()
    assert {(r["pred"], r["p_sell"]) for r in rows} == {(-1, 0.5)}


def test_momentum_needs_its_feature(train_test):
    train, test = train_test
    with pytest.raises(KeyError):
        baseline_predictions(train, test.drop("return_4"))
