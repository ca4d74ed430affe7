import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from barloom.operators.kernel import FourierFeatures
from barloom.plans import run, stacking
from barloom.plans.dataset import label_and_split, split_views
from barloom.plans.stacking import LOGISTIC, StackingClassifier, TrainingOptions, logistic_pipeline
from barloom.session import materialize


def one_feature(prefix):
    def factory(ctx):
        return Pipeline(
            stages=[*stacking._scaled(prefix, ctx.features[:2]), stacking._logistic(prefix, f"_{prefix}_scaled", ctx.rows)]
        )

    return factory


@pytest.fixture(scope="module")
def everything(long_bars):
    return materialize(label_and_split(long_bars.drop("signal")), "labeled")


@pytest.fixture(scope="module")
def fitted(everything):
    data = split_views(everything)
    options = run.RunOptions(training=TrainingOptions(folds=3))
    model = StackingClassifier(options.training, {LOGISTIC: logistic_pipeline, "two": one_feature("two")})
    model.fit(materialize(data.train, "train"))
    return options, data, model


def test_oof_covers_each_tested_row_once(fitted):
    _, data, model = fitted
    oof = model.oof.toPandas()
    assert not oof.duplicated(["symbol", "row"]).any()
    n = data.train.where("symbol = 'LONG'").count()
    long = oof[oof.symbol == "LONG"]
    assert sorted(long.row) == list(range(n // 4, n))
    assert oof[model.probability_columns].apply(lambda s: s.between(0, 1)).all().all()


def test_probabilities_sum_to_one_and_signals_are_binary(fitted):
    options, data, model = fitted
    scored = run.score_test(model, data)
    rows = scored.toPandas()
    np.testing.assert_allclose(rows.p_sell + rows.p_buy, 1.0)
    assert set(rows.raw_signal) <= {-1, 1} and len(rows) == data.test_continuous.count()


def test_run_outputs(spark, everything, fitted, tmp_path):
    options, data, model = fitted
    out = run.evaluate(everything, data, model, options)
    table = run.metric_table(out)
    assert [r["model"] for r in table.collect()] == [
        "naive_majority", "naive_random_prior", "naive_momentum_return_4", "naive_buy_only",
        LOGISTIC, "two", "hybrid_stacking",
    ]
    run.publish_run(out, str(tmp_path), "test")
    names = {p.name for p in (tmp_path / "tables").iterdir()}
    assert names == {"predictions", "trades", "backtest_metrics", "baseline_metrics", "feature_importance"}
    doc = spark.read.json(str(tmp_path / "run_data"))
    row = doc.where("symbol = 'LONG'").first()
    assert row["backtest"]["trades"] > 0 and row["options"]["training"]["folds"] == 3
    assert row["dataset"]["train"]["rows"] == data.train.where("symbol = 'LONG'").count()
    assert set(row["active_models"]) == {LOGISTIC, "two"}


def test_one_class_train_has_no_active_model_and_even_odds(fitted):
    _, data, _ = fitted
    model = StackingClassifier(TrainingOptions(folds=3), {LOGISTIC: logistic_pipeline})
    model.fit(materialize(data.train.where("label = 1 and symbol = 'LONG'"), "buys"))
    assert model.active == {} and model.meta is None
    assert {r["p_logistic_regression"] for r in model.oof.collect()} == {1.0}
    assert {r["p_buy"] for r in model.predict_proba(data.test_labeled).collect()} == {0.5}


def test_without_meta_the_bases_are_averaged(fitted):
    options, data, model = fitted
    plain = StackingClassifier(options.training, model.base_models)
    plain.active = model.active
    rows = plain.predict_proba(data.test_labeled).toPandas()
    np.testing.assert_allclose(rows.p_buy, (rows[f"p_{LOGISTIC}"] + rows["p_two"]) / 2)


def test_logistic_matches_a_direct_minimisation(spark):
    """L2 with C = 1 and balanced weights, checked by its stationarity condition."""
    rng = np.random.default_rng(0)
    n = 400
    x = rng.normal(size=(n, 2))
    label = np.where(x[:, 0] - 0.5 * x[:, 1] + rng.normal(size=n) > 0.7, 1, -1)
    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": label})
    ctx = stacking.FitContext(n, 1, ("a", "b"))
    sell, buy = int((label == -1).sum()), int((label == 1).sum())
    fitted = logistic_pipeline(ctx).fit(stacking._target(spark.createDataFrame(pdf), sell, buy))
    lr = fitted.stages[-1]
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    w = np.where(label == 1, n / (2 * buy), n / (2 * sell))
    beta, b0 = lr.coefficients.toArray(), lr.intercept
    residual = w * (1 / (1 + np.exp(-(z @ beta + b0))) - (label == 1))
    np.testing.assert_allclose(z.T @ residual + beta, 0, atol=0.02)
    assert abs(residual.sum()) < 0.02


def test_fourier_features_approximate_the_kernel(spark):
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i int, x array<double>")
    mapper = FourierFeatures("v", "z", 4, width=2048, seed=5)
    out = mapper.transform(df.select("i", array_to_vector("x").alias("v")))
    z = np.array([r["z"] for r in out.orderBy("i").select(vector_to_array("z").alias("z")).collect()])
    exact = np.exp(-((x[:, None] - x[None]) ** 2).sum(-1) / 4)
    assert np.abs(z @ z.T - exact).max() < 0.12


def test_split_counts_of_the_boosted_trees(fitted, monkeypatch):
    from pyspark.ml.classification import GBTClassifier

    _, data, _ = fitted

    def small(ctx):
        p = stacking.BOOSTED
        trees = GBTClassifier(featuresCol=f"_{p}_vector", maxIter=3, maxDepth=2, seed=1, **stacking._names(p))
        trees.setRawPredictionCol(f"_{p}_raw").setProbabilityCol(f"_{p}_probability")
        return Pipeline(stages=[*stacking._imputed(p, ctx.features), trees])

    model = StackingClassifier(base_models={stacking.BOOSTED: small})
    model.fit_bases(data.train)
    rows = stacking.feature_importance(model, data.train).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == list(range(1, 31))
    assert sum(r["pct"] for r in rows) == pytest.approx(100.0)
    total = sum(t.numNodes // 2 for t in model.active[stacking.BOOSTED].stages[-1].trees)
    assert sum(r["importance"] for r in rows) == total
    assert stacking.feature_importance(StackingClassifier(), data.train).count() == 0
    assert data.train.select(F.count("*")).first()[0] > 0
