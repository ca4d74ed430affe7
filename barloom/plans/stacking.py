"""Stacked Buy/Sell classifier on Spark ML.

Three base models are fitted per purged fold; their out-of-fold buy
probabilities train a logistic meta model; the base models are then refitted on
all train rows. The driver orders at most ``(folds + 1) * models`` fits and only
ever sees class counts per fold and fitted parameters.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression
from pyspark.ml.feature import Imputer, StandardScaler, VectorAssembler, VectorSlicer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.config import BUY, FEATURES, SELL
from barloom.functions import is_finite
from barloom.operators.baselines import label_from_probabilities
from barloom.operators.folds import ROW, fold_bounds, fold_rows, number_rows
from barloom.operators.kernel import FourierFeatures
from barloom.operators.metrics import class_metrics, class_report
from barloom.operators.quantiles import LINEAR, exact_quantiles
from barloom.schema import BAR_START, SYMBOL
from barloom.session import materialize

TARGET, WEIGHT = "_target", "_weight"
LOGISTIC, SVC, BOOSTED = "logistic_regression", "svc", "gradient_boosting"


MEDIAN_RANK_ERROR = 1e-6


@dataclass(frozen=True)
class FitContext:
    """What a model factory may need to know about its training rows."""

    rows: int
    seed: int
    features: tuple[str, ...]


ModelFactory = Callable[[FitContext], Pipeline]


def _names(prefix: str) -> dict[str, str]:
    return {
        "labelCol": TARGET,
        "weightCol": WEIGHT,
        "predictionCol": f"_{prefix}_prediction",
    }


def feature_medians(train: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Exact median of every feature over its values that are numbers."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in features]
    long = train.select(F.explode(F.array(*pairs)).alias("p")).select("p.feature", "p.value")
    return exact_quantiles(long.where(~F.isnan("value")), "value", {"median": (0.5, LINEAR)}, by=["feature"])


def class_weights(train: DataFrame) -> DataFrame:
    """Rows per label and the weight n / (2 n_k) that balances them."""
    sell, buy = class_counts(train)
    counts = train.groupBy("label").agg(F.count(F.lit(1)).alias("rows"))
    return counts.select("label", "rows", (F.lit(sell + buy) / (2 * F.col("rows"))).alias("weight"))


def _imputed(prefix: str, features: Sequence[str]) -> list:
    """Median imputation of NaN, then one vector.

    Spark's imputer ranks within ``MEDIAN_RANK_ERROR`` of the rows; ``feature_medians`` is exact.
    """
    filled = [f"_{prefix}_{c}" for c in features]
    return [
        Imputer(strategy="median", relativeError=MEDIAN_RANK_ERROR, inputCols=list(features), outputCols=filled),
        VectorAssembler(inputCols=filled, outputCol=f"_{prefix}_vector"),
    ]


def _scaled(prefix: str, features: Sequence[str]) -> list:
    scaler = StandardScaler(
        inputCol=f"_{prefix}_vector", outputCol=f"_{prefix}_scaled", withMean=True, withStd=True
    )
    return [*_imputed(prefix, features), scaler]


def _logistic(prefix: str, features_col: str, rows: int) -> LogisticRegression:
    """L2 with C = 1. Balanced weights sum to the row count, hence 1/rows."""
    return LogisticRegression(
        featuresCol=features_col,
        rawPredictionCol=f"_{prefix}_raw",
        probabilityCol=f"_{prefix}_probability",
        regParam=1.0 / rows,
        elasticNetParam=0.0,
        standardization=False,
        maxIter=1000,
        **_names(prefix),
    )


def logistic_pipeline(ctx: FitContext) -> Pipeline:
    p = LOGISTIC
    return Pipeline(stages=[*_scaled(p, ctx.features), _logistic(p, f"_{p}_scaled", ctx.rows)])


def svc_pipeline(ctx: FitContext) -> Pipeline:
    """Linear SVM on Fourier features, with Platt scaling of the margin."""
    p, margin = SVC, "svc_margin"
    svm = LinearSVC(
        featuresCol="_svc_kernel",
        rawPredictionCol=f"_{margin}_raw",
        regParam=1.0 / ctx.rows,
        maxIter=100,
        tol=1e-3,
        standardization=False,
        **_names(margin),
    )
    platt = LogisticRegression(
        featuresCol="_svc_margin",
        rawPredictionCol=f"_{p}_raw",
        probabilityCol=f"_{p}_probability",
        regParam=0.0,
        **_names(p),
    )
    return Pipeline(
        stages=[
            *_scaled(p, ctx.features),
            FourierFeatures(f"_{p}_scaled", "_svc_kernel", len(ctx.features), seed=ctx.seed),
            svm,
            VectorSlicer(inputCol=f"_{margin}_raw", outputCol="_svc_margin", indices=[1]),
            platt,
        ]
    )


def boosted_pipeline(ctx: FitContext) -> Pipeline:
    p = BOOSTED
    trees = GBTClassifier(
        featuresCol=f"_{p}_vector",
        maxIter=120,
        maxDepth=5,
        stepSize=0.035,
        featureSubsetStrategy="0.85",
        seed=ctx.seed,
        **_names(p),
    )
    trees.setRawPredictionCol(f"_{p}_raw").setProbabilityCol(f"_{p}_probability")
    return Pipeline(stages=[*_imputed(p, ctx.features), trees])


def base_model_registry() -> dict[str, ModelFactory]:
    return {LOGISTIC: logistic_pipeline, SVC: svc_pipeline, BOOSTED: boosted_pipeline}


def class_counts(df: DataFrame) -> tuple[int, int]:
    """Sell and buy rows: two numbers."""
    row = df.agg(
        F.count_if(F.col("label") == SELL).alias("sell"), F.count_if(F.col("label") == BUY).alias("buy")
    ).first()
    return row["sell"], row["buy"]


def _target(df: DataFrame, sell: int, buy: int) -> DataFrame:
    """Encode labels as 0/1 and weigh both classes equally: n / (2 n_k)."""
    total = sell + buy
    is_buy = F.col("label") == BUY
    weight = F.when(is_buy, total / (2 * buy)).otherwise(total / (2 * sell))
    return df.withColumn(TARGET, is_buy.cast("double")).withColumn(WEIGHT, weight)


def score(df: DataFrame, name: str, model: PipelineModel) -> DataFrame:
    """Add ``p_{name}``, the buy probability; intermediate columns are dropped."""
    p_buy = vector_to_array(f"_{name}_probability")[1]
    return model.transform(df).select(*df.columns, p_buy.alias(f"p_{name}"))


@dataclass(frozen=True)
class TrainingOptions:
    """Walk-forward folds and the seed of all random draws. The defaults."""

    folds: int = 5
    seed: int = 42


@dataclass
class StackingClassifier:
    """Out-of-fold stacking with injectable base models."""

    options: TrainingOptions = field(default_factory=TrainingOptions)
    base_models: dict[str, ModelFactory] = field(default_factory=base_model_registry)
    features: tuple[str, ...] = FEATURES
    parallelism: int = 6
    active: dict[str, PipelineModel] = field(default_factory=dict, init=False)
    meta: PipelineModel | None = field(default=None, init=False)
    oof: DataFrame | None = field(default=None, init=False)

    @property
    def probability_columns(self) -> list[str]:
        return [f"p_{name}" for name in self.base_models]

    def _fit_base(self, name: str, rows: DataFrame, sell: int, buy: int) -> PipelineModel:
        ctx = FitContext(sell + buy, self.options.seed, self.features)
        return self.base_models[name](ctx).fit(_target(rows, sell, buy))

    def out_of_fold(self, train: DataFrame) -> DataFrame:
        """Buy probabilities of rows by models that never saw them.

        One row per tested row with a column per model. Where a fold trains on
        one class only, its rows get that class with certainty.
        """
        numbered = number_rows(train).withColumns(
            {c: F.col(c).cast("double") for c in self.features}
        )
        numbered = materialize(numbered, "numbered")
        bounds = materialize(fold_bounds(numbered, self.options.folds), "fold-bounds")
        counts = (
            fold_rows(numbered, bounds, "train")
            .groupBy("fold")
            .agg(
                F.count_if(F.col("label") == SELL).alias("sell"),
                F.count_if(F.col("label") == BUY).alias("buy"),
            )
            .orderBy("fold")
            .collect()
        )
        # The longest fits start first: late folds have most rows, trees are slowest.
        jobs = [
            (row["fold"], name, row["sell"], row["buy"])
            for name in reversed(self.base_models)
            for row in reversed(counts)
            if row["sell"] and row["buy"]
        ]

        def fit(job: tuple) -> tuple:
            fold, name, sell, buy = job
            rows = fold_rows(numbered, bounds.where(F.col("fold") == fold), "train")
            return (fold, name), self._fit_base(name, rows, sell, buy)

        with ThreadPoolExecutor(self.parallelism) as pool:
            fitted = dict(pool.map(fit, jobs))

        scored = []
        for row in counts:
            tested = fold_rows(numbered, bounds.where(F.col("fold") == row["fold"]), "test")
            for name in self.base_models:
                model = fitted.get((row["fold"], name))
                if model is None:
                    only = F.lit(1.0 if row["buy"] else 0.0)
                    tested = tested.withColumn(f"p_{name}", only)
                else:
                    tested = score(tested, name, model)
            scored.append(
                tested.select(SYMBOL, BAR_START, ROW, "fold", "label", *self.probability_columns)
            )
        out = scored[0]
        for part in scored[1:]:
            out = out.unionByName(part)
        return materialize(out, "oof")

    def _fit_meta(self, rows: DataFrame) -> None:
        """Logistic regression on buy probabilities; needs both classes."""
        finite = F.lit(True)
        for c in self.probability_columns:
            finite = finite & is_finite(c)
        rows = rows.where(finite)
        sell, buy = class_counts(rows)
        if not (sell and buy):
            return
        assembler = VectorAssembler(inputCols=self.probability_columns, outputCol="_meta_vector")
        pipeline = Pipeline(stages=[assembler, _logistic("meta", "_meta_vector", sell + buy)])
        self.meta = pipeline.fit(_target(rows, sell, buy))

    def _score_bases(self, df: DataFrame) -> DataFrame:
        for name, model in self.active.items():
            df = score(df, name, model)
        return df

    def fit_bases(self, train: DataFrame, names: Sequence[str] | None = None) -> None:
        """Refit on all train rows; with one class only, no model is active."""
        train = train.withColumns({c: F.col(c).cast("double") for c in self.features})
        sell, buy = class_counts(train)
        if not (sell and buy):
            return
        names = list(reversed(self.base_models)) if names is None else list(names)
        with ThreadPoolExecutor(self.parallelism) as pool:
            models = pool.map(lambda n: self._fit_base(n, train, sell, buy), names)
            fitted = dict(zip(names, models))
        self.active = {name: fitted[name] for name in self.base_models if name in fitted}

    def fit(self, train: DataFrame) -> StackingClassifier:
        """``train`` is read by every fit; pass a stored table."""
        with ThreadPoolExecutor(1) as side:
            refit = side.submit(self.fit_bases, train)
            self.oof = self.out_of_fold(train)
            refit.result()
        self._fit_meta(self.oof)
        if self.meta is None and self.active:
            self._fit_meta(self._score_bases(train))
        return self

    def predict_proba(self, df: DataFrame) -> DataFrame:
        """Add ``p_sell`` and ``p_buy``: meta model, else mean of bases, else 0.5."""
        columns = df.columns
        df = df.withColumns({c: F.col(c).cast("double") for c in self.features})
        scored = self._score_bases(df)
        bases = [f"p_{name}" for name in self.active]
        if self.meta is not None and bases:
            p_buy = score(scored, "meta", self.meta).withColumnRenamed("p_meta", "p_buy")
        else:
            mean: Column = F.lit(0.5)
            if bases:
                mean = sum((F.col(c) for c in bases[1:]), F.col(bases[0])) / len(bases)
            p_buy = scored.withColumn("p_buy", mean)
        return p_buy.select(*columns, *bases, (1 - F.col("p_buy")).alias("p_sell"), "p_buy")


def long_predictions(scored: DataFrame, models: dict[str, str]) -> DataFrame:
    """``(model, y, pred, p_buy)`` rows from one probability column per model."""
    rows = [
        F.struct(F.lit(name).alias("model"), F.col(column).alias("p_buy"))
        for name, column in models.items()
    ]
    m = F.col("_m")
    return scored.withColumn("_m", F.explode(F.array(*rows))).select(
        m["model"].alias("model"),
        F.col("label").alias("y"),
        label_from_probabilities(1 - m["p_buy"], m["p_buy"]).alias("pred"),
        m["p_buy"].alias("p_buy"),
    )


def oof_scores(oof: DataFrame, names: Sequence[str]) -> DataFrame:
    """Macro F1 and F1 per class of the out-of-fold predictions of each model."""
    rows = long_predictions(oof, {n: f"p_{n}" for n in names}).where(is_finite("p_buy"))
    macro = class_metrics(rows).select("model", "f1_macro")
    per_class = class_report(rows).groupBy("model").agg(
        F.max(F.when(F.col("label") == SELL, F.col("f1"))).alias("f1_sell"),
        F.max(F.when(F.col("label") == BUY, F.col("f1"))).alias("f1_buy"),
    )
    return macro.join(per_class, "model").orderBy(F.desc("f1_macro"), "model")


def feature_importance(model: StackingClassifier, train: DataFrame) -> DataFrame:
    """Rank, split count and share in percent per feature of the boosted trees."""
    spark = train.sparkSession
    schema = "feature string, importance long, gain double"
    boosted = model.active.get(BOOSTED)
    rows: list[tuple] = []
    if boosted is not None:
        trees = boosted.stages[-1]
        gains = trees.featureImportances.toArray()
        used = re.findall(r"If \(feature (\d+)", trees.toDebugString)
        rows = [(f, used.count(str(i)), float(gains[i])) for i, f in enumerate(model.features)]
    counts = spark.createDataFrame(rows, schema)
    everything = Window.partitionBy(F.lit(1))
    total = F.sum("importance").over(everything)
    return counts.select(
        F.row_number().over(everything.orderBy(F.desc("importance"), "feature")).alias("rank"),
        "feature",
        "importance",
        F.coalesce(100 * F.col("importance") / F.nullif(total, F.lit(0)), F.lit(0.0)).alias("pct"),
        "gain",
    )
