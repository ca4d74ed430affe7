import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array

from barloom.operators.kernel import ROWS_AT_ONCE, FourierFeatures


def test_fourier_features_are_mapped_by_batches_and_do_not_depend_on_them(spark):
    """One vectorised call a batch; the same bits for a row whatever rows are beside it."""
    x = np.random.default_rng(3).normal(size=(2 * ROWS_AT_ONCE + 7, 5))
    mapper = FourierFeatures("v", "z", 5, width=16, seed=2)

    def mapped(rows, parts):
        df = spark.createDataFrame([(i, x[i].tolist()) for i in rows], "i int, x array<double>").repartition(parts)
        out = mapper.transform(df.select("i", array_to_vector("x").alias("v")))
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "ArrowEvalPython" in plan and "lambda" not in plan
        return {r["i"]: r["z"] for r in out.select("i", vector_to_array("z").alias("z")).collect()}

    every = mapped(range(len(x)), 1)
    assert mapped(range(len(x)), 5) == every
    assert mapped([4], 1)[4] == every[4]
    want = np.cos(x @ mapper.weights.reshape(16, 5).T + mapper.offsets) * np.sqrt(2 / 16)
    np.testing.assert_allclose([every[i] for i in range(len(x))], want, atol=1e-12)
