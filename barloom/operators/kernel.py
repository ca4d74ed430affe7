"""Random Fourier features for the Gaussian kernel (Rahimi and Recht, 2007)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS_AT_ONCE = 256


class FourierFeatures(Transformer, HasInputCol, HasOutputCol):
    """Map x to sqrt(2/D) * cos(w.x + b), whose inner products approximate the kernel.

    The draws of ``w`` and ``b`` come from the seed on the driver and travel with
    the function. ``gamma`` is 1/d, right for standardised inputs.
    """

    def __init__(self, input_col: str, output_col: str, dimension: int, width: int = 128, seed: int = 42):
        super().__init__()
        self._set(inputCol=input_col, outputCol=output_col)
        rng = np.random.default_rng(seed)
        self.dimension, self.width = dimension, width
        self.weights = rng.normal(0.0, np.sqrt(2.0 / dimension), width * dimension)
        self.offsets = rng.uniform(0.0, 2.0 * np.pi, width)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        d, width, scale = self.dimension, self.width, float(np.sqrt(2.0 / self.width))
        weights, offsets = self.weights.reshape(width, d).T.copy(), self.offsets

        # Whole batches, a few rows at a time; a row's products are added in the order of x, so its result is the same in any batch.
        @F.arrow_udf("array<double>")
        def mapped(vectors: pa.Array) -> pa.Array:
            x = vectors.flatten().to_numpy(zero_copy_only=False).reshape(len(vectors), d)
            out = np.zeros((len(x), width))
            for at in range(0, len(x), ROWS_AT_ONCE):
                piece, rows = out[at : at + ROWS_AT_ONCE], x[at : at + ROWS_AT_ONCE]
                for j in range(d):
                    piece += rows[:, j : j + 1] * weights[j]
                piece += offsets
                np.cos(piece, out=piece)
                piece *= scale
            ends = np.arange(0, out.size + 1, width, dtype=np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel()))

        return dataset.withColumn(self.getOutputCol(), array_to_vector(mapped(vector_to_array(self.getInputCol()))))
