"""Random Fourier features for the RBF kernel (Rahimi & Recht 2007)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class FourierFeatures(
    Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable
):
    """Maps x to sqrt(2/D) cos(Wx + b), whose dot products approach exp(-gamma |x-y|^2)."""

    components = Param(Params._dummy(), "components", "output size", TypeConverters.toInt)
    width = Param(Params._dummy(), "width", "input size", TypeConverters.toInt)
    gamma = Param(Params._dummy(), "gamma", "kernel width", TypeConverters.toFloat)
    seed = Param(Params._dummy(), "seed", "random seed", TypeConverters.toInt)

    def __init__(
        self, inputCol: str = "features", outputCol: str = "lifted", components: int = 1024,
        width: int = 1, gamma: float = 1.0, seed: int = 42,
    ):
        super().__init__()
        self._set(
            inputCol=inputCol, outputCol=outputCol, components=components, width=width,
            gamma=gamma, seed=seed,
        )

    def _transform(self, dataset: DataFrame) -> DataFrame:
        size, width = self.getOrDefault("components"), self.getOrDefault("width")
        rng = np.random.default_rng(self.getOrDefault("seed"))
        directions = rng.normal(0.0, np.sqrt(2 * self.getOrDefault("gamma")), (width, size))
        phases = rng.uniform(0.0, 2 * np.pi, size)
        scale = np.sqrt(2.0 / size)

        @F.arrow_udf("array<double>")
        def lift(values: pa.Array) -> pa.Array:
            # one matrix of the batch, worked on in place and handed on without a copy
            x = values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), width)
            z = x @ directions
            z += phases
            np.cos(z, out=z)
            z *= scale
            ends = pa.array(np.arange(len(z) + 1, dtype=np.int32) * size)
            return pa.ListArray.from_arrays(ends, pa.array(z.ravel()))

        return dataset.withColumn(
            self.getOutputCol(), array_to_vector(lift(vector_to_array(self.getInputCol())))
        )
