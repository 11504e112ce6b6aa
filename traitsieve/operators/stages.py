"""Pipeline stages around a classifier: raw values to features, codes to label names."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators.prep import fitted_figures
from traitsieve.table import FeatureTable, missing_to_null


class PreparedFeatures(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """``values`` with holes to ``features``: choose, fill, centre and scale.

    Three numbers per feature; rows that have ``features`` already stay as they are.
    """

    figures = Param(Params._dummy(), "figures", "index, fill, mean, spread per feature, as JSON", TypeConverters.toString)

    def __init__(self, figures: str = "[]"):
        super().__init__()
        self._set(figures=figures)

    @classmethod
    def fitted(cls, table: FeatureTable, missing: str = "mean", scale: bool = True) -> PreparedFeatures:
        rows = [
            [i, s["fill"], s["mean"] if scale else 0.0, s["spread"] if scale else 1.0]
            for i, s in enumerate(fitted_figures(table, missing))
        ]
        return cls(json.dumps(rows))

    def chosen(self, indices: Sequence[int]) -> PreparedFeatures:
        rows = json.loads(self.getOrDefault("figures"))
        return PreparedFeatures(json.dumps([rows[i] for i in indices]))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if "features" in dataset.columns:
            return dataset
        index, fill, mean, spread = (list(c) for c in zip(*json.loads(self.getOrDefault("figures"))))
        figures = F.arrays_zip(
            *[F.lit(v).alias(n) for n, v in (("i", index), ("fill", fill), ("mean", mean), ("spread", spread))]
        )
        value = lambda s: F.coalesce(missing_to_null(F.get(F.col("values"), s["i"])), s["fill"])
        return dataset.withColumn(
            "features", array_to_vector(F.transform(figures, lambda s: (value(s) - s["mean"]) / s["spread"]))
        )


class LabelNames(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Adds ``predicted_label``, the label whose code is the prediction."""

    classes = Param(Params._dummy(), "classes", "labels in the order of their codes, as JSON", TypeConverters.toString)
    kind = Param(Params._dummy(), "kind", "type of the label", TypeConverters.toString)

    def __init__(self, classes: str = "[]", kind: str = "string"):
        super().__init__()
        self._set(classes=classes, kind=kind)

    @classmethod
    def fitted(cls, df: DataFrame, label: str = "label") -> LabelNames:
        rows = df.select(label).distinct().where(F.col(label).isNotNull()).orderBy(label).collect()
        return cls(json.dumps([str(r[0]) for r in rows]), dict(df.dtypes)[label])

    def _transform(self, dataset: DataFrame) -> DataFrame:
        names = F.lit(json.loads(self.getOrDefault("classes")))
        return dataset.withColumn(
            "predicted_label", F.get(names, F.col("prediction").cast("int")).cast(self.getOrDefault("kind"))
        )
