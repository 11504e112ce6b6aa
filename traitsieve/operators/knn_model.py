"""Nearest neighbours as an estimator, so it can join model sets and grid searches."""

from __future__ import annotations

from pyspark.ml import Estimator, Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitsieve.operators.knn import NEIGHBOURS, knn_votes, nearest_neighbours
from traitsieve.table import FeatureTable


class _NeighbourParams(Params):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    p = Param(Params._dummy(), "p", "1 Manhattan, 2 Euclidean", TypeConverters.toInt)


class KNearest(Estimator, _NeighbourParams, DefaultParamsReadable, DefaultParamsWritable):
    """Keeps the training rows; needs ``row_id`` beside ``features`` and ``label``."""

    def __init__(self, k: int = NEIGHBOURS, weights: str = "uniform", p: int = 2):
        super().__init__()
        self._set(k=k, weights=weights, p=p)

    def _fit(self, dataset: DataFrame) -> KNearestModel:
        classes = int(dataset.agg(F.max("label")).first()[0]) + 1
        model = KNearestModel(dataset.select("row_id", "label", "features"), classes)
        return model._set(**{n: self.getOrDefault(n) for n in ("k", "weights", "p")})


class KNearestModel(Model, _NeighbourParams, MLReadable, MLWritable):
    classes = Param(Params._dummy(), "classes", "number of classes", TypeConverters.toInt)

    def __init__(self, train: DataFrame | None = None, classes: int = 2):
        super().__init__()
        self.train = train
        self._set(classes=classes, k=NEIGHBOURS, weights="uniform", p=2)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        width = len(self.train.select("features").first()[0])
        names = tuple(f"f{i}" for i in range(width))

        def table(rows: DataFrame) -> FeatureTable:
            label = F.col("label") if "label" in rows.columns else F.lit(None)
            return FeatureTable(
                rows.select(
                    "row_id",
                    label.cast("double").alias("label"),
                    vector_to_array("features").alias("values"),
                ),
                names,
            )

        near = nearest_neighbours(
            table(self.train), table(dataset), self.getOrDefault("k"), self.getOrDefault("p")
        )
        votes = knn_votes(near, self.getOrDefault("weights"))
        # At most k classes per query.
        entry = F.struct(F.col("class").cast("int"), F.col("share"))
        shares = votes.groupBy("row_id").agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
        every = F.sequence(F.lit(0), F.lit(self.getOrDefault("classes") - 1))
        share = F.transform(every, lambda c: F.round(F.coalesce(F.try_element_at("_m", c), F.lit(0.0)), 12))
        return (
            dataset.join(shares, "row_id", "left")
            .withColumn("_shares", share)
            .withColumn("probability", array_to_vector("_shares"))
            .withColumn("rawPrediction", F.col("probability"))
            .withColumn(
                "prediction",
                (F.array_position("_shares", F.array_max("_shares")) - 1).cast("double"),
            )
            .drop("_m", "_shares")
        )

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader()


class _Writer(MLWriter):
    """Parameters as metadata, training rows as Parquet beside them."""

    def __init__(self, model: KNearestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.train.write.parquet(f"{path}/train")


class _Reader(MLReader):
    def load(self, path: str) -> KNearestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KNearestModel(self.sparkSession.read.parquet(f"{path}/train"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
