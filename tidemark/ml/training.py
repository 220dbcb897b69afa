"""Training-set preparation, boosted-tree regression and batch scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ids import stable_bucket
from ..functions.values import (
    TRAFFIC_CODES,
    TRAFFIC_DEFAULT,
    VEHICLE_CODES,
    VEHICLE_DEFAULT,
    WEATHER_CODES,
    WEATHER_DEFAULT,
    ordinal,
)
from ..operators.evaluation import regression_metrics
from ..session import shared_dir
from .cells import LABEL, SPREAD, VECTOR, WEIGHT, Bins, Cells, Held

# The model inputs in order.
ETA_FEATURES = (
    "trip_distance_km",
    "traffic_level",
    "weather_condition",
    "driver_avg_trip_duration_7d",
    "vehicle_type",
    "hour_of_day",
    "day_of_week",
    "is_peak_hour",
)


def encode_categories(df: DataFrame) -> DataFrame:
    """Traffic, weather and vehicle text as codes, where the columns are present."""
    encoded = {
        "traffic_level": ordinal(F.col("traffic_level"), TRAFFIC_CODES, TRAFFIC_DEFAULT),
        "weather_condition": ordinal(F.col("weather_condition"), WEATHER_CODES, WEATHER_DEFAULT),
        "vehicle_type": ordinal(F.col("vehicle_type"), VEHICLE_CODES, VEHICLE_DEFAULT),
    }
    return df.withColumns({name: c for name, c in encoded.items() if name in df.columns})


def prepare(df: DataFrame, features: Sequence[str] = ETA_FEATURES) -> DataFrame:
    """Encode categories and fill missing feature values with 0."""
    encoded = encode_categories(df)
    return encoded.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(0.0)) for f in features})


def split(df: DataFrame, key: Column, test_percent: int = 20, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Training and test rows by a hash of the key.

    Unlike a random split, a row falls on the same side in every run, however
    the data is partitioned, and rows of one key stay together.
    """
    in_test = stable_bucket(key, 100, str(seed)) < test_percent
    return df.where(~in_test), df.where(in_test)


@dataclass(frozen=True)
class BoostedTrees:
    """Parameters of a regression; training stops early when validation stops improving.

    Trees are trained on the cells of the rows, see :mod:`.cells`: a round's cost does not grow with the rows.
    """

    features: tuple[str, ...]
    label: str
    max_depth: int = 8
    step_size: float = 0.1
    rounds: int = 200
    subsample: float = 0.8
    feature_share: float = 0.8
    tolerance: float = 0.01
    seed: int = 42

    def cells(self, train: DataFrame, bins: Bins | None = None) -> Cells:
        """The rows as :meth:`fit` takes them, to be kept where several fits use them."""
        return Cells.of(train, self.features, self.label, bins, sampled=self.subsample < 1)

    def fit(self, train: DataFrame | Cells, validation: DataFrame | Cells | None = None) -> TrainedTrees:
        made = []
        if isinstance(train, DataFrame):
            train = self.cells(train).persist()
            made.append(train)
        if isinstance(validation, DataFrame):
            validation = Cells.of(validation, self.features, self.label, train.bins).persist()
            made.append(validation)
        try:
            return self._fit(train, validation)
        finally:
            for cells in made:
                cells.unpersist()

    def _fit(self, train: Cells, validation: Cells | None) -> TrainedTrees:
        context = train.rows.sparkSession.sparkContext
        if not context.getCheckpointDir():
            # Many rounds would else grow the lineage without end.
            context.setCheckpointDir(shared_dir(train.rows.sparkSession, "trees"))
        rows = train.rows.drop(SPREAD).withColumn("__validation", F.lit(False))
        if validation is not None:
            rows = rows.unionByName(validation.points().withColumn("__validation", F.lit(True)))
        estimator = GBTRegressor(
            featuresCol=VECTOR,
            labelCol=LABEL,
            weightCol=WEIGHT,
            maxDepth=self.max_depth,
            stepSize=self.step_size,
            maxIter=self.rounds,
            subsamplingRate=self.subsample,
            featureSubsetStrategy=str(self.feature_share),
            validationTol=self.tolerance,
            checkpointInterval=10,
            seed=self.seed,
        )
        if validation is not None:
            estimator = estimator.setValidationIndicatorCol("__validation")
        return TrainedTrees(self, estimator.fit(rows), train.bins)


@dataclass(frozen=True)
class TrainedTrees:
    spec: BoostedTrees
    model: GBTRegressionModel
    bins: Bins

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return self.predict_vectors(self.bins.with_vector(df), column).drop(VECTOR)

    def predict_vectors(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        """Predictions for rows that have the vector of their ranges."""
        return self.model.setPredictionCol(column).transform(df)

    def evaluate(self, df: DataFrame | Held) -> DataFrame:
        if isinstance(df, Held):
            predicted = df.rows.join(self.predict_vectors(df.cells).drop(VECTOR), self.bins.names)
        else:
            predicted = self.predict(df)
        return regression_metrics(predicted, self.spec.label, "prediction")

    def importance(self, df: DataFrame, top: int | None = None) -> DataFrame:
        """Features by importance, greatest first. One row per feature."""
        weights = self.model.featureImportances.toArray().tolist()
        rows = list(zip(self.spec.features, weights, strict=True))
        table = df.sparkSession.createDataFrame(rows, "feature string, importance double")
        ordered = table.orderBy(F.desc("importance"), "feature")
        return ordered if top is None else ordered.limit(top)


def validate_model(predictions: DataFrame, expected: DataFrame, column: str = "prediction") -> DataFrame:
    """One row: every input row has a prediction and every prediction is finite."""
    value = F.col(column).cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf"))
    rows = expected.agg(F.count(F.lit(1))).scalar()
    return predictions.agg(
        F.count(F.lit(1)).alias("predictions"),
        F.count_if(finite).alias("finite"),
        rows.alias("rows"),
    ).withColumn("valid", (F.col("predictions") == F.col("rows")) & (F.col("finite") == F.col("rows")))


def predict_with(
    df: DataFrame, features: Sequence[str], predict: Callable[[pd.DataFrame], Sequence[float]], column: str = "prediction"
) -> DataFrame:
    """Score with any function from a frame of features to predictions, in Arrow batches."""
    kept = [f for f in df.schema.fields if f.name != column]
    schema = T.StructType([*kept, T.StructField(column, T.DoubleType())])
    names = list(features)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            batch[column] = predict(batch[names])
            yield batch[schema.names]

    return df.mapInPandas(score, schema)
