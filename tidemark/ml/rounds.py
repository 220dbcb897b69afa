"""Boosting by rounds: the error after each one, when to stop, models cut to a round, and fits that go on."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark import SparkContext
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cells import LABEL, SPREAD, VECTOR, WEIGHT, Cells
from .training import BoostedTrees, TrainedTrees

PATIENCE = 20


def round_errors(trained: TrainedTrees, rows: DataFrame | Cells) -> DataFrame:
    """Root mean squared error after each round (from 1), in one pass over the rows' cells, which adds up the trees' results."""
    cells = rows if isinstance(rows, Cells) else Cells.of(rows, trained.spec.features, trained.spec.label, trained.bins)
    losses = trained.model.evaluateEachIteration(cells.points(), "squared")
    return cells.rows.sparkSession.createDataFrame([(i, float(x) ** 0.5) for i, x in enumerate(losses, 1)], "round int, error double")


def with_stop(errors: DataFrame, patience: int = PATIENCE) -> DataFrame:
    """Add to each round the best round so far, whether training would still run, and whether it is the one to keep.

    Training stops after ``patience`` rounds in a row without a smaller error. The rounds up to the stop are ``run``; the
    best of them, the earliest of equal ones, is ``kept``. One row per round, some hundreds at most.
    """
    order = Window.orderBy("round")
    best = F.min(F.struct("error", "round")).over(order)
    rows = errors.withColumn("best_round", best["round"])
    given_up = F.max((F.col("round") - F.col("best_round") >= patience).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("run", F.coalesce(given_up, F.lit(0)) == 0)
    last = F.max(F.when(F.col("run"), F.struct("round", "best_round"))).over(Window.partitionBy())
    return rows.withColumn("kept", F.col("round") == last["best_round"])


def cut(trained: TrainedTrees, rounds: int) -> TrainedTrees:
    """The model as it was after so many rounds."""
    java = trained.model._java_obj
    context = SparkContext.getOrCreate()
    jvm, gateway = context._jvm, context._gateway
    trees = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, rounds)
    weights = gateway.new_array(gateway.jvm.double, rounds)
    for i in range(rounds):
        trees[i], weights[i] = java.trees()[i], java.treeWeights()[i]
    made = jvm.org.apache.spark.ml.regression.GBTRegressionModel(java.uid(), trees, weights, java.numFeatures())
    made.set(made.labelCol(), LABEL)
    made.set(made.weightCol(), WEIGHT)
    model = GBTRegressionModel(made.setFeaturesCol(VECTOR))
    return TrainedTrees(trained.spec, model, trained.bins)


def fit_with_patience(spec: BoostedTrees, train: DataFrame, validation: DataFrame, patience: int = PATIENCE) -> tuple[TrainedTrees, DataFrame]:
    """The model cut to the round to keep, and the rounds with their errors on the validation rows."""
    trained = spec.fit(train)
    rounds = with_stop(round_errors(trained, validation), patience)
    kept = rounds.where("kept").first()
    return cut(trained, kept["round"]), rounds


@dataclass(frozen=True)
class Boosted:
    """A fit that can go on: models whose predictions add up, each fitted to what those before it leave."""

    spec: BoostedTrees
    parts: tuple[TrainedTrees, ...] = ()

    @property
    def rounds(self) -> int:
        return sum(part.spec.rounds for part in self.parts)

    def predict(self, df: DataFrame, column: str = "prediction") -> DataFrame:
        return self._predict_vectors(self.parts[0].bins.with_vector(df), column).drop(VECTOR) if self.parts else df.withColumn(column, F.lit(0.0))

    def _predict_vectors(self, df: DataFrame, column: str) -> DataFrame:
        names = [f"__part_{i}" for i in range(len(self.parts))]
        for part, name in zip(self.parts, names, strict=True):
            df = part.predict_vectors(df, name)
        total = sum((F.col(name) for name in names), F.lit(0.0))
        return df.withColumn(column, total).drop(*names)

    def go_on(self, train: DataFrame | Cells, rounds: int) -> Boosted:
        """Boost on by ``rounds`` from the kept trees, which are not fitted again. The first of them takes a full step.

        All parts share the first one's ranges, so that what is left of a cell's labels is left of all its rows'.
        """
        own = isinstance(train, DataFrame)
        cells = self.spec.cells(train, self.parts[0].bins if self.parts else None).persist() if own else train
        try:
            rest = self._predict_vectors(cells.rows, "__before").withColumn(LABEL, F.col(LABEL) - F.col("__before")).drop("__before")
            spec = replace(self.spec, rounds=rounds, seed=self.spec.seed + len(self.parts))
            left = Cells(cells.bins, rest).persist()
            try:
                return replace(self, parts=(*self.parts, spec.fit(left)))
            finally:
                left.unpersist()
        finally:
            if own:
                cells.unpersist()

    def error(self, df: DataFrame | Cells) -> float:
        if isinstance(df, Cells):
            off = F.col("prediction") - F.col(LABEL)
            squares = F.sum(F.col(WEIGHT) * (off * off + F.col(SPREAD) * F.col(SPREAD)))
            return self._predict_vectors(df.rows, "prediction").agg(F.sqrt(squares / F.sum(WEIGHT))).first()[0]
        off = F.col("prediction") - F.col(self.spec.label)
        return self.predict(df).agg(F.sqrt(F.avg(off * off))).first()[0]
