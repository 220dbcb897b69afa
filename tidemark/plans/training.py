"""Training sets, boosted trees, search and batch scoring."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..features.store import ETA_PREDICTION, historical_features, slice_to_load
from ..functions import haversine_km
from ..functions.ids import stable_bucket
from ..ml.cells import Cells, Held
from ..ml.grouped import fit_linear, linear_models, predict_linear, score_groups, train_groups
from ..ml.rounds import Boosted, round_errors, with_stop
from ..ml.search import Options, Range, Sampler, best_trial, choice, log_uniform, random_search, successive_halving
from ..ml.training import ETA_FEATURES, BoostedTrees, TrainedTrees, predict_with, prepare, split, validate_model
from ..operators.asof import lookup
from . import store
from .tables import latitude, longitude, sql_bucket, sql_haversine, sql_latitude, sql_longitude, table

INPUTS = ("l_quantity", "l_discount", "l_tax", "month", "flag")


def training_set(spark: SparkSession, folder: str) -> DataFrame:
    """The ETA model's inputs as of each trip: codes for categories, 0 for what is missing."""
    joined = historical_features(store._entities(spark, folder), ETA_PREDICTION, store._views(spark, folder))
    rows = prepare(joined).select("trip_id", *ETA_FEATURES)
    return rows.withColumns(
        {
            "trip_distance_km": F.round("trip_distance_km", 5),
            "driver_avg_trip_duration_7d": F.round("driver_avg_trip_duration_7d", 7),
        }
    )


TRAINING_SET_SQL = f"""
    SELECT trip_id, coalesce(trip_distance_km, 0) AS trip_distance_km,
           CASE traffic_level WHEN 'light' THEN 0 WHEN 'heavy' THEN 2 ELSE 1 END::DOUBLE AS traffic_level,
           CASE weather_condition WHEN 'fog' THEN 3 ELSE 0 END::DOUBLE AS weather_condition,
           coalesce(driver_avg_trip_duration_7d, 0) AS driver_avg_trip_duration_7d,
           CASE vehicle_type WHEN 'suv' THEN 1 WHEN 'luxury' THEN 2 ELSE 0 END::DOUBLE AS vehicle_type,
           hour_of_day::DOUBLE AS hour_of_day, day_of_week::DOUBLE AS day_of_week, is_peak_hour::DOUBLE AS is_peak_hour
    FROM ({store.PIT_SERVICE_SQL})"""


def train_split(spark: SparkSession, folder: str) -> DataFrame:
    train, test = split(table(spark, folder, "orders"), F.col("o_orderkey"))
    return train.select("o_orderkey", F.lit("train").alias("side")).unionByName(
        test.select("o_orderkey", F.lit("test").alias("side"))
    )


def _lines(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        "l_discount",
        "l_tax",
        (F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("charge"),
        F.month("l_shipdate").cast("double").alias("month"),
        (F.col("l_returnflag") == "R").cast("double").alias("flag"),
    )


def _in_validation() -> Column:
    """The rows that ``split`` takes from the training rows with seed 7."""
    return stable_bucket(F.col("l_orderkey"), 100, "7") < 20


def _trained(spark: SparkSession, folder: str, label: str = "charge") -> tuple[TrainedTrees, DataFrame, DataFrame]:
    """The model as it is deployed: depth 8, up to 200 rounds, ended by validation. Training and test rows with it."""
    train, test = split(_lines(spark, folder), F.col("l_orderkey"))
    with Cells.of_sides(train, INPUTS, label, _in_validation()) as (cells, checked):
        return BoostedTrees(INPUTS, label).fit(cells, checked), train, test


def gbt_train_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every test row with whether it got a finite prediction. The predictions themselves have no SQL form."""
    model, _, test = _trained(spark, folder)
    value = F.col("prediction")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return model.predict(test).select("l_orderkey", "l_linenumber", "l_extendedprice", finite.alias("finite"))


TEST_SQL = f"{sql_bucket('l_orderkey', 100, '42')} < 20"
GBT_SCORE_SQL = f"""
    SELECT l_orderkey, l_linenumber, l_extendedprice, true AS finite FROM lineitem WHERE {TEST_SQL}"""


def gbt_evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """The model's checks, and whether its error is below that of predicting the training mean."""
    model, train, test = _trained(spark, folder)
    mean = train.agg(F.avg("charge").alias("mean")).withColumn("k", F.lit(1))
    checked = validate_model(model.predict(test), test).withColumn("k", F.lit(1))
    metrics = model.evaluate(test).select("rmse", F.lit(1).alias("k"))
    off = F.col("charge") - F.col("mean")
    # Each side but the test rows is one row.
    by_mean = test.withColumn("k", F.lit(1)).join(F.broadcast(mean), "k").groupBy("k").agg(F.sqrt(F.avg(off * off)).alias("mean_rmse"))
    joined = by_mean.join(F.broadcast(checked), "k").join(F.broadcast(metrics), "k")
    return joined.select(
        "predictions", "finite", "valid", F.round("mean_rmse", 2).alias("mean_rmse"), (F.col("rmse") < F.col("mean_rmse")).alias("better")
    )


GBT_EVALUATE_SQL = f"""
    WITH c AS (SELECT *, l_quantity * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem),
    m AS (SELECT avg(charge) AS mean FROM c WHERE NOT {TEST_SQL})
    SELECT count(*) AS predictions, count(*) AS finite, true AS valid, round(sqrt(avg((charge - mean) ** 2)), 2) AS mean_rmse, true AS better
    FROM c, m WHERE {TEST_SQL}"""


def feature_importance(spark: SparkSession, folder: str) -> DataFrame:
    """The five features by rank, the first one's name, and the sum of all importances."""
    model, _, test = _trained(spark, folder)
    # One row per feature of the model.
    ranked = model.importance(test).agg(
        F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("less"), "feature"))).alias("features"),
        F.round(F.sum("importance"), 6).alias("total"),
    )
    rows = ranked.select(F.posexplode("features").alias("pos", "found"), "total").where("pos < 5")
    first = F.when(F.col("pos") == 0, F.col("found.feature"))
    return rows.select((F.col("pos") + 1).alias("rank"), first.alias("first"), "total")


IMPORTANCE_SQL = """
    SELECT i::INT AS rank, CASE WHEN i = 1 THEN 'l_quantity' END AS first, 1.0::DOUBLE AS total FROM generate_series(1, 5) g(i)"""


def _search(spark: SparkSession, folder: str) -> DataFrame:
    space = {"step_size": log_uniform(0.05, 0.5), "max_depth": choice([3, 4, 5, 6]), "rounds": choice([10, 20, 30])}
    return _trials(spark, folder, "charge", space)


def _trials(spark: SparkSession, folder: str, label: str, space: dict[str, Sampler]) -> DataFrame:
    """A random search over models of ``label``; the trials share the cells of the rows they train on and are held to."""
    train, test = split(_lines(spark, folder), F.col("l_orderkey"))
    with Cells.of_sides(train, INPUTS, label, _in_validation()) as (cells, checked), Held.of(test, label, cells.bins) as held:

        def fit(params: dict[str, object]) -> dict[str, float]:
            found = BoostedTrees(INPUTS, label, **params).fit(cells, checked).evaluate(held).first()
            return {"loss": found["rmse"], "mae": found["mae"]}

        return random_search(spark, fit, space)


def random_search_query(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty trials, four at a time: their number, and whether the best one's loss is the least of all."""
    trials = _search(spark, folder)
    best = best_trial(trials, "loss").select(F.col("metrics")["loss"].alias("best"), F.map_keys("params").alias("params"), F.lit(1).alias("k"))
    least = trials.agg(F.count(F.lit(1)).alias("trials"), F.min(F.col("metrics")["loss"]).alias("least"), F.lit(1).alias("k"))
    # One row each.
    return least.join(F.broadcast(best), "k").select(
        "trials", (F.col("best") == F.col("least")).alias("best_is_least"), F.concat_ws(",", F.array_sort("params")).alias("params")
    )


def group_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Price by quantity for each flag and status: least squares, the larger groups from sums, and their errors."""
    keys, inputs = ["l_returnflag", "l_linestatus"], ["l_quantity"]
    rows = table(spark, folder, "lineitem").select(*keys, "l_orderkey", "l_linenumber", *inputs, "l_extendedprice")
    fit = fit_linear(inputs, "l_extendedprice")
    models = train_groups(rows, keys, [*inputs, "l_extendedprice"], fit, linear_models(keys, inputs, "l_extendedprice"), most_rows=15_000)
    found = score_groups(rows, models, keys, inputs, predict_linear)
    errors = found.groupBy(*keys).agg(F.avg(F.abs(F.col("l_extendedprice") - F.col("prediction"))).alias("mae"), F.count("prediction").alias("scored"))
    coefficient = F.from_json(F.col("model").cast("string"), "array<double>")
    shown = models.select(*keys, "rows", F.round(coefficient[0], 4).alias("intercept"), F.round(coefficient[1], 6).alias("slope"))
    return shown.join(errors, keys).select(*keys, "rows", "intercept", "slope", F.round("mae", 4).alias("mae"), "scored")


GROUP_REGRESSION_SQL = """
    WITH m AS (SELECT l_returnflag, l_linestatus, count(*) AS "rows", regr_intercept(l_extendedprice, l_quantity) AS a, regr_slope(l_extendedprice, l_quantity) AS b
               FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, l_linestatus, any_value("rows") AS "rows", round(any_value(a), 4) AS intercept, round(any_value(b), 6) AS slope,
           round(avg(abs(l_extendedprice - (a + b * l_quantity))), 4) AS mae, count(*) AS scored
    FROM lineitem JOIN m USING (l_returnflag, l_linestatus) GROUP BY ALL"""


def batch_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """Every order as a request: latest rider features, trip distance, and a user's own model."""
    view = store._event_view(spark, folder)
    online = slice_to_load(view, None, F.lit("2024-02-01").cast("timestamp"))
    requests = table(spark, folder, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_custkey").alias("user_id"))
    looked_up = lookup(requests, online, ["user_id"], ["value"]).withColumns(
        {
            "value": F.coalesce("value", F.lit(0.0)),
            "km": haversine_km(latitude("user_id"), longitude("user_id"), latitude("trip_id"), longitude("trip_id")),
        }
    )

    def model(batch: pd.DataFrame) -> pd.Series:
        return 3.0 + 2.0 * batch["km"] + 0.5 * batch["value"]

    scored = predict_with(looked_up, ["km", "value"], model)
    return scored.select("trip_id", "user_id", F.round("prediction", 5).alias("prediction"))


BATCH_SCORING_SQL = f"""
    WITH l AS (SELECT user_id, value FROM events
               QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1)
    SELECT o_orderkey AS trip_id, o_custkey AS user_id,
           round(3.0::DOUBLE + 2.0::DOUBLE * {sql_haversine(sql_latitude("o_custkey"), sql_longitude("o_custkey"),
                 sql_latitude("o_orderkey"), sql_longitude("o_orderkey"))}
                 + 0.5::DOUBLE * coalesce(value, 0), 5) AS prediction
    FROM orders LEFT JOIN l ON o_custkey = user_id"""


# The models' own results, for the price that the table holds. They have no SQL form; the queries above check what has one.
PRICE = "l_extendedprice"


def gbt_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every test row with its price and the prediction of it."""
    model, _, test = _trained(spark, folder, PRICE)
    return model.predict(test).select("l_orderkey", "l_linenumber", PRICE, "prediction")


def gbt_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of the price's model on the test rows, beside the error of predicting the training mean."""
    model, train, test = _trained(spark, folder, PRICE)
    mean = train.agg(F.avg(PRICE).alias("mean"))
    # One row on either side.
    off = F.col(PRICE) - F.col("mean")
    by_mean = test.join(F.broadcast(mean)).agg(F.sqrt(F.avg(off * off)).alias("mean_rmse"))
    return model.evaluate(test).join(F.broadcast(by_mean))


def gbt_importances(spark: SparkSession, folder: str) -> DataFrame:
    """The features of the price's model with their importance."""
    model, _, test = _trained(spark, folder, PRICE)
    return model.importance(test)


def random_search_trials(spark: SparkSession, folder: str) -> DataFrame:
    """Twenty trials over step size and depth, up to 200 rounds each: their parameters and errors, the best one marked."""
    trials = _trials(spark, folder, PRICE, {"step_size": log_uniform(0.01, 0.3), "max_depth": choice(range(4, 9))})
    best = best_trial(trials, "loss").select("trial", F.lit(True).alias("best"))
    return trials.join(F.broadcast(best), "trial", "left").select(
        "trial", F.to_json("params").alias("params"), F.col("metrics")["loss"].alias("loss"), F.col("metrics")["mae"].alias("mae"),
        F.coalesce("best", F.lit(False)).alias("best"),
    )


def gbt_rounds(spark: SparkSession, folder: str) -> DataFrame:
    """The price model's error on the validation rows after each of 100 rounds, and where patience ends it."""
    train, _ = split(_lines(spark, folder), F.col("l_orderkey"))
    with Cells.of_sides(train, INPUTS, PRICE, _in_validation()) as (cells, checked):
        trained = BoostedTrees(INPUTS, PRICE, max_depth=5, rounds=100).fit(cells)
        return with_stop(round_errors(trained, checked))


def search_halving(spark: SparkSession, folder: str) -> DataFrame:
    """Eight trials for ten rounds, the better half of them for twenty, and so on to eighty: losses, and which are kept."""
    train, _ = split(_lines(spark, folder), F.col("l_orderkey"))
    with Cells.of_sides(train, INPUTS, PRICE, _in_validation()) as (cells, checked):

        def go_on(params: dict[str, object], before: object | None, more: int) -> tuple[Boosted, float]:
            fresh = Boosted(BoostedTrees(INPUTS, PRICE, max_depth=params["max_depth"], step_size=params["step_size"]))
            found = (before or fresh).go_on(cells, more)
            return found, found.error(checked)

        trials = successive_halving(spark, go_on, {"step_size": Range(0.01, 0.3), "max_depth": Options((3, 4, 5, 6))}, samples=8)
    return trials.withColumn("params", F.to_json("params"))


MODEL_QUERIES = {
    "gbt_rounds": gbt_rounds,
    "search_halving": search_halving,
    "gbt_predictions": gbt_predictions,
    "gbt_metrics": gbt_metrics,
    "gbt_importances": gbt_importances,
    "random_search_trials": random_search_trials,
}

QUERIES = {
    "training_set": training_set,
    "train_split": train_split,
    "gbt_train_score": gbt_train_score,
    "gbt_evaluate": gbt_evaluate,
    "feature_importance": feature_importance,
    "random_search": random_search_query,
    "group_regression": group_regression,
    "batch_scoring": batch_scoring,
}

ORACLE = {
    "gbt_train_score": GBT_SCORE_SQL,
    "gbt_evaluate": GBT_EVALUATE_SQL,
    "feature_importance": IMPORTANCE_SQL,
    "random_search": "SELECT 20::BIGINT AS trials, true AS best_is_least, 'max_depth,rounds,step_size' AS params",
    "training_set": TRAINING_SET_SQL,
    "train_split": f"""
        SELECT o_orderkey, CASE WHEN {sql_bucket("o_orderkey", 100, "42")} < 20 THEN 'test' ELSE 'train' END AS side
        FROM orders""",
    "group_regression": GROUP_REGRESSION_SQL,
    "batch_scoring": BATCH_SCORING_SQL,
}
