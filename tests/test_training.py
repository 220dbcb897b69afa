from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tidemark.ml import search, training
from tidemark.plans.training import MODEL_QUERIES


def rows(spark, n=400):
    df = spark.range(n).select(
        "id",
        (F.col("id") % 20).cast("double").alias("a"),
        (F.col("id") % 3).cast("double").alias("b"),
    )
    return df.withColumn("y", 3 * F.col("a") + F.col("b") + 1)


def test_prepare_encodes_and_fills(spark):
    df = spark.createDataFrame([("heavy", None, "van", None), (None, "fog", "suv", 2.5)],
                               "traffic_level string, weather_condition string, vehicle_type string, km double")
    got = training.prepare(df, ["traffic_level", "weather_condition", "vehicle_type", "km"]).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0, 0.0, 0.0), (1.0, 3.0, 1.0, 2.5)]


def test_trees_learn_and_score(spark):
    train, test = training.split(rows(spark), F.col("id"))
    fit, validation = training.split(train, F.col("id"), seed=1)
    spec = training.BoostedTrees(("a", "b"), "y", max_depth=4, rounds=8, step_size=0.5)
    model = spec.fit(fit, validation)
    scored = model.predict(test)
    check = training.validate_model(scored, test).first()
    assert check.valid and check.predictions == test.count()
    metrics = model.evaluate(test).first()
    assert metrics.mae < 5 and metrics.r2 > 0.8
    top = model.importance(test, 1).collect()
    assert [r.feature for r in top] == ["a"] and "prediction" in scored.columns
    broken = scored.withColumn("prediction", F.when(F.col("id") > 5, F.col("prediction")).otherwise(float("nan")))
    assert not training.validate_model(broken, test).first().valid


def test_own_model(spark):
    got = training.predict_with(rows(spark, 10), ["a", "b"], lambda f: f["a"] * 2 + f["b"], "p")
    assert all(r.p == r.a * 2 + r.b for r in got.collect())
    again = training.predict_with(got, ["a"], lambda f: f["a"], "p")
    assert again.columns == got.columns[:-1] + ["p"]


def test_search(spark):
    space = {"rate": search.log_uniform(1e-4, 1e-2), "size": search.choice([16, 32])}
    drawn = search.draw(space, 50, 3)
    assert drawn == search.draw(space, 50, 3) != search.draw(space, 50, 4)
    assert all(1e-4 <= d["rate"] <= 1e-2 and d["size"] in (16, 32) for d in drawn)

    def train(params):
        return {"loss": spark.range(10).agg(F.sum("id")).first()[0] * params["rate"]}

    trials = search.random_search(spark, train, space, samples=5, parallel=3, seed=3)
    best = search.best_trial(trials).first()
    assert best.metrics["loss"] == pytest.approx(45 * min(d["rate"] for d in drawn[:5]))
    assert search.best_trial(trials, mode="max").first().trial != best.trial


def test_price_model_returns_its_own_results(spark):
    """The predictions themselves, for the table's price, and metrics that are those of the predictions."""
    folder = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
    got = MODEL_QUERIES["gbt_predictions"](spark, folder).toPandas()
    off = got["prediction"] - got["l_extendedprice"]
    assert len(got) and off.notna().all() and got["prediction"].nunique() > 10
    metrics = MODEL_QUERIES["gbt_metrics"](spark, folder).first()
    assert metrics.rmse == pytest.approx((off**2).mean() ** 0.5) and metrics.mae == pytest.approx(off.abs().mean())
    # No mean but their own has a smaller error than the standard deviation.
    assert metrics.mean_rmse == pytest.approx(got["l_extendedprice"].std(ddof=0), rel=0.05)
