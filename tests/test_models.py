from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.ml import grouped as G
from tidemark.ml import rounds as R
from tidemark.ml import search as S
from tidemark.ml.training import BoostedTrees


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(900):
        a, b = rng.random(), rng.random()
        rows.append((i, a, b, 3 * a + math.sin(6 * b) + rng.gauss(0, 0.4)))
    return spark.createDataFrame(rows, "id long, a double, b double, y double").persist()


def test_rounds_of_a_fit_and_where_it_stops(spark, table):
    train, validation = table.where("id % 3 > 0"), table.where("id % 3 = 0")
    spec = BoostedTrees(("a", "b"), "y", max_depth=5, step_size=0.5, rounds=25, subsample=1.0, feature_share=1.0)
    model, rounds = R.fit_with_patience(spec, train, validation, patience=5)
    found = rounds.orderBy("round").collect()
    errors = [r.error for r in found]
    best = stop = None
    for i, e in enumerate(errors, 1):
        if best is None or e < errors[best - 1]:
            best = i
        if i - best >= 5:
            stop = i
            break
    assert len(errors) == 25 and stop is not None and [r.round for r in found if r.run] == list(range(1, stop + 1))
    assert [r.round for r in found if r.kept] == [best]
    assert model.model.getNumTrees == best and model.evaluate(validation).first().rmse == pytest.approx(errors[best - 1])


def test_stop_needs_patience(spark):
    def stop(errors, patience):
        rows = R.with_stop(spark.createDataFrame(list(enumerate(errors, 1)), "round int, error double"), patience).orderBy("round").collect()
        return sum(r.run for r in rows), [r.round for r in rows if r.kept]

    assert stop([3.0, 2.0, 2.0, 2.5, 1.0], 2) == (4, [2])
    assert stop([3.0, 2.0, 2.0, 2.5, 1.0], 3) == (5, [5])
    assert stop([1.0], 1) == (1, [1]) and stop([3.0, 2.0, 1.0], 1) == (3, [3])


def test_a_fit_goes_on_from_its_trees(spark, table):
    fresh = R.Boosted(BoostedTrees(("a", "b"), "y", max_depth=3, step_size=0.3, subsample=1.0, feature_share=1.0))
    some = fresh.go_on(table, 3)
    more = some.go_on(table, 4)
    assert (some.rounds, more.rounds) == (3, 7) and more.parts[0] is some.parts[0]
    assert more.error(table) < some.error(table) < table.agg(F.stddev_pop("y")).first()[0]


def test_halving_keeps_the_better_half(spark):
    """Each trial's loss falls with its rounds; what a trial went on from is what it returned before."""
    def go_on(params, before, more):
        rounds = (before or 0) + more
        return rounds, params["x"] + 1 / rounds

    found = S.successive_halving(spark, go_on, {"x": S.Range(0.1, 10)}, samples=11, grace=3, factor=2, most=30)
    rows = found.collect()
    assert sorted({(r.rung, r.rounds) for r in rows}) == [(0, 3), (1, 6), (2, 12), (3, 24)]
    alive = set(range(11))
    for rung in range(4):
        here = {r.trial: r for r in rows if r.rung == rung}
        assert set(here) == alive and all(r.loss == pytest.approx(float(r.params["x"]) + 1 / r.rounds) for r in here.values())
        ranked = sorted(here, key=lambda t: (here[t].loss, t))
        alive = set(ranked[: 1 if rung == 3 else max(1, len(ranked) // 2)])
        assert {t for t, r in here.items() if r.kept} == alive
    assert S.rungs(10, 2, 100) == [10, 20, 40, 80]


def test_a_search_that_learns_beats_chance(spark):
    def loss(params):
        return {"loss": (math.log(params["x"]) - 1) ** 2 + (0 if params["kind"] == "b" else 2)}

    space = {"x": S.Range(1e-3, 1e3), "kind": S.Options(("a", "b", "c", "d"))}
    learned, drawn = [], []
    for seed in range(4):
        learned.append(S.best_trial(S.learning_search(spark, loss, space, samples=40, startup=10, seed=seed)).first())
        drawn.append(S.best_trial(S.random_search(spark, loss, space, samples=40, seed=seed)).first())
    assert np.mean([r.metrics["loss"] for r in learned]) < np.mean([r.metrics["loss"] for r in drawn])
    assert all(r.params["kind"] == "b" for r in learned)
    again = S.learning_search(spark, loss, space, samples=12, startup=4, seed=3).collect()
    assert [r.params for r in again] == [r.params for r in S.learning_search(spark, loss, space, samples=12, startup=4, seed=3).collect()]


def test_densities_add_up():
    r = S.Range(1, 100)
    xs = np.linspace(math.log(1), math.log(100), 4001)
    assert np.trapezoid([r.density(math.exp(x), [9.0, 10.0, 11.0] * 10) for x in xs], xs) == pytest.approx(1, abs=0.02)
    assert sum(S.Options(("a", "b")).density(v, ["a", "a"]) for v in "ab") == pytest.approx(1)


def groups(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b", None]), float(i % 17), rng.choice([None, 1.0, 2.0]) if i % 50 == 0 else float(i % 5), i) for i in range(600)]
    rows = [(k, x, z, None if x is None or z is None else 2 * x - z + (1 if k == "a" else 7), i) for k, x, z, i in rows]
    return rows, spark.createDataFrame(rows, "k string, x double, z double, y double, id long")


@pytest.mark.parametrize("most_rows", [100, 1_000_000])
def test_groups_get_their_own_models(spark, most_rows):
    """With few rows to a task the larger groups are fitted from sums, and scored in parts."""
    rows, df = groups(spark)
    models = G.train_groups(df, ["k"], ["x", "z", "y"], G.fit_linear(["x", "z"], "y"), G.linear_models(["k"], ["x", "z"], "y"), most_rows)
    found = {m.k: (m.rows, G.coefficients(m.model)) for m in models.collect()}
    for k in ("a", "b", None):
        assert found[k][0] == sum(r[0] == k for r in rows)
        assert found[k][1] == pytest.approx([1 if k == "a" else 7, 2, -1], abs=1e-6)
    extra = df.union(spark.createDataFrame([("new", 1.0, 1.0, 0.0, 9999)], df.schema))
    scored = G.score_groups(extra, models, ["k"], ["x", "z"], G.predict_linear, most_rows=most_rows).collect()
    assert len(scored) == 601
    for r in scored:
        if r.k == "new" or r.z is None:
            assert r.prediction is None or math.isnan(r.prediction)
        else:
            assert r.prediction == pytest.approx(r.y, abs=1e-6)


def test_any_function_trains_and_large_groups_need_a_way(spark):
    _, df = groups(spark)
    models = G.train_groups(df, ["k"], ["x"], lambda rows: str(rows["x"].max()).encode())
    scored = G.score_groups(df, models, ["k"], ["x"], lambda model, rows: pd.Series(float(model), index=rows.index))
    assert {r.prediction for r in scored.collect()} == {16.0}
    with pytest.raises(ValueError, match="more than 10 rows"):
        G.train_groups(df, ["k"], ["x"], lambda rows: b"", most_rows=10)
