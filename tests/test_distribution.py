"""Distribution statistics against numpy on small tables."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import distribution as D
from tidemark.operators import drift


def column(spark, values, name="x"):
    kind = "string" if any(isinstance(v, str) for v in values) else "double"
    values = [v if v is None or kind == "string" else float(v) for v in values]
    return spark.createDataFrame([(v,) for v in values], f"{name} {kind}")


def one(df, name):
    return df.collect()[0][name]


def ks(a, b):
    pooled = np.sort(np.concatenate([a, b]))
    fa = np.searchsorted(np.sort(a), pooled, side="right") / len(a)
    fb = np.searchsorted(np.sort(b), pooled, side="right") / len(b)
    return np.abs(fa - fb).max()


@pytest.mark.parametrize("large", [True, False])
@pytest.mark.parametrize("shift, digits", [(0.0, 6), (0.5, 1), (50, 6)])
def test_ks(spark, shift, digits, large):
    rng = np.random.default_rng(7)
    a, b = rng.normal(0, 1, 900).round(digits), rng.normal(shift, 1.3, 700).round(digits)
    counts = D.side_counts(column(spark, a), column(spark, b), ["x"])
    assert one(D.ks_statistic(counts, large), "ks") == pytest.approx(ks(a, b))


def test_ks_of_a_table_with_itself_is_zero_and_nan_is_missing(spark):
    df = column(spark, [1, 2, 2, 3, None, math.nan])
    row = D.ks_statistic(D.side_counts(df, df, ["x"])).collect()[0]
    assert (row.ks, row.ref_rows, row.cur_rows) == (0.0, 4, 4)


@pytest.mark.parametrize("large", [True, False])
def test_exact_quantiles(spark, large):
    rng = np.random.default_rng(8)
    for values in (rng.lognormal(3, 2, 800).round(1), np.array([5.0] * 4), np.array([1.0, 2.0])):
        counts = D.side_counts(column(spark, values), column(spark, values), ["x"])
        grid = np.linspace(0, 1, 11)
        got = one(D.exact_quantiles(counts, list(grid), large=large), "quantiles")
        assert got == pytest.approx(list(np.percentile(values, grid * 100)))


def psi(a, b, buckets=10):
    edges = np.unique(np.percentile(a, np.linspace(0, 100, buckets + 1)))
    place = lambda v: np.clip(np.searchsorted(edges, v, side="left"), 1, None)
    inside = b[(b >= edges[0]) & (b <= edges[-1])]
    p = np.array([(place(a) == i).mean() for i in range(1, len(edges))])
    q = np.array([(place(inside) == i).mean() if len(inside) else 0 for i in range(1, len(edges))])
    p, q = np.maximum(p, 0.001), np.maximum(q, 0.001)
    return ((q - p) * np.log(q / p)).sum()


@pytest.mark.parametrize("large", [True, False])
def test_psi(spark, large):
    rng = np.random.default_rng(9)
    a, b = rng.normal(0, 1, 1000), rng.normal(0.5, 1, 1000)
    row = D.psi(column(spark, a), column(spark, b), ["x"], large=large).collect()[0]
    assert row.psi == pytest.approx(psi(a, b)) and row.psi > 0
    assert row.out_of_range == pytest.approx(((b < a.min()) | (b > a.max())).mean())
    assert row.psi_band == "significant"
    same = D.psi(column(spark, a), column(spark, a), ["x"], large=large).collect()[0]
    assert same.psi == pytest.approx(0) and same.psi_band == "none"


def test_psi_edges(spark):
    constant = D.psi(column(spark, [3, 3, 3]), column(spark, [3, 4, 5]), ["x"]).collect()[0]
    assert constant.psi == 0
    spread = column(spark, range(100))
    empty_bin = D.psi(spread, column(spark, [1, 1, 2, None]), ["x"]).collect()[0]
    assert math.isfinite(empty_bin.psi) and empty_bin.psi > 1
    outside = column(spark, [500, 600])
    assert D.psi(spread, outside, ["x"]).collect()[0].out_of_range == 1.0
    assert D.psi(spread, outside, ["x"], open_ends=True).collect()[0].out_of_range == 0.0
    assert D.psi(spread, spread, ["x"], approximate=True).collect()[0].psi == pytest.approx(0)


def test_chi_squared_and_js(spark):
    a, b = column(spark, list("aaab")), column(spark, list("aabb"))
    counts = D.side_counts(a, b, ["x"], as_text=True)
    assert one(D.chi_squared(counts), "chi2") == pytest.approx(0.25**2 / 0.75 + 0.25**2 / 0.25, rel=1e-6)
    new = D.side_counts(a, column(spark, list("ccc")), ["x"], as_text=True)
    assert one(D.chi_squared(new), "chi2") == 1.0
    assert one(D.jensen_shannon(new), "js") == pytest.approx(1.0)
    same = D.side_counts(a, a, ["x"], as_text=True)
    assert one(D.jensen_shannon(same), "js") == 0.0


def test_profile(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, None), (None, "a"), (3.0, "b")], "x double, s string")
    for exact in (True, False):
        rows = {r.feature: r for r in D.profile(df, exact_distinct=exact).collect()}
        x, s = rows["x"], rows["s"]
        assert (x["mean"], x["min"], x["max"], x["missing_pct"], x["unique_count"]) == (
            pytest.approx(7 / 3), 1.0, 3.0, 25.0, 2)
        assert x["std"] == pytest.approx(np.std([1, 3, 3], ddof=1))
        assert (s["mean"], s["std"], s["missing_pct"], s["unique_count"]) == (None, None, 25.0, 2)


def sample(spark, seed, shift=0.0, rows=100):
    rng = np.random.default_rng(seed)
    data = zip(rng.normal(shift, 1, rows).tolist(), rng.normal(0, 1, rows).tolist(),
               rng.choice(list("abc"), rows).tolist(), strict=True)
    return spark.createDataFrame(list(data), "feature_1 double, feature_2 double, feature_3 string")


def test_same_data_has_no_drift(spark):
    df = sample(spark, 1)
    row = drift.drift_summary(drift.feature_drift(df, df)).collect()[0]
    assert (row.dataset_drift, row.num_drifted_features, row.drifted_features) == (False, 0, [])


def test_shifted_feature_is_found(spark):
    report = drift.feature_drift(sample(spark, 1, rows=400), sample(spark, 1, shift=5, rows=400).drop("feature_2"))
    rows = {r.feature: r for r in report.collect()}
    assert rows["feature_1"].drifted and rows["feature_1"].method == "ks"
    assert rows["feature_3"].method == "chi_squared" and not rows["feature_3"].drifted
    assert not rows["feature_2"].checked and rows["feature_2"].score == 0.0
    row = drift.drift_summary(report).collect()[0]
    assert row.drifted_features == ["feature_1"] and row.num_checked == 2
    assert row.drift_percentage == pytest.approx(100 / 3)
    request = drift.retraining_requests(drift.drift_summary(report), "m", F.lit("2024-01-01").cast("timestamp"))
    assert request.collect()[0].model_name == "m"


@pytest.mark.parametrize("distinct, method", [(9, "chi_squared"), (10, "ks")])
def test_choice_of_test(spark, distinct, method):
    df = column(spark, list(range(distinct)) * 3)
    assert one(drift.feature_drift(df, df), "method") == method


def test_empty_side_scores_zero(spark):
    full, empty = column(spark, range(20)), column(spark, [None, None])
    row = drift.feature_drift(full, empty).collect()[0]
    assert (row.score, row.drifted) == (0.0, False)


def test_prediction_drift(spark):
    rng = np.random.default_rng(3)
    a, b = rng.normal(10, 2, 500), rng.normal(11, 2, 500)
    row = drift.prediction_drift(column(spark, a), column(spark, b), "x", "eta").collect()[0]
    assert row.drift_score == pytest.approx(ks(a, b)) and row.drift_detected
    assert row.reference_std == pytest.approx(a.std()) and 0 <= row.p_value < 0.001
    same = drift.prediction_drift(column(spark, a), column(spark, a), "x", "eta").collect()[0]
    assert same.p_value == pytest.approx(1.0)
    none = drift.prediction_drift(None, column(spark, a), "x", "eta").collect()[0]
    assert (none.drift_detected, none.message) == (False, "No reference data")


@pytest.mark.parametrize(("n", "m"), [(1, 1), (3, 5), (4, 4), (7, 2), (6, 9)])
def test_exact_p_value_counts_all_orders(spark, n, m):
    """Against all ways in which two samples can lie among each other."""
    from itertools import combinations
    from math import comb

    found = {}
    for places in combinations(range(n + m), n):
        i = j = 0
        worst = 0
        for k in range(n + m):
            i, j = (i + 1, j) if k in places else (i, j + 1)
            worst = max(worst, abs(i * m - j * n))
        found[worst] = found.get(worst, 0) + 1
    rows = [(h / (n * m), n, m, sum(c for w, c in found.items() if w >= h) / comb(n + m, n)) for h in [0, *found]]
    df = spark.createDataFrame(rows, "ks double, n long, m long, want double")
    for r in df.select("want", D.ks_exact_p_value(F.col("ks"), F.col("n"), F.col("m")).alias("p")).collect():
        assert r.p == pytest.approx(r.want, abs=1e-12)


def test_exact_p_value_gives_way_to_the_series(spark):
    df = spark.createDataFrame([(0.2, 40, 50), (0.05, 900, 800)], "ks double, n long, m long")
    args = [F.col(c) for c in ("ks", "n", "m")]
    small, large = df.select(D.ks_exact_p_value(*args, 10_000).alias("p"), D.ks_p_value(*args).alias("q")).collect()
    assert large.p == large.q and small.p != small.q and small.p == pytest.approx(small.q, abs=0.1)
