from __future__ import annotations

import random
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import sketches as S

T0 = datetime(2024, 3, 1)


def measured(spark, n, days, shift=0.0, seed=1):
    rng = random.Random(seed)
    rows = [(T0 + timedelta(days=rng.randrange(days), minutes=rng.randrange(1440)), rng.gauss(shift, 1), rng.choice([None, float("nan"), 1, 2, 3])) for _ in range(n)]
    return rows, spark.createDataFrame([(t, x, None if y is None else float(y)) for t, x, y in rows], "ts timestamp, x double, y double")


def test_windows_are_merges_of_days(spark, tmp_path):
    """Counts, extremes and errors of a window; a day written again replaces itself, and other days are not read."""
    rows, df = measured(spark, 6000, 6)
    root = str(tmp_path)
    made = S.daily_sketches(df.union(spark.createDataFrame([(None, 99.0, 99.0)], df.schema)), "ts", ["x", "y"], k=200)
    S.write_sketches(made, root)
    S.write_sketches(made.where(F.col("ds") == F.lit(date(2024, 3, 2))), root)
    window = S.window(spark, root, F.lit(date(2024, 3, 2)), F.lit(date(2024, 3, 4)))
    assert "PartitionFilters: [isnotnull(ds" in window._jdf.queryExecution().toString()
    got = {r.feature: r for r in S.sketched_profile(window, [0.1, 0.5], k=200).collect()}
    xs = sorted(x for t, x, _ in rows if 1 <= (t - T0).days <= 3)
    ys = [y for t, _, y in rows if 1 <= (t - T0).days <= 3 and y is not None and y == y]
    assert (got["x"].rows, got["x"].min, got["x"].max, got["x"].missing_pct) == (len(xs), xs[0], xs[-1], 0)
    assert got["x"].mean == pytest.approx(np.mean(xs)) and got["y"].rows == len(ys) and got["y"].unique_count == 3
    for p, q in zip((0.1, 0.5), got["x"].quantiles, strict=True):
        assert abs(np.searchsorted(xs, q) / len(xs) - p) <= S.rank_error(200)
    assert abs(got["x"].unique_count - len(xs)) <= got["x"].unique_error * len(xs)


@pytest.mark.parametrize("shift", [0.0, 0.25, 0.6])
def test_drift_is_within_its_error(spark, tmp_path, shift):
    rows_a, a = measured(spark, 5000, 3, seed=2)
    rows_b, b = measured(spark, 4000, 3, shift, seed=3)
    sides = []
    for name, df in (("a", a), ("b", b)):
        S.write_sketches(S.daily_sketches(df, "ts", ["x"], k=800), f"{tmp_path}/{name}")
        sides.append(S.window(spark, f"{tmp_path}/{name}", F.lit(date(2024, 1, 1)), F.lit(date(2025, 1, 1))))
    got = S.sketched_drift(*sides, k=800).first()
    xs, ys = (np.sort([x for _, x, _ in rows]) for rows in (rows_a, rows_b))
    both = np.concatenate([xs, ys])
    exact = np.abs(np.searchsorted(xs, both, "right") / len(xs) - np.searchsorted(ys, both, "right") / len(ys)).max()
    assert abs(got.ks - exact) <= got.ks_error and got.ks_error < 0.04
    assert got.drift == {0.0: "no", 0.25: "unclear", 0.6: "yes"}[shift]
    edges = np.quantile(xs, np.arange(1, 10) / 10)
    p, q = (np.histogram(v, [-np.inf, *edges, np.inf])[0] / len(v) for v in (xs, ys))
    assert got.psi == pytest.approx(((q - p) * np.log(q / p)).sum(), abs=0.05)


def test_features_without_values(spark, tmp_path):
    empty = spark.createDataFrame([(T0, None, None)], "ts timestamp, x double, y double")
    S.write_sketches(S.daily_sketches(empty, "ts", ["x", "y"]), f"{tmp_path}/a")
    S.write_sketches(S.daily_sketches(measured(spark, 20, 1)[1], "ts", ["x"]), f"{tmp_path}/b")
    a, b = (S.window(spark, f"{tmp_path}/{n}", F.lit(date(2024, 1, 1)), F.lit(date(2025, 1, 1))) for n in "ab")
    assert {(r.feature, r.ks, r.drift, r.psi_band) for r in S.sketched_drift(a, b).collect()} == {("x", None, "no", "none"), ("y", None, "no", "none")}
    assert {(r.feature, r.rows, r.mean, r.unique_count, r.missing_pct) for r in S.sketched_profile(a).collect()} == {("x", 0, None, 0, 100), ("y", 0, None, 0, 100)}
