from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.ml import rounds as R
from tidemark.ml.cells import LABEL, SPREAD, WEIGHT, Bins, Cells, Held
from tidemark.ml.training import BoostedTrees

SPEC = BoostedTrees(("a", "b"), "y", max_depth=3, rounds=4, step_size=0.5, subsample=1.0, feature_share=1.0)


def rows(spark, n):
    """Two features of few values, some missing (in the last range), and labels that differ among rows of the same features."""
    df = spark.range(n).select("id", (F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 5).cast("double")).alias("b"))
    return df.withColumn("y", 3 * F.col("a") + F.coalesce("b", F.lit(9.0)) + F.col("id") % 11)


def test_more_rows_train_on_as_many_cells(spark):
    small, large = (Cells.of(rows(spark, n), SPEC.features, "y") for n in (400, 8000))
    assert small.rows.count() == large.rows.count() == 28
    assert large.rows.agg(F.sum(WEIGHT)).first()[0] == 8000
    # In pieces they are bounded too.
    assert Cells.of(rows(spark, 40000), SPEC.features, "y", sampled=True).rows.count() <= 28 * 256


def test_cells_have_the_rows_errors(spark):
    df = rows(spark, 900)
    train, held_out = df.where("id % 3 > 0"), df.where("id % 3 = 0")
    with Cells.of_sides(df, SPEC.features, "y", F.col("id") % 3 == 0) as (cells, checked):
        assert cells.rows.agg(F.sum(WEIGHT)).first()[0] == 600 and checked.rows.agg(F.sum(WEIGHT)).first()[0] == 300
        model = SPEC.fit(cells)
        errors = [r.error for r in R.round_errors(model, checked).orderBy("round").collect()]
        found = model.evaluate(held_out).first()
        assert errors[-1] == pytest.approx(found.rmse) and errors == pytest.approx([r.error for r in R.round_errors(model, held_out).orderBy("round").collect()])
        with Held.of(held_out, "y", cells.bins) as held:
            assert tuple(model.evaluate(held).first()) == pytest.approx(tuple(found))
        boosted = R.Boosted(SPEC).go_on(cells, 2).go_on(cells, 2)
        assert boosted.error(checked) == pytest.approx(boosted.error(held_out))
    # Rows that are each their own cell train the same trees as their cells do.
    assert SPEC.fit(train).evaluate(held_out).first().rmse == pytest.approx(found.rmse)


def test_ranges_of_many_values_and_missing_ones(spark):
    df = spark.createDataFrame([(float(i) if i else None, float(i % 3)) for i in range(1000)] + [(float("nan"), None)], "a double, b double")
    bins = Bins.of(df, ("a", "b"))
    assert len(bins.cuts[0]) == 31 and bins.cuts[1] == (0.5, 1.5)
    got = df.select("*", *bins.numbers()).collect()
    assert all((r["__bin_0"], r["__bin_1"]) == ((31, 2) if r.b is None else (31 if r.a is None else sum(r.a > c for c in bins.cuts[0]), r.b)) for r in got)


def test_a_missing_label_is_refused(spark):
    df = rows(spark, 60).withColumn("y", F.when(F.col("id") != 5, F.col("y")))
    assert Cells.of(df, SPEC.features, "y").rows.where(F.col(LABEL).isNull() & F.col(SPREAD).isNotNull()).count() == 1
    with pytest.raises(Exception, match="(?i)label"):
        SPEC.fit(df)
