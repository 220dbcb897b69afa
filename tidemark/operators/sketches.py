"""Profiles and drift from sketches that are kept per day and merged, so that a window's rows are not read again.

A sketch row per day and feature holds counts, sum, extremes, a quantile sketch and a distinct sketch, up to some sixty
kilobytes whatever the day's number of rows. Each task adds its rows to sketches before the shuffle, so a large day is no large task.
A window is the merge of its days' rows. What sketches say is approximate; every such value comes with its error: that of
ranks holds with a confidence of 99 %, that of distinct counts is three standard errors. The exact way is in
:mod:`distribution` and :mod:`drift`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import band
from ..sources.writers import write_days
from .distribution import FLOOR, present

K = 2000
LG_K = 14
GRID = 500
FEATURE_THRESHOLD = 0.1


def rank_error(k: int = K) -> float:
    """How far a rank from a sketch of size ``k`` may be off, as a share of all rows, with a confidence of 99 %."""
    # The published fit for KLL sketches.
    return 2.296 / k**0.9021


def distinct_error(lg_k: int = LG_K) -> float:
    """How far a distinct count may be off, as a share of itself: three standard errors."""
    return 3 * 1.04 / (1 << lg_k) ** 0.5


def daily_sketches(df: DataFrame, ts: str, features: Sequence[str], partition: str = "ds", k: int = K, lg_k: int = LG_K) -> DataFrame:
    """One row per UTC day and numeric feature. Rows without a time have no day and are left out."""

    def of(name: str) -> Column:
        number = F.when(present(df, name), F.col(name).cast("double"))
        return F.struct(
            F.lit(name).alias("feature"),
            F.count(number).alias("rows"),
            (F.count(F.lit(1)) - F.count(number)).alias("missing"),
            F.sum(number).alias("total"),
            F.min(number).alias("least"),
            F.max(number).alias("greatest"),
            F.kll_sketch_agg_double(number, k).alias("quantiles"),
            F.hll_sketch_agg(F.when(present(df, name), F.col(name).cast("string")), lg_k).alias("distinct"),
        )

    by_day = df.where(F.col(ts).isNotNull()).groupBy(F.to_date(ts).alias(partition))
    rows = by_day.agg(F.array(*[of(name) for name in features]).alias("__rows"))
    return rows.select(partition, F.explode("__rows").alias("__row")).select(partition, "__row.*")


def write_sketches(sketches: DataFrame, root: str, partition: str = "ds") -> None:
    """Replace the days that ``sketches`` holds and no others."""
    write_days(sketches, root, partition)


def window(spark: SparkSession, root: str, first: Column, last: Column, partition: str = "ds") -> DataFrame:
    """One row per feature: the merge of the days from ``first`` to ``last``, both included. Other days are not read."""
    rows = spark.read.parquet(root).where(F.col(partition).between(first, last))
    return rows.groupBy("feature").agg(
        F.sum("rows").alias("rows"),
        F.sum("missing").alias("missing"),
        F.sum("total").alias("total"),
        F.min("least").alias("least"),
        F.max("greatest").alias("greatest"),
        # A day without a value has an empty sketch, which says nothing.
        F.kll_merge_agg_double(F.when(F.col("rows") > 0, F.col("quantiles"))).alias("quantiles"),
        F.hll_union_agg(F.when(F.col("rows") > 0, F.col("distinct"))).alias("distinct"),
    )


def _at(fractions: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(p)) for p in fractions])


def sketched_profile(merged: DataFrame, fractions: Sequence[float] = (0.25, 0.5, 0.75), k: int = K, lg_k: int = LG_K) -> DataFrame:
    """Rows, missing percent, mean and extremes, which are exact, and quantiles and distinct count with their errors."""
    some = F.col("rows") > 0
    return merged.select(
        "feature",
        "rows",
        (F.col("missing") * 100 / (F.col("rows") + F.col("missing"))).alias("missing_pct"),
        F.when(some, F.col("total") / F.col("rows")).alias("mean"),
        F.col("least").alias("min"),
        F.col("greatest").alias("max"),
        F.when(some, F.kll_sketch_get_quantile_double("quantiles", _at(fractions))).alias("quantiles"),
        F.lit(rank_error(k)).alias("rank_error"),
        F.when(some, F.hll_sketch_estimate("distinct")).otherwise(F.lit(0)).alias("unique_count"),
        F.lit(distinct_error(lg_k)).alias("unique_error"),
    )


def sketched_drift(
    reference: DataFrame, current: DataFrame, threshold: float = FEATURE_THRESHOLD, bins: int = 10, grid: int = GRID, k: int = K
) -> DataFrame:
    """Kolmogorov-Smirnov statistic and stability index per feature of two windows, from their sketches alone.

    The statistic is taken at the ``grid`` quantiles of either side. ``ks_error`` bounds what it may be off: the errors
    of both ranks, their rounding to the grid, and what the sides may do between two points of it. ``drift`` is ``yes`` or ``no`` where that
    leaves no doubt and ``unclear`` elsewhere, where the exact way is to be asked. ``psi`` has bins at the reference's
    quantiles, open at the ends, whose shares are off by ``share_error`` at most. A feature without values on one side
    has nulls and does not drift.
    """
    error = rank_error(k)
    between = 1 / grid + 2 * error

    def side(df: DataFrame, name: str) -> DataFrame:
        steps = F.kll_sketch_get_quantile_double("quantiles", _at([i / grid for i in range(1, grid + 1)]))
        return df.where("rows > 0").select("feature", F.col("rows").alias(f"{name}_rows"), steps.alias(name), F.col("quantiles").alias(f"{name}_sketch"))

    def rank(name: str, value: Column) -> Column:
        """How many steps of the grid lie at or below a value: its rank, rounded down to the grid."""
        return F.size(F.filter(name, lambda step: step <= value)) / F.lit(float(grid))

    both = side(reference, "ref").join(side(current, "cur"), "feature")
    edges = F.array_distinct(F.kll_sketch_get_quantile_double("ref_sketch", _at([i / bins for i in range(1, bins)])))
    both = both.withColumns({"__points": F.array_distinct(F.concat("ref", "cur")), "__edges": edges})
    gaps = F.transform("__points", lambda x: F.abs(rank("ref", x) - rank("cur", x)))

    def shares(name: str) -> Column:
        ranks = F.transform("__edges", lambda x: rank(name, x))
        return F.zip_with(F.concat(ranks, _at([1])), F.concat(_at([0]), ranks), lambda a, b: F.greatest(a - b, F.lit(FLOOR)))

    index = F.aggregate(F.zip_with(shares("ref"), shares("cur"), lambda p, q: (q - p) * F.log(q / p)), F.lit(0.0), lambda a, x: a + x)
    found = both.select(
        "feature", "ref_rows", "cur_rows", F.array_max(gaps).alias("ks"), F.lit(2 * error + 1 / grid + between).alias("ks_error"),
        index.alias("psi"), F.lit(2 * error + 1 / grid).alias("share_error"),
    )
    doubt = F.when(F.col("ks") - F.col("ks_error") > threshold, "yes").when(F.col("ks") + F.col("ks_error") <= threshold, "no").otherwise("unclear")
    listed = reduce(DataFrame.union, [reference.select("feature"), current.select("feature")]).distinct()
    found = listed.join(found, "feature", "left")
    return found.withColumns(
        {
            "drift": F.when(F.col("ks").isNull(), "no").otherwise(doubt),
            "psi_band": F.coalesce(band(F.col("psi"), [(0.1, "moderate"), (0.2, "significant")], "none"), F.lit("none")),
        }
    )
