"""Drift of features and predictions between a reference and a current table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .distribution import (
    CATEGORICAL_BELOW,
    chi_squared,
    is_comparable,
    is_large,
    is_whole,
    ks_exact_p_value,
    ks_p_value,
    ks_statistic,
    present,
    profile,
    side_counts,
    side_totals,
)

FEATURE_THRESHOLD = 0.1
PREDICTION_THRESHOLD = 0.15


def feature_drift(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    threshold: float = FEATURE_THRESHOLD,
    categorical_below: int = CATEGORICAL_BELOW,
) -> DataFrame:
    """One row per reference feature: the test used, its score and whether it drifted.

    Text features, and features with fewer than ``categorical_below`` distinct
    reference values, are compared by chi-squared, others by Kolmogorov-Smirnov.
    Days and times count as numbers; long ids and times are compared as whole
    numbers, without rounding. A feature without values on one side scores 0. A
    feature that the current table lacks, or whose type cannot be compared (nested
    and binary values, or text on one side only), is listed with ``checked`` false.
    """
    features = list(features or reference.columns)

    def comparable(f: str) -> bool:
        if f not in current.columns:
            return False
        kinds = [df.schema[f].dataType for df in (reference, current)]
        return all(map(is_comparable, kinds)) and len({isinstance(k, T.StringType) for k in kinds}) == 1

    shared = [f for f in features if comparable(f)]
    text = [f for f in shared if isinstance(reference.schema[f].dataType, T.StringType)]
    whole = [f for f in shared if f not in text and all(is_whole(df.schema[f].dataType) for df in (reference, current))]
    numeric = [f for f in shared if f not in text and f not in whole]

    scored = []
    large = is_large(reference, current) if numeric or whole else False
    for names, as_whole in ((numeric, False), (whole, True)):
        if not names:
            continue
        counts = side_counts(reference, current, names, whole=as_whole)
        scored.append(
            side_totals(counts)
            .join(F.broadcast(ks_statistic(counts, large).select("feature", "ks")), "feature", "left")
            .join(F.broadcast(chi_squared(counts)), "feature", "left")
            .withColumn("categorical", F.col("ref_distinct") < categorical_below)
        )
    if text:
        counts = side_counts(reference, current, text, as_text=True)
        scored.append(
            side_totals(counts)
            .join(F.broadcast(chi_squared(counts)), "feature", "left")
            .withColumns({"ks": F.lit(None).cast("double"), "categorical": F.lit(True)})
        )
    listed = F.array(
        *[F.struct(F.lit(f).alias("feature"), F.lit(f in shared).alias("checked")) for f in features]
    )
    names = reference.sparkSession.range(1).select(F.explode(listed).alias("f")).select("f.*")
    if not scored:
        return names.select(
            "feature",
            "checked",
            F.lit(None).cast("string").alias("method"),
            F.lit(0.0).alias("score"),
            F.lit(False).alias("drifted"),
        )
    results = reduce(lambda a, b: a.unionByName(b), scored)
    score = F.coalesce(F.when(F.col("categorical"), F.col("chi2")).otherwise(F.col("ks")), F.lit(0.0))
    return (
        names.join(F.broadcast(results), "feature", "left")
        .withColumn("method", F.when(F.col("categorical"), "chi_squared").when(~F.col("categorical"), "ks"))
        .withColumn("score", score)
        .select("feature", "checked", "method", "score", (F.col("score") > threshold).alias("drifted"))
    )


def drift_summary(drift: DataFrame) -> DataFrame:
    """Dataset drift: flag, drifted features, their number and percent of all features."""
    drifted = F.count_if("drifted")
    return drift.agg(
        F.coalesce(F.bool_or("drifted"), F.lit(False)).alias("dataset_drift"),
        drifted.alias("num_drifted_features"),
        F.count_if("checked").alias("num_checked"),
        (drifted / F.count(F.lit(1)) * 100).alias("drift_percentage"),
        F.array_sort(F.collect_list(F.when(F.col("drifted"), F.col("feature")))).alias("drifted_features"),
    )


def detailed_report(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str] | None = None,
    threshold: float = FEATURE_THRESHOLD,
    exact_distinct: bool = True,
) -> DataFrame:
    """Feature drift with the profile of both sides next to it."""
    features = list(features or reference.columns)
    report = feature_drift(reference, current, features, threshold)
    sides = (("ref", reference), ("cur", current))
    for prefix, df in sides:
        shared = [f for f in features if f in df.columns]
        stats = profile(df, shared, exact_distinct)
        renamed = stats.select("feature", *[F.col(c).alias(f"{prefix}_{c}") for c in stats.columns if c != "feature"])
        report = report.join(F.broadcast(renamed), "feature", "left")
    return report


def prediction_drift(
    reference: DataFrame | None,
    current: DataFrame,
    column: str,
    model_name: str,
    threshold: float = PREDICTION_THRESHOLD,
    exact_up_to: int = 0,
) -> DataFrame:
    """One row: statistic, p-value, means and population deviations of both sides, and a message if it has none.

    The p-value is the asymptotic one; up to ``exact_up_to`` pairs of rows of the two sides it is exact. NaN counts as missing. Where a side is absent or has no values there is no
    statistic and no drift, and the message says which.
    """
    p_value = ks_exact_p_value(F.col("ks"), F.col("ref_rows"), F.col("cur_rows"), exact_up_to) if exact_up_to else ks_p_value(
        F.col("ks"), F.col("ref_rows"), F.col("cur_rows")
    )
    measured = [
        F.lit(model_name).alias("model_name"),
        F.coalesce(F.col("ks") > threshold, F.lit(False)).alias("drift_detected"),
        F.col("ks").alias("drift_score"),
        F.when(F.col("ks").isNotNull(), p_value).alias("p_value"),
        "reference_mean",
        "current_mean",
        "reference_std",
        "current_std",
        F.when(F.col("reference_mean").isNull(), "No reference data")
        .when(F.col("current_mean").isNull(), "No current data")
        .alias("message"),
    ]

    def moments(df: DataFrame, side: str) -> DataFrame:
        value = F.when(present(df, column), F.col(column).cast("double"))
        return df.agg(
            F.lit(column).alias("feature"),
            F.avg(value).alias(f"{side}_mean"),
            F.stddev_pop(value).alias(f"{side}_std"),
        )

    known = current.limit(0) if reference is None else reference
    large = False if reference is None else is_large(reference, current)
    statistic = ks_statistic(side_counts(known, current, [column]), large)
    # One row each.
    return (
        moments(known, "reference")
        .join(F.broadcast(moments(current, "current")), "feature")
        .join(F.broadcast(statistic), "feature", "left")
        .select(*measured)
    )


def retraining_requests(summary: DataFrame, model_name: str, requested_at: Column) -> DataFrame:
    """A row to append to the request table if the dataset drifted, else none."""
    return summary.where("dataset_drift").select(
        F.lit(model_name).alias("model_name"),
        requested_at.alias("requested_at"),
        "num_drifted_features",
        "drift_percentage",
        "drifted_features",
    )
