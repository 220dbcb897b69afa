"""Regression metrics and fairness measures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_MAE = 5.0
MIN_PARITY = 0.8


def regression_metrics(df: DataFrame, label: str, prediction: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R2 and MAPE percent in one aggregation; rows with a null are left out.

    Labels of 0 have no relative error and are left out of MAPE only.
    """
    y = F.col(label).cast("double")
    error = y - F.col(prediction).cast("double")
    squares = F.sum(error * error)
    spread = F.var_pop(y) * F.count(y)
    return (
        df.where(F.col(label).isNotNull() & F.col(prediction).isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("rows"),
            F.avg(F.abs(error)).alias("mae"),
            F.sqrt(F.avg(error * error)).alias("rmse"),
            (1 - F.try_divide(squares, spread)).alias("r2"),
            (F.avg(F.abs(F.try_divide(error, y))) * 100).alias("mape"),
        )
    )


def passes_gate(metrics: DataFrame, max_mae: float = MAX_MAE) -> DataFrame:
    """The metric rows good enough for promotion."""
    return metrics.where(F.col("mae") < max_mae)


def group_rates(df: DataFrame, group: str, label: Column, prediction: Column) -> DataFrame:
    """Per group: rows, rate of positive predictions, and true and false positive rates.

    A rate that a group has no rows for is null: a group without positive labels has no true positive rate.
    """
    positive = F.coalesce(prediction.cast("boolean"), F.lit(False))
    actual = F.coalesce(label.cast("boolean"), F.lit(False))
    return df.groupBy(F.col(group).alias("protected_group")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.try_divide(F.count_if(positive), F.count(F.lit(1))).alias("positive_rate"),
        F.try_divide(F.count_if(positive & actual), F.count_if(actual)).alias("true_positive_rate"),
        F.try_divide(F.count_if(positive & ~actual), F.count_if(~actual)).alias("false_positive_rate"),
    )


def bias_scores(rates: DataFrame, min_parity: float = MIN_PARITY) -> DataFrame:
    """Least over greatest rate among the groups that have one: 1 is parity, null says that no group has one."""

    def parity(rate: str) -> Column:
        return F.when(F.max(rate) > 0, F.min(rate) / F.max(rate)).when(F.max(rate) == 0, F.lit(1.0))

    scores = rates.agg(
        parity("positive_rate").alias("demographic_parity_score"),
        parity("true_positive_rate").alias("equal_opportunity_score"),
    )
    low = F.least("demographic_parity_score", "equal_opportunity_score") < min_parity
    return scores.withColumn("bias_detected", F.coalesce(low, F.lit(False)))


def fairness_gaps(rates: DataFrame) -> DataFrame:
    """Each group's gaps to the best group, and a score for all: 1 less the worst gap.

    A group without a rate has no gap in it. Without any gap the score is 1.
    """
    rates = rates.withColumn("__all", F.lit(1))
    best = rates.groupBy("__all").agg(
        F.max("positive_rate").alias("__p"),
        F.max("true_positive_rate").alias("__t"),
        F.greatest(
            F.max("positive_rate") - F.min("positive_rate"), F.max("true_positive_rate") - F.min("true_positive_rate")
        ).alias("__worst"),
    )
    # One row: the greatest rates.
    gaps = rates.join(F.broadcast(best), "__all").withColumns(
        {
            "positive_rate_gap": F.col("__p") - F.col("positive_rate"),
            "true_positive_rate_gap": F.col("__t") - F.col("true_positive_rate"),
            "fairness_score": 1 - F.coalesce("__worst", F.lit(0.0)),
        }
    )
    return gaps.drop("__all", "__p", "__t", "__worst")
