"""Health of served predictions: counts, latency, windows and canary arms."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import timedelta
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import stable_bucket
from .distribution import exact_quantiles

MAX_ERROR_RATE = 0.05
MAX_LATENCY_MS = 1000.0
CANARY_STEPS = (10, 25, 50, 100)
HEALTH_WINDOW = "5 minutes"
PERCENTS = (50, 95, 99)


def prediction_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("model_name", "status").agg(F.count(F.lit(1)).alias("n"))


def latency_percentiles(log: DataFrame, percents: Sequence[int] = PERCENTS, latency: str = "latency_ms") -> DataFrame:
    """Exact percentiles of the latency per model, by linear interpolation: columns ``p50``, ``p95`` and so on.

    Latencies are counted per value first and put in order by ranges of values, so that a busy model is not one task.
    """
    counts = log.where(F.col(latency).isNotNull()).groupBy(F.col("model_name").alias("feature"), F.col(latency).cast("double").alias("value"))
    found = exact_quantiles(counts.agg(F.count(F.lit(1)).alias("n_ref")), [p / 100 for p in percents])
    return found.select(F.col("feature").alias("model_name"), *[F.col("quantiles")[i].alias(f"p{p}") for i, p in enumerate(percents)])


def latency_histogram(
    log: DataFrame, bounds: Sequence[float], latency: str = "latency_ms", percents: Sequence[int] = ()
) -> DataFrame:
    """Cumulative bucket counts (at most ``le``) per model, with the sum and the count.

    The last bucket of a model, with a null bound, holds all rows. ``percents``
    adds columns with the model's exact percentiles.
    """
    if percents:
        return latency_histogram(log, bounds, latency).join(F.broadcast(latency_percentiles(log, percents, latency)), "model_name", "left")
    value = F.col(latency)
    buckets = [F.struct(F.lit(float(b)).alias("le"), F.count_if(value <= b).alias("n")) for b in sorted(bounds)]
    buckets.append(F.struct(F.lit(None).cast("double").alias("le"), F.count(value).alias("n")))
    return (
        log.groupBy("model_name")
        .agg(F.array(*buckets).alias("__b"), F.sum(value).alias("latency_sum"), F.count(value).alias("latency_count"))
        .select("model_name", F.explode("__b").alias("__b"), "latency_sum", "latency_count")
        .select("model_name", "__b.le", "__b.n", "latency_sum", "latency_count")
    )


def health_measures(
    status: str = "status", latency: str = "latency_ms", error: str = "error"
) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col(status) == error).alias("errors"),
        F.avg(latency).alias("mean_latency_ms"),
    ]


def health_flags(
    measured: DataFrame, max_error_rate: float = MAX_ERROR_RATE, max_latency_ms: float = MAX_LATENCY_MS
) -> DataFrame:
    rate = F.col("errors") / F.col("requests")
    slow = F.coalesce(F.col("mean_latency_ms") > max_latency_ms, F.lit(False))
    return measured.withColumns(
        {"error_rate": rate, "healthy": (rate <= max_error_rate) & ~slow}
    )


def health_windows(
    log: DataFrame,
    ts: str = "ts",
    window: str = HEALTH_WINDOW,
    by: Sequence[str] = ("model_name",),
    max_error_rate: float = MAX_ERROR_RATE,
    max_latency_ms: float = MAX_LATENCY_MS,
) -> DataFrame:
    """Error rate and mean latency per tumbling window; works on a table or a stream."""
    measured = log.groupBy(F.window(F.col(ts).cast("timestamp"), window).alias("__w"), *by).agg(*health_measures())
    flagged = health_flags(measured, max_error_rate, max_latency_ms)
    return flagged.select(F.col("__w.start").alias("window_start"), *[c for c in flagged.columns if c != "__w"])


def canary_arm(key: Column, percent: int, salt: str = "") -> Column:
    """``canary`` for a stable ``percent`` of keys; raising it never moves a key back."""
    return F.when(stable_bucket(key, 100, salt) < percent, "canary").otherwise("stable")


def canary_health(
    log: DataFrame,
    key: str,
    steps: Sequence[int] = CANARY_STEPS,
    max_error_rate: float = MAX_ERROR_RATE,
    max_latency_ms: float = MAX_LATENCY_MS,
) -> DataFrame:
    """Health of each arm at each step of a rollout, in one pass over the log.

    Rows are first summed per bucket of keys, so the steps multiply 100 rows
    and not the log.
    """
    per_bucket = log.groupBy(stable_bucket(F.col(key)).alias("bucket")).agg(
        F.count(F.lit(1)).alias("requests"),
        F.count_if(F.col("status") == "error").alias("errors"),
        F.sum("latency_ms").alias("latency"),
        F.count("latency_ms").alias("timed"),
    )
    at_steps = per_bucket.withColumn("percent", F.explode(F.array(*[F.lit(s) for s in steps])))
    measured = (
        at_steps.groupBy("percent", F.when(F.col("bucket") < F.col("percent"), "canary").otherwise("stable").alias("arm"))
        .agg(
            F.sum("requests").alias("requests"),
            F.sum("errors").alias("errors"),
            F.try_divide(F.sum("latency"), F.sum("timed")).alias("mean_latency_ms"),
        )
    )
    return health_flags(measured, max_error_rate, max_latency_ms)


def rollout_decision(
    log: DataFrame,
    key: str,
    started: Column,
    step_length: timedelta,
    now: Column,
    ts: str = "ts",
    by: Sequence[str] = ("model_name",),
    steps: Sequence[int] = CANARY_STEPS,
    min_requests: int = 1,
    max_error_rate: float = MAX_ERROR_RATE,
    max_latency_ms: float = MAX_LATENCY_MS,
) -> DataFrame:
    """What to do with a rollout that goes up by ``steps`` of traffic, one every ``step_length``; one row per model.

    A step is judged by the requests that its canary arm served in its time. Steps are folded in their order:
    a healthy step advances to the next, one that is unhealthy rolls back, one with fewer than ``min_requests``
    holds, and one whose time is not over is still waiting. Columns: ``decision`` (``promote``, ``advance``, ``hold`` or
    ``roll_back``), ``step``, the last step that was judged or waits, as a percent of traffic, ``traffic``, the percent
    to serve from now on, and ``reason``. A model without requests holds at the first step.
    """
    length = step_length // timedelta(microseconds=1)
    at = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(started)) / length)
    percent = F.element_at(F.array(*[F.lit(s) for s in steps]), (F.col("__step") + 1).cast("int"))
    served = (
        log.withColumn("__step", at)
        .where((F.col("__step") >= 0) & (F.col("__step") < len(steps)) & (F.col(ts) < now))
        .withColumn("__canary", stable_bucket(F.col(key)) < percent)
    )
    measured = served.groupBy(*by, "__step").agg(
        F.count_if("__canary").alias("requests"),
        F.count_if(F.col("__canary") & (F.col("status") == "error")).alias("errors"),
        F.avg(F.when(F.col("__canary"), F.col("latency_ms"))).alias("mean_latency_ms"),
    )
    judged = measured.groupBy(*by).agg(F.collect_list(F.struct("__step", "requests", "errors", "mean_latency_ms")).alias("__steps"))
    over = F.floor((F.unix_micros(now) - F.unix_micros(started)) / length)

    def state(decision: str, i: int, traffic: int, reason: str) -> Column:
        return F.struct(F.lit(decision).alias("decision"), F.lit(steps[i]).alias("step"), F.lit(traffic).alias("traffic"), F.lit(reason).alias("reason"))

    def of_step(i: int) -> Callable[[Column], Column]:
        return lambda s: s["__step"] == i

    # The steps are few, and each one's outcome depends on those before it.
    found = state("advance", 0, steps[0], "waiting")
    for i in range(len(steps) - 1, -1, -1):
        own = F.get(F.filter("__steps", of_step(i)), F.lit(0))
        served_before = steps[i - 1] if i else 0
        passed = state("promote", i, 100, "healthy") if i == len(steps) - 1 else F.when(over > i + 1, found).otherwise(state("advance", i + 1, steps[i + 1], "healthy"))
        found = (
            F.when(over <= i, state("advance", i, steps[i], "waiting"))
            .when(F.coalesce(own["requests"], F.lit(0)) < min_requests, state("hold", i, served_before, "too few requests"))
            .when(own["errors"] / own["requests"] > max_error_rate, state("roll_back", i, 0, "errors"))
            .when(F.coalesce(own["mean_latency_ms"] > max_latency_ms, F.lit(False)), state("roll_back", i, 0, "latency"))
            .otherwise(passed)
        )
    return judged.select(*by, found.alias("__found")).select(*by, "__found.*")


def event_counts(events: DataFrame, event_type: str = "event_type") -> DataFrame:
    """Events per type with the total next to each."""
    counts = events.groupBy(event_type).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("total", total)


def metric_map(columns: Sequence[str]) -> Column:
    """Named metric columns as one map."""
    return F.create_map(*chain.from_iterable((F.lit(c), F.col(c).cast("double")) for c in columns))
