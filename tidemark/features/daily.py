"""The daily job: features of one day from the partitions its windows reach back to."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.quality import Expectation, QualityError
from ..sources.readers import on_day
from ..sources.writers import replace_days, write_days

HISTORY = timedelta(days=30)


def read_history(
    spark: SparkSession, root: str, schema: T.StructType, day: date, history: timedelta = HISTORY
) -> DataFrame:
    """The partitions from ``history`` before a day up to the day itself; others are pruned."""
    columns = [f for f in schema.fields if f.name != "ds"]
    table = spark.read.schema(T.StructType([*columns, T.StructField("ds", T.DateType())])).parquet(root)
    return table.where(F.col("ds").between(F.lit(day - history), F.lit(day))).drop("ds")


def run_day(
    spark: SparkSession,
    source: str,
    target: str,
    schema: T.StructType,
    day: date,
    compute: Callable[[DataFrame], DataFrame],
    ts: str = "event_timestamp",
    expectations: Sequence[Expectation] = (),
    history: timedelta = HISTORY,
    allow_empty: bool = False,
) -> Observation:
    """Compute a day's features over its history and replace that day of the target.

    The day is written aside, counts and expectations are measured during the
    write, and only a day that passes is published; :func:`check_day` raises for
    one that does not. ``allow_empty`` lets a day without rows pass: the target
    then has none for it either.
    """
    features = compute(read_history(spark, source, schema, day, history)).where(on_day(ts, day))
    # Readers of the target do not see names that begin with an underscore.
    staged = f"{target}/_staged-{uuid.uuid4().hex}"
    seen = write_days(features.withColumn("ds", F.lit(day)), staged, expectations=expectations)
    if not _failures(seen, allow_empty):
        replace_days(spark, staged, target, [day])
    return seen


def _failures(observation: Observation, allow_empty: bool) -> dict[str, int]:
    seen = dict(observation.get)
    rows = seen.pop("rows")
    failed = {name: n for name, n in seen.items() if n}
    return failed if rows or allow_empty else failed | {"rows": 0}


def check_day(observation: Observation, allow_empty: bool = False) -> int:
    """The number of rows written; raises if an expectation failed or, unless allowed, there are none."""
    rows = observation.get["rows"]
    failed = _failures(observation, allow_empty)
    if failed:
        raise QualityError(f"{rows} rows, failed: {failed}")
    return rows
