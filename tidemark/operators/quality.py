"""Data-quality expectations, all evaluated in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_ROWS = 1
MAX_ROWS = 10_000_000
LATITUDE = (-90.0, 90.0)
LONGITUDE = (-180.0, 180.0)
RATING = (1.0, 5.0)


@dataclass(frozen=True)
class Expectation:
    """A named rule: ``failed`` is an aggregate counting what breaks it."""

    name: str
    column: str | None
    failed: Column


def not_null(column: str) -> Expectation:
    return Expectation("not_null", column, F.count_if(F.col(column).isNull()))


def between(column: str, low: float, high: float) -> Expectation:
    """Values within closed bounds; nulls pass."""
    return Expectation("between", column, F.count_if(~F.col(column).between(low, high)))


def allowed(column: str, values: Sequence[object]) -> Expectation:
    """Values from a fixed set; nulls pass."""
    return Expectation("allowed", column, F.count_if(~F.col(column).isin(*values)))


def row_count(low: int = MIN_ROWS, high: int = MAX_ROWS) -> Expectation:
    rows = F.count(F.lit(1))
    missing = F.greatest(F.lit(low) - rows, F.lit(0))
    surplus = F.greatest(rows - F.lit(high), F.lit(0))
    return Expectation("row_count", None, missing + surplus)


def rule(name: str, condition: Column, column: str | None = None) -> Expectation:
    """Any row condition; null counts as a failure."""
    return Expectation(name, column, F.count_if(~F.coalesce(condition, F.lit(False))))


def evaluate(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """One row per expectation: rows seen, failures and success."""
    results = [
        F.struct(
            F.lit(e.name).alias("expectation"),
            F.lit(e.column).cast("string").alias("column"),
            F.count(F.lit(1)).alias("rows"),
            e.failed.cast("bigint").alias("failed"),
        )
        for e in expectations
    ]
    return (
        df.agg(F.array(*results).alias("__results"))
        .select(F.explode("__results").alias("__result"))
        .select("__result.*")
        .withColumn("success", F.col("failed") == 0)
    )


class QualityError(Exception):
    """Raised by :func:`require` with the expectations that failed."""


def require(report: DataFrame) -> None:
    """Raise if an expectation of a report failed. A report has one row per expectation."""
    failed = [f"{r['expectation']}({r['column'] or ''}): {r['failed']}" for r in report.where(~F.col("success")).collect()]
    if failed:
        raise QualityError(", ".join(sorted(failed)))


def observed(df: DataFrame, name: str, expectations: Sequence[Expectation]) -> tuple[DataFrame, Observation]:
    """The same counts measured while ``df`` is written, without a pass of their own."""
    observation = Observation(name)
    measures = [e.failed.alias(f"{e.name}:{e.column or ''}") for e in expectations]
    return df.observe(observation, F.count(F.lit(1)).alias("rows"), *measures), observation


def valid_coordinates(lat: Column, lng: Column) -> Column:
    """Row flag: both coordinates present and within range."""
    return F.coalesce(lat.between(*LATITUDE) & lng.between(*LONGITUDE), F.lit(False))


def orphans(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose non-null reference has no parent."""
    known = parent.select(F.col(parent_column).alias("__parent"))
    return df.where(F.col(column).isNotNull()).join(known, F.col(column) == F.col("__parent"), "left_anti")


def schema_differences(df: DataFrame, expected: T.StructType) -> DataFrame:
    """Columns missing, extra or of another type than expected, from the schemas alone."""
    have = {f.name: f.dataType.simpleString() for f in df.schema}
    want = {f.name: f.dataType.simpleString() for f in expected}
    rows = [(n, "missing", t, None) for n, t in want.items() if n not in have]
    rows += [(n, "extra", None, t) for n, t in have.items() if n not in want]
    rows += [(n, "type", t, have[n]) for n, t in want.items() if n in have and have[n] != t]
    schema = T.StructType()
    for name in ("column", "problem", "expected", "actual"):
        schema = schema.add(name, "string")
    return df.sparkSession.createDataFrame(sorted(rows), schema)
