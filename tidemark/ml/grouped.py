"""A user's own training function for each group of rows, and its models applied to the rows of the group."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Functions of this module travel to the executors by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MOST_ROWS = 100_000

Fit = Callable[[pd.DataFrame], bytes]
Predict = Callable[[bytes, pd.DataFrame], Sequence[float]]


def train_groups(
    df: DataFrame,
    keys: Sequence[str],
    columns: Sequence[str],
    fit: Fit,
    fit_large: Callable[[DataFrame], DataFrame] | None = None,
    most_rows: int = MOST_ROWS,
) -> DataFrame:
    """One row per group: its keys, ``rows`` and the ``model`` that ``fit`` made of its rows, as bytes.

    A group of up to ``most_rows`` rows is sent to one task as a frame of ``columns``. Larger ones are never sent whole:
    ``fit_large`` gets all their rows as a table and returns keys and model, say from sums as :func:`linear_models` does;
    without it they are an error. Groups are counted first. Null keys are a group.
    """
    same = list(keys)
    sizes = df.groupBy(*same).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > most_rows)
    any_large = not large.isEmpty()
    if any_large and fit_large is None:
        raise ValueError(f"a group has more than {most_rows} rows, and there is no way to fit it in parts")
    fields = [df.schema[k] for k in same]
    schema = T.StructType([*fields, T.StructField("rows", T.LongType()), T.StructField("model", T.BinaryType())])
    wanted = list(columns)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([[*key, len(rows), fit(rows[wanted])]], columns=[f.name for f in schema.fields])

    here = df.select(*dict.fromkeys([*same, *wanted]))
    if not any_large:
        return here.groupBy(*same).applyInPandas(run, schema)
    marks = large.select(*[F.col(k).alias(f"__{k}") for k in same], F.col("rows").alias("__rows"))
    match = F.lit(True)
    for k in same:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    small = here.join(marks, match, "left_anti").groupBy(*same).applyInPandas(run, schema)
    fitted = fit_large(here.join(marks, match, "left_semi"))
    sized = fitted.join(marks, match).select(*same, F.col("__rows").alias("rows"), "model")
    return small.unionByName(sized)


def score_groups(
    df: DataFrame, models: DataFrame, keys: Sequence[str], columns: Sequence[str], predict: Predict, column: str = "prediction", most_rows: int = MOST_ROWS
) -> DataFrame:
    """Rows with what their group's model predicts; null where the group has none.

    Rows meet their model in groups of about ``most_rows``: a large group is cut into several, each with the model.
    """
    same = list(keys)
    salts = F.greatest(F.lit(1), F.ceil(F.col("rows") / most_rows)).cast("int")
    parts = models.select(*[F.col(k).alias(f"__{k}") for k in same], F.col("model").alias("__model"), salts.alias("__salts"))
    match = F.lit(True)
    for k in same:
        match &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    # The number of parts first, without the model's bytes.
    known = df.join(parts.drop("__model"), match, "left").drop(*[f"__{k}" for k in same])
    salted = known.withColumn("__salt", F.pmod(F.xxhash64(*df.columns), F.coalesce("__salts", F.lit(1))).cast("int")).drop("__salts")
    each = parts.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)))
    schema = T.StructType([*df.schema.fields, T.StructField(column, T.DoubleType())])
    wanted, own = list(columns), df.columns

    def run(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = rows[own].copy()
        out[column] = np.asarray(predict(bytes(found["__model"].iloc[0]), rows[wanted]), float) if len(found) and len(rows) else np.nan
        return out

    left = salted.groupBy(*same, "__salt")
    right = each.groupBy(*[f"__{k}" for k in same], "__salt")
    return left.cogroup(right).applyInPandas(run, schema)


def fit_linear(inputs: Sequence[str], label: str) -> Fit:
    """Least squares with an intercept, on a frame."""

    def fit(rows: pd.DataFrame) -> bytes:
        rows = rows.dropna()
        x = np.column_stack([np.ones(len(rows)), rows[list(inputs)].to_numpy(float)])
        return _solved(x.T @ x, x.T @ rows[label].to_numpy(float))

    return fit


def linear_models(keys: Sequence[str], inputs: Sequence[str], label: str) -> Callable[[DataFrame], DataFrame]:
    """The same fit from sums of products, which tasks add up before the shuffle: a group's size does not matter."""
    names = ["1", *inputs]

    def term(name: str):
        return F.lit(1.0) if name == "1" else F.col(name).cast("double")

    def fit(df: DataFrame) -> DataFrame:
        whole = df.where(" AND ".join(f"`{c}` IS NOT NULL" for c in [*inputs, label]))
        products = [F.sum(term(a) * term(b)) for a in names for b in names]
        sums = whole.groupBy(*keys).agg(F.array(*products).alias("__xx"), F.array(*[F.sum(term(a) * term(label)) for a in names]).alias("__xy"))
        schema = T.StructType([*[df.schema[k] for k in keys], T.StructField("model", T.BinaryType())])

        def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                models = [_solved(np.array(xx, float).reshape(len(names), -1), np.array(xy, float)) for xx, xy in zip(batch["__xx"], batch["__xy"], strict=True)]
                yield batch[list(keys)].assign(model=models)

        return sums.mapInPandas(solve, schema)

    return fit


def _solved(xx: np.ndarray, xy: np.ndarray) -> bytes:
    return json.dumps(np.linalg.lstsq(xx, xy, rcond=None)[0].tolist()).encode()


def coefficients(model: bytes) -> list[float]:
    """Intercept, then a factor for each input."""
    return json.loads(model)


def predict_linear(model: bytes, rows: pd.DataFrame) -> np.ndarray:
    found = np.array(coefficients(model))
    return found[0] + rows.to_numpy(float) @ found[1:]
