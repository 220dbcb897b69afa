"""Rows that a tree cannot tell apart, added up: what boosting needs of a table, of a size that the table's does not change.

A tree learns from the range that a feature's value lies in, of at most ``BINS`` ranges, and for squared errors from
the number of rows and the sum of their labels. Rows whose features lie in the same ranges, a cell, get the same
prediction from every tree, so one row with their number as its weight and their mean as its label trains the same
splits, and with the spread of their labels has the same squared error. There are at most as many cells as
combinations of ranges, and never more than rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VECTOR, LABEL, WEIGHT, SPREAD = "__features", "__label", "__weight", "__spread"
BINS = 32
# A round's sample takes or leaves pieces of cells: many of each where cells are few, and whole cells where there are many.
MOST_PIECES, PIECES_WANTED = 256, 100_000
# Ranges are found from one row in so many, as Spark's own are from a sample, where that leaves this many.
ROWS_TO_ONE, LEAST_SAMPLE = 64, 50_000
# Rows of a task, and cells that a join sends to every task.
TASK_ROWS, BROADCAST_CELLS = 20_000, 1_000_000


@dataclass(frozen=True)
class Bins:
    """Ranges per feature: a value lies in the one numbered by how many of the feature's cuts are below it."""

    features: tuple[str, ...]
    cuts: tuple[tuple[float, ...], ...]

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], bins: int = BINS) -> Bins:
        """Cuts between all values of features with few of them; elsewhere quantiles, which leave ranges about even."""
        values = [F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")) for f in features]
        place = F.xxhash64(*[name for name, kind in df.dtypes if "map<" not in kind])
        sample = df.where(F.pmod(place, F.lit(ROWS_TO_ONE)) == 0).select(*features).persist()
        try:
            return cls._of(sample if sample.count() >= LEAST_SAMPLE else df, features, values, bins)
        finally:
            sample.unpersist()

    @classmethod
    def _of(cls, df: DataFrame, features: Sequence[str], values: list[Column], bins: int) -> Bins:
        shares = [i / bins for i in range(1, bins)]
        found = df.agg(
            *[F.approx_percentile(v, shares).alias(f"q{i}") for i, v in enumerate(values)],
            *[F.approx_count_distinct(v).alias(f"n{i}") for i, v in enumerate(values)],
        ).first()
        # The count is approximate, by some hundredths.
        few = [i for i in range(len(values)) if found[f"n{i}"] <= bins + bins // 4]
        sets = df.agg(*[F.sort_array(F.collect_set(values[i])).alias(f"s{i}") for i in few]).first() if few else {}
        cuts = []
        for i in range(len(values)):
            known = sets[f"s{i}"] if i in few else None
            if known is not None and len(known) <= bins:
                cuts.append(tuple((a + b) / 2 for a, b in zip(known, known[1:])))
            else:
                cuts.append(tuple(sorted(set(found[f"q{i}"] or ()))))
        return cls(tuple(features), tuple(cuts))

    @property
    def names(self) -> list[str]:
        return [f"__bin_{i}" for i in range(len(self.features))]

    @property
    def most_cells(self) -> int:
        most = 1
        for cuts in self.cuts:
            most *= len(cuts) + 1
        return most

    def numbers(self) -> list[Column]:
        """The number of each feature's range; a missing value lies in the last one, as it does in Spark's trees."""
        columns = []
        for feature, cuts, name in zip(self.features, self.cuts, self.names, strict=True):
            value = F.coalesce(F.col(feature).cast("double"), F.lit(float("nan")))
            columns.append(sum(((value > F.lit(cut)).cast("int") for cut in cuts), F.lit(0)).alias(name))
        return columns

    def assemble(self, df: DataFrame) -> DataFrame:
        """The vector of a row's ranges from their numbers."""
        return VectorAssembler(inputCols=self.names, outputCol=VECTOR).transform(df)

    def with_vector(self, df: DataFrame) -> DataFrame:
        return self.assemble(df.select("*", *self.numbers())).drop(*self.names)


def _added_up(df: DataFrame, bins: Bins, label: str, whole: Column, *sides: str) -> DataFrame:
    """The cells of each side, those that are not ``whole`` in pieces."""
    pieces = min(MOST_PIECES, max(1, PIECES_WANTED // bins.most_cells))
    piece = F.when(whole, F.lit(0)).otherwise(F.pmod(F.xxhash64(*bins.features, label), F.lit(pieces))).alias("__piece")
    keys = [*sides, *bins.names, "__piece"]
    # A label that is missing stays one: training refuses it.
    mean = F.when(F.count(LABEL) == F.count(F.lit(1)), F.avg(LABEL))
    cells = df.select(*sides, *bins.numbers(), piece, F.col(label).cast("double").alias(LABEL)).groupBy(*keys).agg(
        mean.alias(LABEL), F.count(F.lit(1)).cast("double").alias(WEIGHT), F.stddev_pop(LABEL).alias(SPREAD)
    )
    tasks = max(1, min(df.sparkSession.sparkContext.defaultParallelism, bins.most_cells * pieces // TASK_ROWS))
    # Samples go by a row's place in its task: the same in every run.
    return bins.assemble(cells.repartition(tasks, *keys).sortWithinPartitions(*keys))


@dataclass(frozen=True)
class Cells:
    """A table's cells: the vector, and mean, number and standard deviation of the labels."""

    bins: Bins
    rows: DataFrame

    @classmethod
    def of(cls, df: DataFrame, features: Sequence[str], label: str, bins: Bins | None = None, sampled: bool = False) -> Cells:
        """Cells of the rows; ``sampled`` ones are in pieces, so that a sample of them is much like one of the rows."""
        bins = bins or Bins.of(df, features)
        return cls(bins, _added_up(df, bins, label, F.lit(not sampled)).select(VECTOR, LABEL, WEIGHT, SPREAD))

    @classmethod
    @contextmanager
    def of_sides(cls, df: DataFrame, features: Sequence[str], label: str, validation: Column, sampled: bool = True) -> Iterator[tuple[Cells, Cells]]:
        """Cells to train on and those that ``validation`` keeps from it, from one pass over the rows, kept while they are used."""
        bins = Bins.of(df.where(~validation), features)
        whole = validation if sampled else F.lit(True)
        sides = _added_up(df.withColumn("__side", validation), bins, label, whole, "__side").persist()
        try:
            yield tuple(cls(bins, sides.where(side).select(VECTOR, LABEL, WEIGHT, SPREAD)) for side in (~F.col("__side"), F.col("__side")))
        finally:
            sides.unpersist()

    def persist(self) -> Cells:
        return Cells(self.bins, self.rows.persist())

    def unpersist(self) -> None:
        self.rows.unpersist()

    def points(self) -> DataFrame:
        """Two rows for a cell, as far apart as its labels are: their squared errors are those of the cell's rows."""
        both = F.explode(F.array(F.col(LABEL) - F.col(SPREAD), F.col(LABEL) + F.col(SPREAD))).alias(LABEL)
        return self.rows.select(VECTOR, both, (F.col(WEIGHT) / 2).alias(WEIGHT))


@dataclass(frozen=True)
class Held:
    """Rows to evaluate many models on: the ranges and label of each row, and every cell once, to be predicted once."""

    bins: Bins
    label: str
    rows: DataFrame
    cells: DataFrame

    @classmethod
    @contextmanager
    def of(cls, df: DataFrame, label: str, bins: Bins) -> Iterator[Held]:
        rows = df.select(*bins.numbers(), F.col(label)).persist()
        cells = bins.assemble(rows.select(*bins.names).distinct()).persist()
        try:
            yield cls(bins, label, rows, F.broadcast(cells) if cells.count() <= BROADCAST_CELLS else cells)
        finally:
            cells.unpersist()
            rows.unpersist()
