"""What the operators of this subpackage share: working tables, small joins, and words of texts as arrays.

A *word* is a maximal run of bytes other than space and the control characters 9 to 13. These separators are single bytes
below 128, so words can be found in UTF-8 without decoding it.
"""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --- Working tables -----------------------------------------------------------------------------------------------


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Let Spark delete the shuffle files of each query that ends in here; the setting is put back afterwards."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


class Scratch:
    """Working tables of one run, below the folder the session names in ``spark.checkpoint.dir``.

    A written table cuts the lineage: what is read from it survives the loss of any executor without being computed
    again. Without that setting, which only a local session may lack, a temporary folder is used.
    """

    def __init__(self, spark: SparkSession, name: str) -> None:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not root:
            if not spark.sparkContext.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
        self.spark = spark
        self.root = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table, written as Parquet and read again with the same schema."""
        with shuffles_removed(self.spark):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def numbered(scratch: Scratch, rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``number``, from 0 in the given order, without bringing the rows into one task."""
    parts = scratch.write(rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)
    # One row per partition.
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        parts.groupBy("__part")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__offset"))
    )
    within = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return parts.join(offsets, "__part").withColumn("number", F.col("__offset") + within - 1).drop("__part", "__offset")


# --- Joins --------------------------------------------------------------------------------------------------------

SMALL_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, rows: int, on: list[str], how: str = "inner") -> DataFrame:
    """Join a table of counted ``rows`` narrow rows: broadcast up to ``SMALL_ROWS``, by shuffle beyond."""
    return df.join(F.broadcast(small) if rows <= SMALL_ROWS else small, on, how)


def join_hint(narrow: DataFrame) -> DataFrame:
    """A table of narrow rows for a join with wide ones: counted, and broadcast up to ``SMALL_ROWS``."""
    return F.broadcast(narrow) if narrow.count() <= SMALL_ROWS else narrow


def row_key(*columns: str | Column) -> Column:
    """A key that equals itself also where columns are null: a struct is never null."""
    return F.struct(*columns)


# --- Texts as arrays ----------------------------------------------------------------------------------------------

SLICE_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_STEP = 0xD6E8FEB86659FD93 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column of texts into runs of rows of about ``limit`` bytes (one row at least).

    Yields first row, last row + 1, the bytes, and where each row begins in them (one entry more than rows). Null counts
    as empty.
    """
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    whole = column.buffers()[2]
    data = np.frombuffer(whole, np.uint8) if whole is not None and whole.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(n, max(last, first + 1))
        at = offsets[first : last + 1]
        yield first, last, data[at[0] : at[-1]], at - at[0]
        first = last


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** i and its inverse modulo 2 ** 64, for i below n at least; base is odd."""
    known = _POWERS.get(base)
    if known is None or len(known[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        made = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            made.append(np.multiply.accumulate(x))
        known = _POWERS[base] = (made[0], made[1])
    return known


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers; one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Rabin-Karp hash, modulo 2 ** 64, of each span of values: sum of value * base ** (place in the span)."""
    power, inverse = _powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * power[: len(values)], out=sums[1:])
    return (sums[ends] - sums[starts]) * inverse[starts]


class Words:
    """The words of a run of texts: byte spans, hashes, and the number of each text's first word."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool = False) -> None:
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        self.data = data
        n = len(data)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        self.starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
        self.ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
        self.first = np.searchsorted(self.starts, at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        raw = _spans(self.data.astype(np.uint64) + np.uint64(1), self.starts, self.ends, _BASE)
        return mix(raw + (self.ends - self.starts).astype(np.uint64) * np.uint64(_STEP))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Rabin-Karp hash of the ``width`` word hashes from each place on, mixed; empty if there are fewer words."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    starts = np.arange(n)
    return mix(_spans(words, starts, starts + width, _STEP) + np.uint64(width))


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
