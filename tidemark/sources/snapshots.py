"""A keyed table with upserts on plain parquet files, merged when it is read.

Rows are spread over a fixed number of buckets by a hash of the key. An upsert writes its own rows, sorted by that hash, to
a new folder, and then one small commit, numbered by the table itself, that names for every bucket the pieces to read: a
*base* with one row per key, and *deltas* with the rows of later upserts. The commit knows each piece's number of rows and
range of hashes, the number of buckets, the schema, and the last batch of each writer. Readers follow the newest commit
only, so a writer that is lost half way leaves nothing visible.

A reader takes the latest row of each key in the deltas and merges it with the base; base rows of other keys are read as
they are, without a shuffle as long as there are few deltas. A point read opens the pieces whose range holds the key's hash.
An upsert that finds more than ``most_deltas`` deltas in a bucket writes them as one, and one that finds more rows in them
than ``delta_share`` of the base writes the bucket anew: a row is written a bounded number of times, however small upserts
are.

A writer that gives its name and a batch number may repeat a batch: what is already committed is recognised and left alone.
A writer with another name, such as a stream that starts again with a new checkpoint, goes on from what is there. Two
writers that commit at once are told apart by a rename that fails if the commit exists; that is atomic on HDFS and local
disks, but not on object stores, which need one writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import astuple, dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.asof import latest
from ..session import path_exists

BUCKET = "__bucket"
HASH = "__hash"
# Rows of deltas whose keys are broadcast to the base they are merged with.
FEW_ROWS = 100_000


@dataclass(frozen=True)
class Piece:
    """A bucket's rows in one folder: how many, and the least and greatest hash of their keys."""

    folder: str
    rows: int
    low: int
    high: int

    def holds(self, hashes: Iterable[int]) -> bool:
        return any(self.low <= h <= self.high for h in hashes)


@dataclass(frozen=True)
class Commit:
    """What a table holds as of one upsert: each bucket's base, then its deltas, oldest first."""

    number: int
    buckets: int
    schema: T.StructType
    layout: dict[int, tuple[Piece, ...]]
    writers: dict[str, int]

    def dumps(self) -> str:
        return json.dumps(
            {
                "number": self.number,
                "buckets": self.buckets,
                "schema": self.schema.jsonValue(),
                "layout": {b: [astuple(p) for p in pieces] for b, pieces in self.layout.items()},
                "writers": self.writers,
            }
        )

    @classmethod
    def loads(cls, text: str) -> Commit:
        held = json.loads(text)
        layout = {int(b): tuple(Piece(*p) for p in pieces) for b, pieces in held["layout"].items()}
        return cls(held["number"], held["buckets"], T.StructType.fromJson(held["schema"]), layout, held["writers"])


@dataclass(frozen=True)
class SnapshotTable:
    """``order`` decides which of two rows of a key is kept: the greater one.

    Choose ``buckets`` so that one bucket is the work of one task: a bucket is
    written anew by one. The number belongs to the table and is refused if it
    differs from the stored one. ``keep`` commits and the data they name are kept
    for readers that are still at an older one. A bucket has at most
    ``most_deltas`` deltas, with at most ``delta_share`` of its base's rows.
    """

    spark: SparkSession
    root: str
    keys: tuple[str, ...]
    order: tuple[str, ...]
    buckets: int = 16
    keep: int = 10
    most_deltas: int = 8
    delta_share: float = 0.25

    def _hash(self) -> Column:
        return F.xxhash64(*self.keys)

    def _bucket(self) -> Column:
        return F.pmod(F.col(HASH), F.lit(self.buckets)).cast("int")

    def _latest(self, rows: DataFrame) -> DataFrame:
        """One row per key; its hash and bucket, if there, go with it."""
        extra = [c for c in (HASH, BUCKET) if c in rows.columns]
        return latest(rows, (*self.keys, *extra), self.order[0], self.order[1:])

    # Commits

    def _files(self):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _names(self, folder: str) -> list[str]:
        if not path_exists(self.spark, f"{self.root}/{folder}"):
            return []
        return sorted(entry.getPath().getName() for entry in self._files().listStatus(self._path(folder)))

    def _numbers(self) -> list[int]:
        return [int(name.removesuffix(".json")) for name in self._names("commits") if name.endswith(".json")]

    def _commit(self, number: int) -> Commit:
        text = self.spark.read.option("wholetext", True).text(f"{self.root}/commits/{number:012d}.json").first()[0]
        found = Commit.loads(text)
        if found.buckets != self.buckets:
            raise ValueError(f"{self.root} has {found.buckets} buckets, not {self.buckets}")
        return found

    def last_commit(self) -> Commit | None:
        numbers = self._numbers()
        return self._commit(numbers[-1]) if numbers else None

    def _publish(self, commit: Commit) -> None:
        """Make a commit visible; fails if another writer has taken its number."""
        files = self._files()
        hidden = self._path(f"commits/_{uuid.uuid4().hex}")
        out = files.create(hidden)
        out.write(commit.dumps().encode("utf-8"))
        out.close()
        target = self._path(f"commits/{commit.number:012d}.json")
        if files.exists(target) or not files.rename(hidden, target):
            files.delete(hidden, False)
            raise RuntimeError(f"another writer has committed {commit.number} to {self.root}")

    def _expire(self) -> None:
        """Drop commits beyond ``keep``, and data that no kept commit names and no writer is writing."""
        numbers = self._numbers()
        if len(numbers) <= self.keep:
            return
        kept = [self._commit(n) for n in numbers[-self.keep :]]
        used = {piece.folder for commit in kept for pieces in commit.layout.values() for piece in pieces}
        for number in numbers[: -self.keep]:
            self._files().delete(self._path(f"commits/{number:012d}.json"), False)
        for folder in self._names("data"):
            if folder not in used and int(folder.split("-")[0]) <= kept[0].number:
                self._files().delete(self._path(f"data/{folder}"), True)

    # Reading

    def _rows(self, commit: Commit, pieces: Sequence[tuple[int, Piece]]) -> DataFrame:
        """The rows of pieces of buckets, with the hash of their keys."""
        paths = [f"{self.root}/data/{piece.folder}/{BUCKET}={b}" for b, piece in pieces]
        # The stored schema: files that are older than a column have nulls for it.
        schema = T.StructType([*commit.schema.fields, T.StructField(HASH, T.LongType())])
        return self.spark.read.schema(schema).parquet(*paths)

    def _read(self, commit: Commit) -> DataFrame | None:
        bases = [(b, pieces[0]) for b, pieces in sorted(commit.layout.items())]
        deltas = [(b, piece) for b, pieces in sorted(commit.layout.items()) for piece in pieces[1:]]
        if not bases:
            return None
        base = self._rows(commit, bases)
        if not deltas:
            return base.drop(HASH)
        changed = self._latest(self._rows(commit, deltas))
        keys = changed.select(F.col(HASH).alias("__changed"), *[F.col(k).alias(f"__{k}") for k in self.keys])
        if sum(piece.rows for _, piece in deltas) <= FEW_ROWS:
            keys = F.broadcast(keys)
        same = F.col(HASH) == F.col("__changed")
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        older = base.join(keys, same, "left_semi")
        return base.join(keys, same, "left_anti").unionByName(self._latest(older.unionByName(changed))).drop(HASH)

    def get(self, keys: Sequence[tuple]) -> DataFrame | None:
        """The rows of some keys, from the pieces that can hold them; None if there is no table. A key's parts are in the order of ``keys``."""
        commit = self.last_commit()
        if commit is None:
            return None
        schema = T.StructType([T.StructField(k, commit.schema[k].dataType) for k in self.keys])
        asked = self.spark.createDataFrame([tuple(k) for k in keys], schema).distinct().withColumn(HASH, self._hash())
        hashes = [r[HASH] for r in asked.collect()]
        by_bucket: dict[int, list[int]] = {}
        for h in hashes:
            by_bucket.setdefault(h % self.buckets, []).append(h)
        pieces = [(b, p) for b, wanted in sorted(by_bucket.items()) for p in commit.layout.get(b, ()) if p.holds(wanted)]
        if not pieces:
            return self.spark.createDataFrame([], commit.schema)
        asked = asked.select(*[F.col(k).alias(f"__{k}") for k in self.keys])
        same = F.lit(True)
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(f"__{k}"))
        # The hashes are sorted within files, so that the filter skips what lies between.
        found = self._rows(commit, pieces).where(F.col(HASH).isin(hashes)).join(F.broadcast(asked), same, "left_semi")
        return self._latest(found).drop(HASH)

    def read(self, before: int | None = None, writer: str = "batch") -> DataFrame | None:
        """The table as of the newest commit; None if there is none.

        ``before`` is a batch of a writer: the table as it was when that batch was
        first applied, or as it is if it has not been.
        """
        if before is None:
            commit = self.last_commit()
            return None if commit is None else self._read(commit)
        for number in reversed(self._numbers()):
            commit = self._commit(number)
            if commit.writers.get(writer, -1) < before:
                return self._read(commit)
        return None

    # Writing

    def _kept(self, pieces: tuple[Piece, ...], new_rows: int) -> int:
        """How many of a bucket's pieces an upsert of ``new_rows`` leaves as they are."""
        if not pieces:
            return 0
        if sum(p.rows for p in pieces[1:]) + new_rows > self.delta_share * pieces[0].rows:
            return 0
        return len(pieces) if len(pieces) <= self.most_deltas else 1

    def _pieces(self, rows: DataFrame, folder: str) -> dict[int, Piece]:
        """What rows with their hash and bucket make in each bucket: one row per bucket."""
        found = rows.groupBy(BUCKET).agg(F.count(F.lit(1)).alias("rows"), F.min(HASH).alias("low"), F.max(HASH).alias("high"))
        return {r[BUCKET]: Piece(folder, r["rows"], r["low"], r["high"]) for r in found.collect()}

    def _written(self, folder: str) -> dict[int, Piece]:
        return self._pieces(self.spark.read.schema(f"{HASH} long, {BUCKET} int").parquet(f"{self.root}/data/{folder}"), folder)

    def compact(self) -> bool:
        """Write all buckets with deltas anew; False if there are none. The table's rows and writers stay as they are."""
        last = self.last_commit()
        merged = [] if last is None else [(b, p) for b, pieces in last.layout.items() if len(pieces) > 1 for p in pieces]
        if not merged:
            return False
        rows = self._latest(self._rows(last, merged).withColumn(BUCKET, self._bucket()))
        folder = f"{last.number + 1:012d}-{uuid.uuid4().hex}"
        rows = rows.repartition(min(self.buckets, len({b for b, _ in merged})), BUCKET).sortWithinPartitions(BUCKET, HASH)
        rows.write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
        layout = last.layout | {b: (piece,) for b, piece in self._written(folder).items()}
        self._publish(replace(last, number=last.number + 1, layout=layout))
        self._expire()
        return True

    def upsert(self, batch: DataFrame, number: int | None = None, writer: str = "batch") -> bool:
        """Merge a batch; False if this writer's batch is already in the table.

        Without a ``number`` the batch is always merged. A number below the
        writer's last one is refused.
        """
        last = self.last_commit()
        done = -1 if last is None else last.writers.get(writer, -1)
        if number is not None and number <= done:
            if number < done:
                raise ValueError(f"{writer} gave batch {number} after {done}")
            return False
        newest = self._latest(batch).withColumn(HASH, self._hash()).withColumn(BUCKET, self._bucket())
        # The batch is needed twice, to see which buckets it touches and to write it.
        newest = newest.persist()
        try:
            touched = self._pieces(newest, "")
            layout = {} if last is None else dict(last.layout)
            schema = batch.schema if last is None else last.schema
            following = 1 if last is None else last.number + 1
            if touched:
                # What each bucket keeps of its pieces; the others are merged with the batch into a new one.
                kept = {b: self._kept(layout.get(b, ()), new.rows) for b, new in touched.items()}
                merged = [(b, p) for b, n in kept.items() for p in layout.get(b, ())[n:]]
                rows = newest
                if merged:
                    old = self._rows(last, merged).withColumn(BUCKET, self._bucket())
                    rows = self._latest(newest.unionByName(old, allowMissingColumns=True))
                folder = f"{following:012d}-{uuid.uuid4().hex}"
                # Each bucket is written by one task, in the order of the hash.
                rows = rows.repartition(min(self.buckets, len(touched)), BUCKET).sortWithinPartitions(BUCKET, HASH)
                rows.write.partitionBy(BUCKET).parquet(f"{self.root}/data/{folder}")
                # What is written as it came is known; what was merged is counted where it lies.
                written = self._written(folder) if merged else {b: replace(new, folder=folder) for b, new in touched.items()}
                layout |= {b: (*layout.get(b, ())[: kept[b]], piece) for b, piece in written.items()}
                known = [*schema.fields, *[f for f in rows.drop(BUCKET, HASH).schema.fields if f.name not in schema.names]]
                schema = T.StructType([T.StructField(f.name, f.dataType) for f in known])
            elif number is None:
                return True
            writers = {} if last is None else dict(last.writers)
            if number is not None:
                writers[writer] = number
            commit = Commit(following, self.buckets, schema, layout, writers)
            self._publish(commit)
            self._expire()
            return True
        finally:
            newest.unpersist()
