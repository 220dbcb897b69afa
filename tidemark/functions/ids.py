"""Identifiers and stable hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def random_id() -> Column:
    return F.uuid()


def _joined(parts: Sequence[Column]) -> Column:
    return F.concat_ws("\x1f", *[F.coalesce(part.cast("string"), F.lit("\0")) for part in parts])


def record_id(*parts: Column) -> Column:
    """An id that a replay of the same record gets again."""
    return F.sha2(_joined(parts), 256)


def stable_bucket(key: Column, buckets: int = 100, salt: str = "") -> Column:
    """0 .. buckets-1, the same for a key in every run, engine and partitioning."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(salt)).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def features_hash(features: Sequence[str]) -> Column:
    """A hash of named features that does not depend on their order."""
    parts = [part for name in sorted(features) for part in (F.lit(name), F.col(name))]
    return F.sha2(_joined(parts), 256)
