"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Vectors are spread over shards of about ``SHARD_ROWS`` rows, queries over blocks of about ``QUERY_ROWS``; a task gets one
shard and one block, so its memory does not depend on the size of the table. A shard turns its axes to those along which
its rows vary most, which leaves inner products as they are, and has for each of the leading axes a list of rows sorted by
value. A block of queries walks the lists at the same depth, from both ends, and all rows newly met are scored in full
against all queries of the block that still walk, in one product of whole numbers. The values at the present depth bound
the score of all rows not yet met: for any number of leading axes, the sum of the lists' values there and, for the axes
that remain, the product of the lengths that query and rows have in them at most. When the least of these bounds is below
the k-th best score found, the rest of the shard cannot matter to the query. The bound must be strictly below, by more
than the error of turning: a row not met might else tie and win by its identifier. If more than half of a shard has been
met, the rest is scored in one product.

The first shard is searched first; the k-th score that it gives a query is a floor for the others, and a query does not
go to a shard whose longest vector cannot reach it. Spark then merges the shards' best.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SHARD_ROWS = 16_384
QUERY_ROWS = 2_048
FIRST_DEPTH = 8
AT_ONCE = 256
LEADING_SHARE = 0.95
SLACK = 1e-9
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vector: Column, factor: float = 64.0) -> Column:
    """floor(factor * x) of each component; null where the vector or a component is null or not finite."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(vector.isNotNull() & whole, F.transform(vector, lambda x: F.floor(F.lit(factor) * x.cast("double"))))


class Lists:
    """A shard's rows with, for each leading axis, the rows in ascending order of their value along it."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.most = int(np.abs(rows.astype(object)).max()) if rows.size else 0
        plain = self.rows.astype(np.float64)
        values, axes = np.linalg.eigh(plain.T @ plain) if rows.size else (np.zeros(rows.shape[1]), np.eye(rows.shape[1]))
        share = np.cumsum(np.maximum(values[::-1], 0)) / max(values.clip(0).sum(), 1e-300)
        self.axes = axes[:, ::-1]
        turned = plain @ self.axes
        leading = min(rows.shape[1], int(np.searchsorted(share, LEADING_SHARE)) + 1)
        self.order = np.ascontiguousarray(np.argsort(turned[:, :leading], axis=0, kind="stable").T)
        self.sorted = np.take_along_axis(np.ascontiguousarray(turned[:, :leading].T), self.order, axis=1)
        #: The greatest length of a row in what remains after the first axes, for each number of them.
        squares = np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]
        lengths = np.sqrt(squares.max(axis=0, initial=0)) if rows.size else np.zeros(rows.shape[1])
        self.rest = np.append(lengths, 0.0)[: leading + 1]
        #: Pairs of a query and a row, and those that were scored.
        self.pairs = self.scored = 0

    def best(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query its k best rows (identifiers, scores), best first, ties by smaller identifier, never its own.

        Rows below a query's floor may be left out.
        """
        out = []
        for first in range(0, len(queries), AT_ONCE):
            some = slice(first, first + AT_ONCE)
            out += self._block(queries[some], own[some], k, np.full(len(queries[some]), -np.inf) if floors is None else floors[some])
        return out

    def _block(self, queries: np.ndarray, own: np.ndarray, k: int, floors: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.ids), len(queries)
        size = int(np.abs(queries.astype(object)).max()) if queries.size else 0
        exact = self.most * size * max(1, queries.shape[1]) < 1 << 53
        kind, nothing = (np.float64, -np.inf) if exact else (object, -(1 << 200))
        rows, factors = self.rows.astype(kind), queries.astype(kind)
        turned = queries.astype(np.float64) @ self.axes
        bounds = self._bounds(turned)
        scores = np.full((n, m), nothing, kind)
        mine = np.searchsorted(self.ids, own, "left"), np.searchsorted(self.ids, own, "right")
        kth = np.full(m, nothing, kind)
        top = np.full((0, m), nothing, kind)
        met = np.zeros(n, bool)
        # Lengths bound all scores of the shard.
        walking = np.flatnonzero(~(bounds(0) < floors))
        self.pairs += n * m
        depth = FIRST_DEPTH
        while len(walking) and not met.all():
            depth = min(depth, n)
            near = np.zeros(n, bool)
            near[self.order[:, :depth]] = True
            near[self.order[:, n - depth :]] = True
            if 2 * np.count_nonzero(near) > n or not len(self.order):
                near[:] = True
            fresh = np.flatnonzero(near & ~met)
            met |= near
            found = rows[fresh] @ factors[walking].T
            self.scored += found.size
            scores[np.ix_(fresh, walking)] = found
            for place, q in enumerate(walking):
                if mine[0][q] < mine[1][q]:
                    scores[mine[0][q] : mine[1][q], q] = nothing
                    found[(fresh >= mine[0][q]) & (fresh < mine[1][q]), place] = nothing
            both = np.concatenate([top[:, walking], found])
            if len(both) > k:
                both = np.partition(both, len(both) - k, axis=0)[-k:] if exact else np.sort(both, axis=0)[-k:]
            top = np.full((len(both), m), nothing, kind)
            top[:, walking] = both
            if len(both) >= k:
                kth[walking] = both.min(axis=0)
            least = np.maximum(kth[walking].astype(np.float64), floors[walking])
            walking = walking[~(bounds(depth)[walking] < least)]
            depth *= 2
        return [self._first(scores[:, q], max(kth[q], nothing if floors[q] == -np.inf else int(floors[q])), nothing, k) for q in range(m)]

    def _bounds(self, turned: np.ndarray):
        """A function of the depth: what a row that is deeper in all lists can score at most, for each query."""
        leading = len(self.order)
        remains = np.sqrt(np.cumsum((turned**2)[:, ::-1], axis=1)[:, ::-1]) if turned.shape[1] else np.zeros((len(turned), 0))
        remains = np.concatenate([remains, np.zeros((len(turned), 1))], axis=1)[:, : leading + 1]
        tails = remains * self.rest
        slack = SLACK * (1 + remains[:, 0] * self.rest[0])

        def at(depth: int) -> np.ndarray:
            n = len(self.ids)
            if not depth or not n:
                return tails[:, 0] + slack
            weights = turned[:, :leading]
            edges = np.where(weights > 0, self.sorted[:, n - depth], self.sorted[:, depth - 1])
            sums = np.concatenate([np.zeros((len(turned), 1)), np.cumsum(weights * edges, axis=1)], axis=1)
            return (sums + tails).min(axis=1) + slack

        return at

    def _first(self, scores: np.ndarray, least, nothing, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k best; rows that tie with the last of them are there to be told apart by their identifiers."""
        at = np.flatnonzero((scores >= least) & (scores > nothing))
        found = scores[at]
        if scores.dtype == object:
            found = np.array([min(max(x, LONG[0]), LONG[1]) for x in found], object)
        place = np.lexsort((self.ids[at], -found))[:k]
        return self.ids[at][place], found[place].astype(np.int64)


def _search(k: int):
    def run(queries: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(shard):
            lists = Lists(shard["id"].to_numpy(), np.stack(shard["v"].to_list()).astype(np.int64).reshape(len(shard), -1))
            vectors = np.stack(queries["v"].to_list()).astype(np.int64).reshape(len(queries), -1)
            floors = np.array([-np.inf if x is None or x != x else float(x) for x in queries["floor"]])
            # A floor that a double does not hold exactly is no floor.
            floors[np.abs(floors) > 2.0**53] = -np.inf
            own = queries["id"].to_numpy()
            for one, (ids, scores) in zip(own, lists.best(vectors, own, k, floors), strict=True):
                parts.append(pd.DataFrame({"query_id": one, "vec_id": ids, "score": scores}))
        return pd.concat(parts) if parts else pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """For each query row its ``k`` highest inner products of quantised vectors: query_id, rank (from 1), vec_id, score.

    Ties go to the smaller identifier; a query with fewer candidates gets them all. Rows whose identifier or vector is
    null, or whose vector holds null or non-finite components, take no part, neither as queries nor as candidates. A
    vector meets only vectors of its own length; empty vectors score 0. Repeated rows count once, and rows that share
    the query's identifier are its own. Scores beyond 64 bits are clamped. An empty table gives an empty result. Other
    columns are not read.
    """
    usable = (
        vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col)).alias("v"), is_query.alias("q"))
        .where("id IS NOT NULL AND v IS NOT NULL")
        .dropDuplicates(["id", "v"])
        .withColumn("size", F.size("v"))
    )
    counts = usable.agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("q").cast("int")).alias("queries")).first()
    shards = max(1, -(-counts["rows"] // shard_rows))
    blocks = max(1, -(-(counts["queries"] or 0) // query_rows))
    part = F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int")
    block = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")

    group = ["size", "shard", "block"]
    scratch = Scratch(vectors.sparkSession, "topk")
    usable = usable.withColumns({"shard": part, "block": block, "length": F.sqrt(F.reduce("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))})

    def search(queries: DataFrame, shard_filter: Column) -> DataFrame:
        """Queries (id, v, size, block, shard, floor) against the shards."""
        everywhere = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        candidates = usable.where(shard_filter).select("id", "v", "size", "shard", everywhere.alias("block"))
        # Both sides come from one table: new names for the columns keep them apart.
        queries, candidates = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (queries, candidates))
        return queries.groupBy(*group).cogroup(candidates.groupBy(*group)).applyInPandas(_search(k), "query_id long, vec_id long, score long")

    queries = usable.where("q").select("id", "v", "size", "block", "length")
    first = queries.select("id", "v", "size", "block", F.lit(0).alias("shard"), F.lit(None).cast("long").alias("floor"))
    found = search(first, F.col("shard") == 0)
    if shards > 1:
        found = scratch.write(found, "first")
        floors = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        lengths = scratch.write(usable.where("shard > 0").groupBy("size", "shard").agg(F.max("length").alias("longest")), "lengths")
        rest = queries.join(floors.select(F.col("query_id").alias("id"), "floor"), "id", "left")
        # One row per shard and length of vectors; a query goes to those that can reach its floor.
        rest = rest.join(lengths, "size").where(F.col("floor").isNull() | (F.col("length") * F.col("longest") * (1 + 1e-9) + 1 >= F.col("floor")))
        found = found.unionAll(search(rest.select("id", "v", "size", "block", "shard", "floor"), F.col("shard") > 0))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    )
