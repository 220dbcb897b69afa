from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.topk import Lists, top_k

from .data import clashing

SCHEMA = "vec_id long, embedding array<double>"


def plain(rows, k, every):
    usable = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            usable.setdefault((i, tuple(math.floor(64 * x) for x in v)))
    out = []
    for q, a in usable:
        if q % every:
            continue
        found = [(-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in usable if c != q and len(b) == len(a)]
        out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(found)[:k])]
    return sorted(out)


def rows(n, d, seed, spread=1.0):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0, spread) for _ in range(d)]) for i in range(n)]


@pytest.mark.parametrize(("n", "d", "k"), [(400, 8, 20), (300, 3, 5), (150, 1, 7), (10, 16, 20)])
def test_matches_all_pairs(spark, n, d, k):
    data = rows(n, d, n)
    table = clashing(spark.createDataFrame(data, SCHEMA), "id", "v", "score", "shard")
    got = top_k(table, F.col("vec_id") % 20 == 0, k, shard_rows=90, query_rows=6)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, k, 20)


def test_ties_and_equal_vectors(spark):
    data = [(i, [1.0, -1.0, 0.0] if i % 2 else [0.5, 0.25, 0.0]) for i in range(200)]
    got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, 20, shard_rows=64)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, 20, 20)


def test_awkward_rows(spark):
    data = rows(60, 4, 5) + [
        (None, [1.0, 2.0, 3.0, 4.0]), (100, None), (120, [1.0, None, 2.0, 3.0]), (140, [float("nan"), 1.0, 1.0, 1.0]),
        (160, [float("inf"), 1.0, 1.0, 1.0]), (180, [0.0, 0.0, 0.0, 0.0]), (200, []), (201, []), (220, [1.0, 2.0]), (221, [3.0, 1.0]),
        (240, [1e9, -1e9, 1e9, 3.0]),
    ]
    data.append(data[20])
    got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, 20)
    assert sorted(tuple(r) for r in got.collect()) == plain(data, 20, 20)


def test_scores_beyond_64_bits_are_clamped(spark):
    data = [(0, [1e16, 1e16]), (1, [1e16, 1e16]), (2, [-1e16, -1e16])]
    got = [tuple(r) for r in top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") == 0, 2).collect()]
    assert got == [(0, 1, 1, 2**63 - 1), (0, 2, 2, -(2**63))]


def test_empty_table(spark):
    assert top_k(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 20 == 0).count() == 0


def shares(rows, k=20):
    """The share of pairs that is scored, after a check of all results."""
    rng = np.random.default_rng(9)
    ids = rng.permutation(len(rows))
    lists = Lists(ids, rows)
    queries = np.arange(0, len(rows), 40)
    found = lists.best(rows[queries], ids[queries], k)
    for q, (got, scores) in zip(queries, found, strict=True):
        all_scores = rows @ rows[q]
        want = sorted((-s, i) for s, i in zip(all_scores.tolist(), ids.tolist(), strict=True) if i != ids[q])[:k]
        assert [(-s, i) for i, s in zip(got.tolist(), scores.tolist(), strict=True)] == want
    return lists.scored / lists.pairs


def test_rows_scored_with_even_and_uneven_variance():
    """Lists end early where vectors vary along few directions, whichever these are, and not where all are alike."""
    rng = np.random.default_rng(4)
    even = rng.normal(0, 1, (4000, 32))
    uneven = even * 0.6 ** np.arange(32)
    turn = np.linalg.qr(rng.normal(0, 1, (32, 32)))[0]
    assert shares(np.floor(64 * even).astype(np.int64)) > 0.9
    assert shares(np.floor(64 * uneven).astype(np.int64)) < 0.5
    assert shares(np.floor(64 * uneven @ turn).astype(np.int64)) < 0.5


def test_ties_at_the_bound():
    """Many rows tie with the k-th one, of which some lie deep in all lists."""
    rng = np.random.default_rng(5)
    rows = rng.integers(-1, 2, (3000, 6)) * 50
    shares(rows, 7)
    rows[:, 1:] = 0
    shares(rows, 30)


def test_floors_of_the_first_shard_lose_nothing(spark):
    """Long vectors in one shard, short ones in others, which some queries need not visit."""
    data = [(i, [x * (8 if i % 3 == 0 else 0.4) for x in v]) for i, v in rows(300, 5, 8)] + [(i, [0.01, 0.0, 0.0, 0.0, -0.01]) for i in range(300, 400)]
    for k in (3, 390):
        got = top_k(spark.createDataFrame(data, SCHEMA), F.col("vec_id") % 20 == 0, k, shard_rows=40, query_rows=6)
        assert sorted(tuple(r) for r in got.collect()) == plain(data, k, 20)
