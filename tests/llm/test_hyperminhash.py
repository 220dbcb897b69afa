from __future__ import annotations

import random

import numpy as np
import pytest

from tidemark.llm.common import mix
from tidemark.llm.hyperminhash import BUCKETS, MANTISSA, least_agreeing, minima, near_duplicates, registers, rows_of_band

from .data import awkward, clashing, docs, prose
from .test_jaccard import plain


def expected(rows, width=5, percent=85):
    return sorted([(i, n, c, i == c) for i, n, c in plain(rows, width, percent)], key=repr)


def rows_of(df):
    assert df.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    return sorted([tuple(r) for r in df.collect()], key=repr)


@pytest.mark.parametrize(("width", "percent"), [(5, 85), (3, 90), (5, 80), (1, 100)])
def test_awkward_table(spark, width, percent):
    table = clashing(docs(spark), "row", "node", "comp", "token")
    assert rows_of(near_duplicates(table, width=width, percent=percent)) == expected(awkward(), width, percent)


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("growth", [2, 16])
def test_families_around_the_limit(spark, seed, growth):
    """Chains of edited copies, from six words to some hundred, with a passage that all documents share."""
    rng = random.Random(seed)
    common = prose(77, 25)
    rows = []
    for family in range(30):
        text = prose(family, rng.choice([6, 8, 12, 20, 30, 60, 150, 400]), 5000).split()
        shared = common if rng.random() < 0.5 else ""
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((rng.randrange(10**6), f"{' '.join(text)} {shared}", None, None, None))
            for _ in range(rng.choice([0, 1, 1, 2])):
                place = rng.choice([0, len(text) - 1, rng.randrange(len(text))])
                text[place : place + rng.randrange(2)] = [f"e{rng.randrange(1000)}"]
    assert rows_of(near_duplicates(docs(spark, rows), growth=growth)) == expected(rows)


def test_many_documents_that_share_most_words_but_do_not_link(spark):
    passage = prose(5, 70, 5000)
    rows = [(i, f"{passage} {prose(100 + i, 30, 5000)}", None, None, None) for i in range(150)]
    assert {r[2] for r in rows_of(near_duplicates(docs(spark, rows)))} == set(range(150))


def test_a_large_family(spark):
    base = prose(1, 200, 5000).split()
    rows = []
    for i in range(300):
        text = list(base)
        text[i % 200] = f"own{i}"
        rows.append((i + 5, " ".join(text), None, None, None))
    got = rows_of(near_duplicates(docs(spark, [*rows, rows[3]]).repartition(8)))
    assert {r[2] for r in got} == {5} and sum(r[3] for r in got) == 1 and len(got) == 301


def sets(rng, union, inside):
    """Two sets of hashes with ``inside`` of ``union`` elements in common."""
    values = mix(rng.integers(1, 2**63, union).astype(np.uint64))
    cut = inside + (union - inside) // 2
    return values[:cut], np.concatenate([values[:inside], values[cut:]])


@pytest.mark.parametrize(("union", "inside"), [(7, 6), (20, 17), (100, 85), (400, 340), (5000, 4250), (60, 20)])
def test_registers_agree_as_often_as_sets_are_alike(union, inside):
    rng = np.random.default_rng(union)
    agree, bits = [], []
    for _ in range(200):
        a, b = sets(rng, union, inside)
        owner = np.repeat([0, 1], [len(a), len(b)])
        kept = registers(minima(np.concatenate([a, b]), owner, 2))
        agree.append(np.mean(kept[0] == kept[1]))
        bits.append(int(((kept[0] ^ kept[1]) & 1 == 0).sum()))
    assert np.mean(agree) == pytest.approx(inside / union, abs=0.02)
    estimate = np.array(bits) / BUCKETS * 2 - 1
    assert estimate.mean() == pytest.approx(inside / union, abs=0.02)
    if inside / union >= 0.85:
        assert min(bits) >= least_agreeing(85)
        bands = 64
        assert all((np.array(a) > 0) for a in agree) and rows_of_band(85) * bands == BUCKETS


def test_registers_hold_leading_zeros_and_mantissa():
    width = 64 - (BUCKETS.bit_length() - 1)
    top = np.uint64(1) << np.uint64(width - 1)
    numbers = np.array([top, top | top >> np.uint64(1), top >> np.uint64(3), (top >> np.uint64(3)) | (top >> np.uint64(13)), 0], np.uint64)
    got = registers(numbers)
    assert (got >> MANTISSA).tolist()[:4] == [0, 0, 3, 3] and got[4] >> MANTISSA >= 52
    assert (got & (2**MANTISSA - 1)).tolist()[:4] == [0, 512, 0, 1]


def test_limits():
    assert rows_of_band(85) == 8 and rows_of_band(100) >= 8 and rows_of_band(50) < 8
    assert (1 - 0.85**8) ** 64 < 1e-8 and least_agreeing(10) >= 0
    assert least_agreeing(85) < BUCKETS * 0.925 - 6 * (BUCKETS * 0.925 * 0.075) ** 0.5


def test_empty_tables_and_bounds(spark):
    assert near_duplicates(docs(spark, [])).count() == 0
    assert rows_of(near_duplicates(docs(spark, [(3, None, None, None, None)]))) == [(3, 0, 3, True)]
    with pytest.raises(ValueError, match="percent"):
        near_duplicates(docs(spark), percent=0)
