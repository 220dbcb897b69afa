from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.jaccard import _added, frequencies, link_counts, near_dedup, near_groups, near_links

from .data import awkward, clashing, docs, prose, words


def shingles(text, width):
    found = [w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in words(text)]
    if 0 < len(found) < width:
        return {tuple(found)}
    return {tuple(found[i : i + width]) for i in range(len(found) - width + 1)}


def plain(rows, width, percent):
    """Component by trying all pairs."""
    sets = [shingles(r[1], width) for r in rows]
    group = list(range(len(rows)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            same_row = rows[i][:2] == rows[j][:2]
            if same_row or sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                group[top(i)] = top(j)
    out = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if top(j) == top(i) and rows[j][0] is not None]
        out.append((r[0], len(sets[i]), min(ids, default=None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_awkward_table(spark, width, percent):
    table = clashing(docs(spark), "row", "node", "comp", "least")
    got = near_groups(table, width=width, percent=percent, class_bits=10)
    assert sorted([tuple(g) for g in got.collect()], key=repr) == plain(awkward(), width, percent)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize(("matches", "growth"), [(1, 2), (4, 8)])
def test_families_with_chains(spark, seed, matches, growth):
    """Families of edited copies around the limit, with passages that all documents share."""
    rng = random.Random(seed)
    common = prose(77, 25)
    rows = []
    for family in range(12):
        text = prose(family, rng.choice([8, 30, 60, 150])).split()
        for _ in range(rng.choice([1, 3, 12])):
            rows.append((rng.randrange(10**6), " ".join([*text, common]), None, None, None))
            for _ in range(rng.choice([0, 1, 1, 2])):
                text[rng.randrange(len(text))] = f"e{rng.randrange(1000)}"
    got = near_groups(docs(spark, rows), most_matches=matches, growth=growth, class_bits=8)
    assert sorted([tuple(g) for g in got.collect()], key=repr) == plain(rows, 3, 90)


def test_a_large_family_needs_few_comparisons(spark, tmp_path):
    """Every near copy differs in its own place; pairs would be 45,000."""
    base = prose(1, 200, 5000).split()
    rows = []
    for i in range(300):
        text = list(base)
        text[i % 200] = f"own{i}"
        rows.append((i, " ".join(text), None, None, None))
    got = near_groups(docs(spark, rows).repartition(8)).collect()
    assert {g.component_id for g in got} == {0}


def plain_links(rows, width, percent):
    """Pairs of different word sequences that link, and each row's number of links, by trying all pairs."""
    classes = {}
    for r in rows:
        found = tuple(w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in words(r[1]))
        classes.setdefault(found, set()).add(r[:2])
    classes.pop((), None)
    keys = list(classes)
    sets = [shingles(" ".join(k), width) for k in keys]
    pairs, reached = [], {k: len(classes[k]) - 1 for k in keys}
    least = {k: min(((i is None, i or 0) for i, _ in classes[k])) for k in keys}
    for i, a in enumerate(keys):
        for j, b in enumerate(keys[:i]):
            if 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                reached[a] += len(classes[b])
                reached[b] += len(classes[a])
                ends = sorted((*least[k], len(classes[k])) for k in (a, b))
                pairs.append((*[None if none else x for none, x, _ in ends], *[n for _, _, n in ends]))
    counts = []
    for r in rows:
        found = tuple(w.translate(str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})) for w in words(r[1]))
        counts.append((r[0], len(shingles(r[1], width)), reached.get(found, 0)))
    return sorted(pairs, key=repr), sorted(counts, key=repr)


def check_links(table, rows, width=3, percent=90, **how):
    pairs, counts = plain_links(rows, width, percent)
    assert sorted([tuple(g) for g in near_links(table, width=width, percent=percent, **how).collect()], key=repr) == pairs
    assert sorted([tuple(g) for g in link_counts(table, width=width, percent=percent, **how).collect()], key=repr) == counts
    return pairs


def test_counts_of_classes_are_added_in_groups_of_few_tasks(spark):
    """With many input tasks no group of a sum holds a row of each."""
    def counts(rows):
        return {(r.block, r.part): np.frombuffer(r.counts, np.uint32 if r.bytes == 4 else np.int64).tolist() for r in rows.collect()}

    made = [(b, 4, bytearray(np.array([p, b + 1], np.uint32).tobytes()), p) for p in range(40) for b in range(2)]
    rows = spark.createDataFrame(made, "block int, bytes int, counts binary, part int")
    once = _added(rows, 3)
    assert counts(once) == {(b, p): [sum(range(8 * p, 8 * p + 8)), 8 * (b + 1)] for b in range(2) for p in range(5)}
    assert counts(_added(once, 3)) == {(b, 0): [sum(range(40)), 40 * (b + 1)] for b in range(2)}

    table = docs(spark).select(F.col("text")).where("text IS NOT NULL")
    few, many = frequencies(table.coalesce(1), 3, 10), frequencies(table.repartition(40), 3, 10)
    assert few.sum() > 0 and (few == many).all()


def test_links_of_awkward_table(spark):
    check_links(clashing(docs(spark), "row", "node", "a", "b"), awkward(), class_bits=10)
    assert near_links(docs(spark, [])).count() == 0 and link_counts(docs(spark, [])).count() == 0


@pytest.mark.parametrize("matches", [1, 4])
def test_all_links_of_a_family_are_found(spark, matches):
    """Each near copy links with each, some are there several times, and all are connected after a few comparisons."""
    base = prose(1, 200, 5000).split()
    rows = []
    for i in range(40):
        text = list(base)
        text[i * 5] = f"own{i}"
        rows += [(100 * i + k, " ".join(text), None, None, None) for k in range(1 + i % 3)]
    pairs = check_links(docs(spark, [*rows, rows[0]]), [*rows, rows[0]], most_matches=matches, class_bits=8)
    assert len(pairs) == 40 * 39 // 2


def test_dedup_keeps_the_smallest_and_all_columns(spark):
    table = clashing(docs(spark), "row", "first")
    out = near_dedup(table)
    assert out.columns == table.columns
    kept = out.collect()
    groups = plain(awkward(), 3, 90)
    assert {r.doc_id for r in kept} >= {c for _, _, c in groups if c is not None}
    assert len(kept) == len({(c, n == 0 and d) for d, n, c in groups})


def test_empty_tables(spark):
    assert near_groups(docs(spark, [])).count() == 0
    assert [tuple(g) for g in near_groups(docs(spark, [(3, None, None, None, None)])).collect()] == [(3, 0, 3)]
    assert near_dedup(docs(spark, [])).count() == 0
