from __future__ import annotations

import math
from collections import defaultdict

import pytest

from tidemark.llm.mixing import mix, mixed

from .data import awkward, clashing, docs, prose, words


def plain_targets(sizes):
    """Water filling over sources in order."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def check(rows, got):
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    target = plain_targets(sizes)
    taken = defaultdict(int)
    for g in got:
        assert g.source_size == sizes[g.source]
        assert math.isclose(g.target, target[g.source], rel_tol=1e-9, abs_tol=1e-9)
        assert 0 <= g.taken <= 3 * g.size
        assert g.taken == g.copies * g.size + g.cut_words
        taken[g.source] += g.taken
    for source in target:
        # Ties at the last place share what is missing, so a word each may be lost.
        assert abs(taken[source] - target[source]) <= 4


def many(n=600):
    rows = [(i, prose(i, 3 + i * 7919 % 180), "en", f"s{i % 5}", 0) for i in range(n)]
    rows += [(10_000 + i, prose(i, 40), "en", "big" if i % 9 else None, 0) for i in range(n)]
    return rows + [(50_000, prose(0, 3), "en", "Ä tiny", 0)]


@pytest.mark.parametrize("rows", [awkward(), many()], ids=["awkward", "many"])
def test_targets_are_met(spark, rows):
    got = mix(clashing(docs(spark, rows), "src", "size_", "rate", "tilt")).collect()
    assert len(got) == len(rows)
    check(rows, got)


def test_result_does_not_depend_on_partitions(spark):
    def run(n):
        return sorted(repr(tuple(r)) for r in mix(docs(spark, many(200)).repartition(n)).collect())

    assert run(1) == run(7)


def test_rates_tilt_with_size(spark):
    """Within a source that must shrink, longer documents get lower rates; where it must grow, higher ones."""
    rows = [(i, prose(i, 10 if i % 2 else 100), None, "a" if i < 4000 else "b", 0) for i in range(6000)]
    got = mix(docs(spark, rows)).collect()
    rate = defaultdict(lambda: [0, 0])
    for g in got:
        rate[g.source, g.size][0] += g.taken
        rate[g.source, g.size][1] += g.size
    share = {k: a / b for k, (a, b) in rate.items()}
    assert share["a", 100] < share["a", 10] < 1 < share["b", 10] < share["b", 100]


def test_mixed_rows(spark):
    rows = many(150)
    table = clashing(docs(spark, rows), "copies", "size")
    out = mixed(table)
    assert out.columns == table.columns
    got = defaultdict(list)
    for r in out.collect():
        got[r.doc_id].append(len(words(r.text)))
    plan = {g.doc_id: g for g in mix(docs(spark, rows)).collect()}
    for i, g in plan.items():
        assert sorted(got[i]) == sorted([g.size] * g.copies + [g.cut_words] * (g.cut_words > 0))


def test_empty_tables(spark):
    assert mix(docs(spark, [])).count() == 0
    assert mixed(docs(spark, [])).count() == 0
    assert [(g.taken, g.target) for g in mix(docs(spark, [(1, None, None, None, None)])).collect()] == [(0, 0.0)]
