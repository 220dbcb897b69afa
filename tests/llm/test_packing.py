from __future__ import annotations

import random
from collections import defaultdict

import pytest

from tidemark.llm.packing import best_fit, bin_cost, pack, texts

from .data import awkward, clashing, docs, prose, words


def check(rows, got, lengths):
    bins, pieces = defaultdict(list), defaultdict(list)
    for g in got:
        if g.words:
            bins[g.bin_id].append(g)
        else:
            assert g.bin_id is None
        pieces[g.doc_id].append(g)
    for held in bins.values():
        held.sort(key=lambda g: g.offset)
        end = 0
        for g in held:
            assert g.offset == end
            end += g.words
        assert {g.filled for g in held} == {end}
        # Downsized to its contents.
        assert {g.capacity for g in held} == {min(c for c in lengths if c >= end)}
    placed, wanted = defaultdict(int), defaultdict(int)
    for g in got:
        placed[g.doc_id] += g.words
    for r in rows:
        wanted[r[0]] += len(words(r[1]))
    assert placed == wanted


@pytest.mark.parametrize(("lengths", "group"), [((512, 1024, 2048, 4096), 50_000), ((7, 64), 20), ((1,), 50_000)])
def test_every_word_is_placed_once(spark, lengths, group):
    rows = [r for r in awkward() if len(r[1] or "") < 50_000 or lengths != (1,)]
    table = clashing(docs(spark, rows), "row", "size", "piece", "part")
    check(rows, pack(table, lengths=lengths, group_pieces=group).collect(), lengths)


def test_pieces_of_a_long_text(spark):
    got = pack(docs(spark, [(1, prose(1, 10_000), None, None, None)]), lengths=(512, 4096)).collect()
    assert sorted((g.piece, g.start, g.words) for g in got) == [(0, 0, 4096), (1, 4096, 4096), (2, 8192, 1808)]


def test_texts_of_sequences(spark):
    rows = [(i, prose(i, 5 + i * 31 % 90), None, None, None) for i in range(60)]
    table = docs(spark, rows)
    packed = pack(table, lengths=(64, 128))
    held = {r.bin_id: r.words.split(" ") for r in texts(table, packed).collect()}
    for g in packed.collect():
        assert held[g.bin_id][g.offset : g.offset + g.words] == words(rows[g.doc_id][1])[g.start : g.start + g.words]


def test_texts_where_rows_share_an_identifier_or_have_none(spark):
    """A cut copy beside whole ones, as of ``mixing.mixed``, other texts under one identifier, and null identifiers."""
    whole = prose(1, 90)
    made = [(1, whole), (1, whole), (1, " ".join(whole.split()[:20])), (1, prose(2, 40)), (None, prose(3, 70)), (None, prose(4, 15)), (2, None)]
    table = docs(spark, [(*r, None, None, None) for r in made])
    packed = pack(table, lengths=(32, 64))
    found = texts(table, packed).collect()
    assert sorted(w for r in found for w in r.words.split(" ")) == sorted(w for _, t in made for w in words(t))
    held = {r.bin_id: r.words.split(" ") for r in found}
    assert all(len(held[g.bin_id]) == g.filled for g in packed.where("bin_id IS NOT NULL").collect())


def test_joint_lengths_cost_no_more_than_any_one(spark):
    rng = random.Random(4)
    lengths = (64, 128, 256)
    for _ in range(20):
        sizes = sorted((min(256, int(rng.expovariate(1 / 50)) + 1) for _ in range(rng.randrange(1, 300))), reverse=True)
        costs = []
        for longest in lengths:
            where, capacity = best_fit(sizes, lengths, longest)
            filled = defaultdict(int)
            for b, s in zip(where, sizes, strict=True):
                filled[b] += s
            assert all(filled[b] <= c for b, c in enumerate(capacity))
            costs.append(sum(map(bin_cost, capacity)))
        _, only = best_fit(sizes, (256,), 256)
        assert min(costs) <= sum(map(bin_cost, only))


def test_best_fit_leaves_the_least_room():
    where, capacity = best_fit([70, 60, 30, 28, 12], (100,), 100)
    assert where == [0, 1, 0, 1, 1] and capacity == [100, 100]


def test_empty_table(spark):
    assert pack(docs(spark, [])).count() == 0
    with pytest.raises(ValueError, match="positive"):
        pack(docs(spark, []), lengths=())


def naive_best_fit(sizes, lengths, longest, overhead):
    """Look at every open bin for every piece: the least room that fits, the bin last changed among equal ones."""
    bins, where = [], []  # of each bin: length, words in it, when it was changed
    for step, size in enumerate(sizes):
        fitting = [(length - used, -changed, i) for i, (length, used, changed) in enumerate(bins) if length - used >= size]
        if fitting:
            i = min(fitting)[2]
        else:
            left = sum(sizes[step:])
            allowed = [c for c in lengths if size <= c <= longest] or [min(c for c in lengths if c >= size)]
            cost = {c: (c + overhead) / max(1, min(c, left)) for c in allowed}
            bins.append([min(allowed, key=lambda c: (cost[c], c)), 0, step])
            i = len(bins) - 1
        bins[i][1:] = [bins[i][1] + size, step]
        where.append(i)
    return where, [min(c for c in lengths if c >= used) for _, used, _ in bins]


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_matches_a_scan_of_all_bins(seed):
    rng = random.Random(seed)
    lengths = tuple(sorted(rng.sample(range(1, 60), rng.randrange(1, 5))))
    sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(rng.randrange(120))), reverse=True)
    overhead = rng.choice([0, 3, 16])
    for longest in lengths:
        assert best_fit(sizes, lengths, longest, overhead) == naive_best_fit(sizes, lengths, longest, overhead)
