from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidemark.llm.exact import exact_dedup, exact_groups

from .data import awkward, clashing, docs


@pytest.mark.parametrize("largest", [True, False])
@pytest.mark.parametrize("bits", [(6, 3), (4, 1), (1, 1)])
def test_groups_match_plain_version(spark, largest, bits):
    rows = awkward()
    got = exact_groups(clashing(docs(spark), "keep", "slot", "sha"), largest=largest, slot_bits=bits[0], round_bits=bits[1]).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    choose = max if largest else min
    want = sorted(
        repr((r[0], choose([x for x in groups[r[1] or ""] if x is not None], default=None), len(groups[r[1] or ""]), hashlib.sha256((r[1] or "").encode()).hexdigest()))
        for r in rows
    )
    assert sorted(repr((g.doc_id, g.keep_id, g.group_size, g.text_sha256)) for g in got) == want
    kept = [g for g in got if g.kept]
    assert len(kept) == len(groups) == len({g.text_sha256 for g in kept})
    assert all(g.doc_id == g.keep_id for g in kept)


def test_dedup_keeps_columns_and_one_row_per_text(spark):
    table = clashing(docs(spark), "sha", "n")
    out = exact_dedup(table)
    assert out.columns == table.columns
    assert out.count() == out.select(F.coalesce("text", F.lit(""))).distinct().count() == len({r[1] or "" for r in awkward()})


def test_a_large_group_is_one_entry_per_run(spark):
    rows = [(i, "same" if i % 3 else f"text {i}", None, None, None) for i in range(3000)]
    got = exact_groups(docs(spark, rows).repartition(16)).where("kept").collect()
    assert len(got) == 1001
    assert next(g for g in got if g.group_size > 1).doc_id == 2999


def test_empty_table(spark):
    assert exact_groups(docs(spark, [])).count() == 0
    assert exact_dedup(docs(spark, [])).count() == 0
