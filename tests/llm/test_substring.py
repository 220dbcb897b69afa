from __future__ import annotations

import pytest

from tidemark.llm.substring import remove_repeated

from .data import awkward, clashing, docs, prose, words


def plain(rows, width):
    """Distinct documents in order; a window is removed if its words start earlier."""
    order = sorted({(r[0], r[1] or "") for r in rows}, key=lambda r: (r[0] is not None, r[0] or 0))
    first: dict[tuple, tuple] = {}
    out = {}
    for n, (doc, text) in enumerate(order):
        found = words(text)
        gone = set()
        for i in range(len(found) - width + 1):
            seq = tuple(found[i : i + width])
            if first.setdefault(seq, (n, i)) != (n, i):
                gone.update(range(i, i + width))
        out[doc, text] = (len(found), len(gone), " ".join(w for i, w in enumerate(found) if i not in gone))
    return out


@pytest.mark.parametrize(("width", "anchor"), [(20, 8), (5, 2), (3, 3), (1, 1)])
def test_matches_plain_version(spark, width, anchor):
    rows = [r for r in awkward() if r[0] is not None]
    want = plain(rows, width)
    table = clashing(docs(spark, rows), "row", "id", "place", "starts")
    got = remove_repeated(table, width=width, anchor_words=anchor).collect()
    assert len(got) == len(rows)
    text_of = {r[0]: r[1] or "" for r in rows}
    for g in got:
        assert (g.n_words, g.n_removed, g.kept_text) == want[g.doc_id, text_of[g.doc_id]]


def test_intervals_are_maximal(spark):
    passage = prose(1, 60)
    rows = [(1, passage, None, None, None), (2, f"a b {passage} c", None, None, None), (3, f"{prose(1, 30)} x {prose(9, 10)}", None, None, None)]
    got = {g.doc_id: [(s.start, s.end) for s in g.removed] for g in remove_repeated(docs(spark, rows)).collect()}
    assert got == {1: [], 2: [(2, 62)], 3: [(0, 30)]}


def test_a_passage_in_very_many_documents(spark):
    passage = prose(1, 55)
    rows = [(i, f"{prose(100 + i, 30)} {passage} {prose(900 + i, 5)}", None, None, None) for i in range(400)]
    got = remove_repeated(docs(spark, rows).repartition(8)).collect()
    assert all(g.n_removed >= 55 for g in got if g.doc_id) and next(g.n_removed for g in got if not g.doc_id) == 0
    want = plain(rows, 20)
    assert all((g.n_words, g.n_removed, g.kept_text) == want[g.doc_id, rows[g.doc_id][1]] for g in got)


def test_null_identifier_comes_first(spark):
    text = prose(1, 30)
    got = remove_repeated(docs(spark, [(5, text, None, None, None), (None, text, None, None, None)])).collect()
    assert {g.doc_id: g.n_removed for g in got} == {None: 0, 5: 30}


def test_empty_table(spark):
    assert remove_repeated(docs(spark, [])).count() == 0
