from __future__ import annotations

import zlib

import corpus_pipeline
from tidemark.llm import quality
from tidemark.llm.common import Scratch

from .data import DOCS, prose, words
from .test_jaccard import shingles


def tables(spark, folder):
    """Clean documents, junk, exact and near copies, all labelled but for the copies."""
    rows, labels = [], []
    for i in range(300):
        junk = i % 5 == 0
        text = " | ".join(f"w{(i * 7 + j) % 50}" for j in range(50)) + f" | {i}" if junk else prose(i, 40 + i % 60, 3000)
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, int(not junk), 0))
    for i in range(1, 60, 7):
        if i % 5:
            rows += [(1000 + i, rows[i][1], "en", "s1", 0), (1100 + i, rows[i][1], "en", None, 0)]
    for i in range(2, 60, 9):
        if i % 5:
            rows.append((2000 + i, rows[i][1] + " more", "en", "s2", 0))
    rows += [(3000, "", None, None, None), (3001, None, None, None, None), rows[1], rows[1]]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_against_plain_versions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quality, "Settings", lambda: quality_settings)
    rows = tables(spark, str(tmp_path))
    scratch = Scratch(spark, "test")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = scratch.write(stage(spark, docs, str(tmp_path)), name)
        kept[name] = docs.collect()
        if name != "best_fit_packing":
            assert docs.columns == columns

    # The classifier: junk of the held-out fold goes, clean documents stay.
    left = {r.doc_id for r in kept["quality_filter"]}
    junk = [i for i in range(300) if i % 5 == 0 and zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(i in left for i in junk) <= len(junk) * 0.1
    clean = [r[0] for r in rows if r[0] % 5 and r[0] < 300]
    assert sum(i not in left for i in clean) <= len(clean) * 0.02

    # Exact: one row per text, with the largest identifier.
    largest = {}
    for r in kept["quality_filter"]:
        largest[r.text or ""] = max(largest.get(r.text or "", -1), r.doc_id)
    assert sorted(r.doc_id for r in kept["exact_dedup"]) == sorted(largest.values())

    # Near: one document per component of links, the smallest.
    before = sorted(kept["exact_dedup"], key=lambda r: r.doc_id)
    sets = [shingles(r.text, 5) for r in before]
    group = list(range(len(before)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(before)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                group[max(top(i), top(j))] = min(top(i), top(j))
    assert sorted(r.doc_id for r in kept["near_dedup"]) == [before[i].doc_id for i in range(len(before)) if top(i) == i]

    # The mix holds whole copies of what was left, up to three, and at most one cut copy per source.
    whole = {r.doc_id: r.text or "" for r in kept["near_dedup"]}
    cuts = []
    for r in kept["mix_sources"]:
        assert r.n_chars is None and r.text is None or r.n_chars == len(r.text)
        if (r.text or "") != whole[r.doc_id]:
            assert words(r.text) == words(whole[r.doc_id])[: len(words(r.text))]
            cuts.append(r.source)
    assert len(cuts) == len(set(cuts))

    # Packing places all words of the mix.
    assert sum(r.words for r in kept["best_fit_packing"]) == sum(len(words(r.text)) for r in kept["mix_sources"])


quality_settings = quality.Settings(train_docs=200, filters=8, hidden=6, epochs=6)


def test_run_over_empty_tables(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
