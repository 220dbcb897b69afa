from __future__ import annotations

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import CHUNK, HALF, HOP, SPAN, Layout, Network, Sample, Settings, held_out, runs_of, score, train

from .data import awkward, clashing, docs, prose

SMALL = Settings(train_docs=300, filters=8, hidden=6, epochs=6)


def network(seed=3):
    return Network(Settings(filters=5, hidden=4, width=3, seed=seed))


def flat(texts):
    parts = [np.frombuffer(t, np.uint8) for t in texts]
    return np.concatenate([*parts, np.zeros(0, np.uint8)]), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


def test_scores_do_not_depend_on_neighbours():
    texts = [b"", b"a", b"abc " * 50, b"x" * (HALF - 12), b"y" * HALF, bytes(range(256)) * 20, b"z" * (3 * HALF + 1)]
    n = network()
    together = n.score(*flat(texts))
    alone = np.concatenate([n.score(*flat([t])) for t in texts])
    assert np.allclose(together, alone, atol=1e-6) and ((together > 0) & (together < 1)).all()


def test_every_part_of_a_text_counts():
    """A byte sequence that a filter answers to raises the score wherever it stands."""
    n = network()
    n.values["bytes"][0xF0:] *= 30
    for name in ("hidden", "out"):
        n.values[name] = np.abs(n.values[name])
    base = b"the of and " * 400
    mark = b"\xff\xfe\xfd\xfc" * 8
    scores = [float(n.score(*flat([base[:i] + mark + base[i + len(mark) :]]))[0]) for i in range(0, len(base) - 64, 64)]
    plain = float(n.score(*flat([base]))[0])
    assert all(s > plain for s in scores)


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    n = network()
    n.values = {k: x.astype(np.float64) for k, x in n.values.items()}
    texts = [bytes(rng.integers(32, 120, size).astype(np.uint8)) for size in (5, 90, 400)]
    layout, labels = Layout(*flat(texts)), np.array([1.0, 0.0, 1.0])

    def loss():
        z = n.forward(layout)["logit"]
        return float(np.mean(np.logaddexp(0, z) - labels * z))

    grads = n.gradients(layout, labels)
    for name, values in n.values.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, s)) for s in values.shape)
            if name == "bytes":
                at = (texts[1][int(rng.integers(0, 90))], at[1])
            old, step = values[at], 1e-5
            values[at] = old + step
            up = loss()
            values[at] = old - step
            down = loss()
            values[at] = old
            assert grads[name][at] == pytest.approx((up - down) / (2 * step), abs=2e-5)


def plain_score(n, text):
    """The network written with loops: chunk by chunk, segment by segment."""
    v = {k: x.astype(float) for k, x in n.values.items()}
    halves = max(1, -(-(len(text) + (SPAN - 1) * HOP) // HALF))
    padded = list(text) + [0] * (halves * HALF - len(text))
    pooled = []
    for half in range(halves):
        best = np.zeros(v["filters"].shape[2])
        for start in range(half * HALF, (half + 1) * HALF, HOP):
            chunk = padded[start : start + CHUNK]
            if len(chunk) < CHUNK:
                continue
            sums = v["filter_bias"].copy()
            for i in range(SPAN):
                sums += np.concatenate([v["bytes"][c] for c in chunk[i * HOP : (i + 1) * HOP]]) @ v["filters"][i]
            best = np.maximum(best, sums)
        pooled.append(best)
    segments = [np.maximum(a, b) for a, b in zip(pooled, pooled[1:], strict=False)] or pooled
    hidden = np.max([np.maximum(s @ v["hidden"] + v["hidden_bias"], 0) for s in segments], axis=0)
    return 1 / (1 + np.exp(-(hidden @ v["out"] + v["out_bias"][0])))


@pytest.mark.parametrize("size", [0, 1, 15, 16, 51, 52, 53, 63, 64, 65, 128, 5_000, 100_000])
def test_scores_match_the_plain_network(size):
    n = network()
    n.values["filter_bias"] += 0.05
    text = bytes(np.random.default_rng(size).integers(1, 256, size).astype(np.uint8))
    assert float(n.score(*flat([text]))[0]) == pytest.approx(plain_score(n, text), abs=1e-5)


def test_sample_holds_whole_texts():
    sample = Sample(100)
    for text, label in (("x" * 60, 1), ("y" * 50, 0), (None, 1), ("z" * 40, 0), ("", 1), ("w", 1)):
        sample.add(text, label)
    assert sample.texts == [b"x" * 60, b"", b"z" * 40, b""] and sample.labels == [1, 1, 0, 1]


def test_long_texts_of_a_batch_are_taken_in_turn():
    assert runs_of([], 10) == [] and runs_of([3, 4, 50, 1, 2, 9], 10) == [(0, 2), (2, 3), (3, 5), (5, 6)]
    texts = [bytes(np.random.default_rng(i).integers(32, 120, 200 + 90 * i).astype(np.uint8)) for i in range(12)]
    labels = np.array([i % 2 for i in range(12)], np.float32)
    whole, parts = network(), network()
    whole.train(texts, labels, Settings(epochs=2, batch=12, step_bytes=10**9))
    parts.train(texts, labels, Settings(epochs=2, batch=12, step_bytes=700))
    assert all(np.allclose(whole.values[k], parts.values[k], atol=1e-4) for k in whole.values)


def test_labels_without_a_document_use_up_nothing(spark):
    table, labels = labelled(spark, 60)
    strangers = spark.range(10**6, 10**6 + 5000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    few = Settings(train_docs=60, filters=8, hidden=6, epochs=1)
    assert train(table, labels.unionAll(strangers), settings=few) == train(table, labels, settings=few)


def labelled(spark, n=400):
    rows, marks = [], []
    for i in range(n):
        good = i % 3 != 0
        text = prose(i, 60) if good else " | ".join(f"w{(i * 7 + j) % 50}" for j in range(50))
        rows.append((i, text, "en", "s", len(text)))
        marks.append((i, int(good)))
    return docs(spark, rows), spark.createDataFrame(marks, "doc_id long, quality int")


def test_learns_and_leaves_the_held_out_fold_alone(spark):
    table, labels = labelled(spark)
    model = train(table, labels, settings=SMALL)
    # Labels of the held-out fold change nothing.
    turned = labels.withColumn("quality", F.when(held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert train(table, turned, settings=SMALL) == model
    got = score(table, model).join(labels, "doc_id").where(held_out(F.col("doc_id"))).collect()
    assert np.mean([(g.score >= 0.3) == (g.quality == 1) for g in got]) > 0.95
    assert {g.doc_id for g in got} == {i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_scores_use_the_text_alone(spark):
    table, labels = labelled(spark, 100)
    model = train(table, labels, settings=SMALL)
    other = table.select((F.col("doc_id") + 1000).alias("doc_id"), "text", F.lit("xx").alias("lang"), F.lit(None).cast("string").alias("source"), F.lit(0).alias("n_chars"))
    assert sorted(r.score for r in score(table, model).collect()) == sorted(r.score for r in score(other, model).collect())


def test_awkward_rows_and_missing_labels(spark):
    table = clashing(docs(spark), "score", "c0", "label")
    labels = spark.createDataFrame([(None, 1), (1, None), (4, 7), (10, 1), (10, 1), (13, 0), (10**6, 0)], "doc_id long, quality int")
    model = train(table, labels, settings=SMALL)
    assert model
    got = score(table, model)
    assert sorted(got.columns) == sorted(table.columns)
    rows = got.collect()
    assert len(rows) == len(awkward()) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if not r.text}
    assert len(empty) == 1
    assert train(table, labels.where("doc_id IS NULL"), settings=SMALL) is None
    assert train(table, labels.where("doc_id > 500"), settings=SMALL) is None
    assert train(docs(spark, []), labels, settings=SMALL) is None
    assert {r.score for r in score(table, None).collect()} == {0.5}
    assert score(docs(spark, []), model).count() == 0
