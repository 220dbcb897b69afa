"""Quality classifier: a byte-level convolutional network in numpy.

Bytes are embedded; learned filters look at overlapping chunks of ``CHUNK`` bytes, one every ``HOP`` bytes, over the whole
document; their responses are max-pooled over overlapping segments of ``2 * HALF`` bytes, mapped by a hidden layer that can
notice which responses a segment has and lacks (junk that repeats itself lacks most), max-pooled over the document, and
combined into one probability. There is no length limit: a document is a run of as many chunks as it needs.

The network is trained in one task on a bounded sample of whole labelled documents: at most ``Settings.train_docs`` of
them with at most ``Settings.sample_bytes`` bytes together. Junk is rarer than text and counts ``Settings.junk_weight``
times, which puts unsure documents in the middle of the scale. Scoring is a map over all whole documents without a
shuffle; the model of some thousand numbers travels with the task.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import slices

HOP = 4
SPAN = 4
CHUNK = HOP * SPAN
HALF = 64
HOPS = HALF // HOP
PAD = 0


@dataclass(frozen=True)
class Settings:
    train_docs: int = 5000
    sample_bytes: int = 20_000_000
    step_bytes: int = 500_000
    width: int = 8
    filters: int = 32
    hidden: int = 24
    epochs: int = 8
    batch: int = 32
    rate: float = 4e-3
    decay: float = 1e-4
    junk_weight: float = 5.0
    jitter: int = 32
    seed: int = 7


class Layout:
    """Documents side by side, each padded by zeros to whole halves of a segment."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        sizes = np.diff(at)
        halves = -(-(sizes + (SPAN - 1) * HOP) // HALF)
        halves = np.maximum(halves, 1)
        begins = np.concatenate(([0], np.cumsum(halves)))
        self.codes = np.full(begins[-1] * HALF, PAD, np.uint8)
        shift = np.repeat(begins[:-1] * HALF - at[:-1], sizes)
        self.codes[np.arange(len(data)) + shift] = data
        # The last hops of a document lie in its padding but reach into the next document: they count for nothing.
        ends = begins[1:] * HOPS
        self.void = np.concatenate([ends - i for i in range(1, SPAN)])
        # A segment is a half and the next one of the same document, or the only half.
        last = np.zeros(begins[-1], bool)
        last[begins[1:] - 1] = True
        single = np.zeros(begins[-1], bool)
        single[begins[:-1][halves == 1]] = True
        self.left = np.flatnonzero(~last | single)
        self.right = np.where(single[self.left], self.left, self.left + 1)
        self.first = np.searchsorted(self.left, begins[:-1])


class Network:
    def __init__(self, settings: Settings) -> None:
        rng = np.random.default_rng(settings.seed)
        d, f, h = settings.width, settings.filters, settings.hidden

        def normal(*shape: int, scale: float) -> np.ndarray:
            return rng.normal(0, scale, shape).astype(np.float32)

        self.values = {
            "bytes": normal(256, d, scale=1.0),
            "filters": normal(SPAN, HOP * d, f, scale=(2 / (CHUNK * d)) ** 0.5),
            "filter_bias": np.zeros(f, np.float32),
            "hidden": normal(f, h, scale=(2 / f) ** 0.5),
            "hidden_bias": np.full(h, 0.1, np.float32),
            "out": normal(h, scale=(1 / h) ** 0.5),
            "out_bias": np.zeros(1, np.float32),
        }

    def forward(self, layout: Layout) -> dict[str, np.ndarray]:
        v = self.values
        rows = v["bytes"][layout.codes].reshape(-1, HOP * v["bytes"].shape[1])
        conv = rows @ v["filters"][0]
        for i in range(1, SPAN):
            conv[:-i] += rows[i:] @ v["filters"][i]
        conv += v["filter_bias"]
        np.maximum(conv, 0, out=conv)
        conv[layout.void] = 0
        pooled = conv.reshape(-1, HOPS, conv.shape[1])
        halves = pooled.max(axis=1)
        segments = np.maximum(halves[layout.left], halves[layout.right])
        hidden = np.maximum(segments @ v["hidden"] + v["hidden_bias"], 0)
        docs = np.maximum.reduceat(hidden, layout.first, axis=0)
        logit = docs @ v["out"] + v["out_bias"]
        return {"rows": rows, "pooled": pooled, "halves": halves, "segments": segments, "hidden": hidden, "docs": docs, "logit": logit}

    def score(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probabilities, rounded to what does not depend on which texts are multiplied together."""
        logit = self.forward(Layout(data, at))["logit"].astype(np.float64)
        return np.round(1 / (1 + np.exp(-np.clip(logit, -30, 30))), 6)

    def gradients(self, layout: Layout, labels: np.ndarray, junk_weight: float = 1.0, rows: int | None = None) -> dict[str, np.ndarray]:
        """Of the mean log loss over ``rows`` rows, these alone by default; a row of label 0 counts ``junk_weight`` times.

        Max-pooling passes a gradient to the place the maximum came from.
        """
        v, s = self.values, self.forward(layout)
        n, width = rows or len(labels), v["bytes"].shape[1]
        weight = np.where(labels > 0.5, 1.0, junk_weight) / n
        d_logit = ((1 / (1 + np.exp(-np.clip(s["logit"], -30, 30))) - labels) * weight).astype(np.float32)
        out = {"out": s["docs"].T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}

        # Where each document's maxima of the hidden layer are.
        bounds = np.append(layout.first, len(layout.left))
        where = np.stack([s["hidden"][a:b].argmax(axis=0) + a for a, b in zip(bounds[:-1], bounds[1:], strict=True)])
        d_docs = d_logit[:, None] * v["out"][None, :] * (s["docs"] > 0)
        used, inverse = np.unique(where, return_inverse=True)
        d_hidden = np.zeros((len(used), v["out"].shape[0]), np.float32)
        np.add.at(d_hidden, (inverse.reshape(where.shape), np.arange(where.shape[1])[None, :]), d_docs)
        segments = s["segments"][used]
        out["hidden"] = segments.T @ d_hidden
        out["hidden_bias"] = d_hidden.sum(axis=0)

        d_segments = (d_hidden @ v["hidden"].T) * (segments > 0)
        left, right = layout.left[used], layout.right[used]
        half = np.where(s["halves"][left] >= s["halves"][right], left[:, None], right[:, None])
        f = np.arange(segments.shape[1])[None, :]
        hop = half * HOPS + s["pooled"][half, :, f].argmax(axis=2)
        out["filter_bias"] = d_segments.sum(axis=0)
        g = np.zeros_like(v["filters"])
        d_bytes = np.zeros_like(v["bytes"])
        flat_g, flat_f = d_segments.ravel(), np.broadcast_to(f, hop.shape).ravel()
        codes = layout.codes.reshape(-1, HOP)
        for i in range(SPAN):
            at = np.minimum(hop.ravel() + i, len(s["rows"]) - 1)
            weighted = s["rows"][at] * flat_g[:, None]
            for j in range(len(g[i, 0])):
                g[i, :, j] = weighted[flat_f == j].sum(axis=0)
            d_rows = (v["filters"][i].T[flat_f] * flat_g[:, None]).reshape(-1, HOP, width)
            seen = codes[at].ravel()
            for k in range(width):
                d_bytes[:, k] += np.bincount(seen, d_rows[:, :, k].ravel(), 256).astype(np.float32)
        out["filters"], out["bytes"] = g, d_bytes
        return out

    def train(self, texts: list[bytes], labels: np.ndarray, settings: Settings) -> None:
        """Adam over shuffled batches, with a rate that falls to zero."""
        rng = np.random.default_rng(settings.seed + 1)
        first = {k: np.zeros_like(x) for k, x in self.values.items()}
        second = {k: np.zeros_like(x) for k, x in self.values.items()}
        steps = max(1, settings.epochs * -(-len(texts) // settings.batch))
        share = np.clip(labels.mean() if len(labels) else 0.5, 0.02, 0.98)
        self.values["out_bias"][:] = np.log(share / (1 - share))
        step = 0
        for _ in range(settings.epochs):
            order = rng.permutation(len(texts))
            for start in range(0, len(order), settings.batch):
                chosen = order[start : start + settings.batch]
                # Another alignment of text and chunks each time.
                cuts = rng.integers(0, settings.jitter + 1, len(chosen))
                parts = [np.frombuffer(texts[i], np.uint8)[c if len(texts[i]) > 4 * c else 0 :] for i, c in zip(chosen, cuts, strict=True)]
                # Long texts are taken one after the other, so that memory holds ``step_bytes`` or one text.
                grads: dict[str, np.ndarray] = {}
                for a, b in runs_of([len(x) for x in parts], settings.step_bytes):
                    at = np.concatenate(([0], np.cumsum([len(x) for x in parts[a:b]])))
                    layout = Layout(np.concatenate(parts[a:b]), at)
                    for k, x in self.gradients(layout, labels[chosen[a:b]], settings.junk_weight, len(chosen)).items():
                        grads[k] = grads[k] + x if k in grads else x
                step += 1
                rate = settings.rate * min(1.0, step / 20) * (1 - step / (steps + 1))
                for k, x in self.values.items():
                    first[k] = 0.9 * first[k] + 0.1 * grads[k]
                    second[k] = 0.99 * second[k] + 0.01 * grads[k] ** 2
                    change = first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
                    x -= (rate * (change + settings.decay * x)).astype(np.float32)

    def dumps(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, **self.values)
        return held.getvalue()

    @classmethod
    def loads(cls, raw: bytes) -> Network:
        made = cls.__new__(cls)
        with np.load(io.BytesIO(raw), allow_pickle=False) as held:
            made.values = {k: held[k] for k in held.files}
        return made


def runs_of(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs (first, last + 1) of neighbours whose sizes add up to ``limit`` at most, or of one that is larger."""
    out, first, total = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and total + size > limit:
            out.append((first, i))
            first, total = i, 0
        total += size
    return [*out, (first, len(sizes))] if sizes else []


class Sample:
    """Whole texts with their labels, in the order they come in, as long as they fit into ``limit`` bytes."""

    def __init__(self, limit: int) -> None:
        self.left = limit
        self.texts: list[bytes] = []
        self.labels: list[int] = []

    def add(self, text: str | None, label: int) -> None:
        raw = (text or "").encode("utf-8", "surrogatepass")
        if len(raw) <= self.left:
            self.left -= len(raw)
            self.texts.append(raw)
            self.labels.append(label)


def held_out(id_column: Column) -> Column:
    """The fold that is never learned from."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", settings: Settings | None = None
) -> bytes | None:
    """Train on labelled documents outside the held-out fold; None if there are none.

    The sample is bounded: of the labels that belong to a document, the ``train_docs`` that come first in the order of a
    hash of the identifier, and of those, in that order, each whose whole text fits into what is left of
    ``sample_bytes``. Labels that are null, neither 0 nor 1, or of documents that are not in the table, and null
    identifiers, take no part. A label given twice counts as 1 if one of them is; of texts that share an identifier the
    smallest is learned from; null texts count as empty.
    """
    settings = settings or Settings()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    order = [F.xxhash64("id", F.lit(settings.seed)), F.col("id")]
    chosen = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where(F.col("id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .join(texts.select("id"), "id", "left_semi")
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(*order)
        .limit(settings.train_docs)
    )
    # The sample has train_docs rows at most, whatever the size of the tables.
    rows = texts.join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text"))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sample = Sample(settings.sample_bytes)
        for part in parts:
            for text, label in zip(part["text"], part["label"], strict=True):
                sample.add(text, label)
        if sample.texts:
            network = Network(settings)
            network.train(sample.texts, np.array(sample.labels, np.float32), settings)
            yield pd.DataFrame({"model": [network.dumps()]})

    found = rows.repartition(1).sortWithinPartitions(*order).select("text", "label").mapInPandas(fit, "model binary").collect()
    return bytes(found[0]["model"]) if found else None


def score(docs: DataFrame, model: bytes | None, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Add the probability of label 1 to each row, from its whole text alone.

    Null counts as empty, and an empty text has a score like any other. Without a model all scores are 0.5. All columns
    are kept; one named like the score is replaced. An empty table gives an empty result.
    """
    others = [c for c in docs.columns if c != score_col]
    if model is None:
        return docs.select(*[F.col(f"`{c}`") for c in others], F.lit(0.5).alias(score_col))
    at = others.index(text_col)
    names = [f"c{i}" for i in range(len(others))]
    plain = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(others, names, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network.loads(model)
        for batch in batches:
            scores = [network.score(data, begins) for _, _, data, begins in slices(batch.column(at), 1 << 19)]
            column = pa.array(np.concatenate(scores) if scores else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, column], [*names, "score"])

    kinds = ", ".join(f"{n} {plain.schema[n].dataType.simpleString()}" for n in names)
    scored = plain.mapInArrow(run, f"{kinds}, score double")
    return scored.select(*[F.col(n).alias(c) for n, c in zip(names, others, strict=True)], F.col("score").alias(score_col))
