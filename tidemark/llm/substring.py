"""Removal of repeated passages: Rabin-Karp hashes of every window of a fixed number of words, counted in Spark.

The number of windows is that of the words, so sending a row for each through a shuffle costs several times the input.
Windows therefore travel under an *anchor*: of the runs of ``ANCHOR_WORDS`` words in a window, the leftmost with the
smallest hash. Equal windows have equal anchors at equal places, so a window whose anchor occurs once in the corpus
occurs once itself. Neighbouring windows share anchors, which leaves one row for about seven windows. The plan:

1. hash every window, emit the anchors, count them;
2. of the texts that hold anchors that occur more than once, emit the windows under these anchors with their hashes;
3. find each hash's first place, and so the windows that also start earlier;
4. merge what these windows cover into maximal intervals, and cut the intervals out.

A place is one number: that of the document, in the order of identifiers, and the start in it; so the shuffles of step 3
carry two numbers a window. All joins on hashes are between a table of places and a table with one row per hash, so a passage that a third of all
documents share is spread by adaptive execution's handling of skewed joins, and no group of places is ever collected.
Places are collected per document only. Hashes have 64 bits: two different windows among n are taken for equal with a
probability of about n * n / 2 ** 65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, numbered, signed, slices, window_hashes

WINDOW = 20
ANCHOR_WORDS = 8
START_BITS = 28


class _Windows:
    """The windows of a run of texts: where they start, their anchors, and the hashes of anchors and windows."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int, anchor_words: int) -> None:
        self.words = words = Words(data, at)
        self.hashes = hashes = words.hashes()
        self.width = width
        text_of = np.repeat(np.arange(len(at) - 1), words.counts)
        numbers = np.arange(len(hashes))
        self.starts = numbers[numbers + width <= words.first[text_of + 1]] if len(numbers) else numbers
        self.text_of = text_of
        self.grams = window_hashes(hashes, anchor_words)
        if len(self.starts):
            choice = np.lib.stride_tricks.sliding_window_view(self.grams, width - anchor_words + 1)
            self.anchors = self.starts + choice[self.starts].argmin(axis=1)
        else:
            self.anchors = self.starts

    def place(self, numbers: np.ndarray) -> np.ndarray:
        """Word numbers counted in the text."""
        return (numbers - self.words.first[self.text_of[numbers]]).astype(np.int32)


def _anchor_rows(width: int, anchor_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column("row").to_numpy()
            for first, last, data, at in slices(batch.column("text")):
                found = _Windows(data, at, width, anchor_words)
                anchors = np.unique(found.anchors)
                if len(anchors):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(found.grams[anchors])),
                            pa.array(keys[first:last][found.text_of[anchors]]),
                            pa.array(found.place(anchors)),
                        ],
                        ["anchor", "row", "place"],
                    )

    return run


def _window_rows(width: int, anchor_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, places = batch.column("number").to_numpy(), batch.column("places")
            for first, last, data, at in slices(batch.column("text")):
                found = _Windows(data, at, width, anchor_words)
                some = places.slice(first, last - first)
                texts = np.repeat(np.arange(last - first), pa.compute.list_value_length(some).to_numpy(zero_copy_only=False))
                repeated = np.zeros(len(found.hashes) + 1, bool)
                repeated[found.words.first[texts] + some.flatten().to_numpy()] = True
                starts = found.starts[repeated[found.anchors]]
                if len(starts):
                    at_words = found.place(starts).astype(np.int64)
                    if at_words.max() >= 1 << START_BITS:
                        raise ValueError(f"a text has more than {1 << START_BITS} words")
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(signed(window_hashes(found.hashes, width)[starts])),
                            pa.array((numbers[found.text_of[starts] + first] << START_BITS) + at_words),
                        ],
                        ["window", "place"],
                    )

    return run


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                words = Words(data, at)
                starts = batch.column("starts").slice(first, last - first)
                n = len(words.starts)
                change = np.zeros(n + 1, np.int64)
                texts = np.repeat(
                    np.arange(last - first), pa.compute.list_value_length(starts).fill_null(0).to_numpy(zero_copy_only=False)
                )
                covered_from = words.first[texts] + starts.flatten().to_numpy()
                np.add.at(change, covered_from, 1)
                np.add.at(change, covered_from + width, -1)
                gone = np.cumsum(change[:-1]) > 0
                raw = data.tobytes()
                removed, kept, spans = [], [], []
                for i in range(last - first):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    mask = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
                    spans.append([{"start": int(s), "end": int(e)} for s, e in edges.reshape(-1, 2)])
                    removed.append(int(mask.sum()))
                    left = np.flatnonzero(~mask) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(words.starts[left].tolist(), words.ends[left].tolist(), strict=True)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, last - first),
                        pa.array(words.counts.astype(np.int64)),
                        pa.array(removed, pa.int64()),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                        pa.array(kept, pa.binary()),
                    ],
                    ["id", "n_words", "n_removed", "removed", "kept"],
                )

    return run


def remove_repeated(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WINDOW, anchor_words: int = ANCHOR_WORDS
) -> DataFrame:
    """Remove each word covered by a window of ``width`` words whose word sequence also starts earlier.

    Earlier is a smaller identifier (null before all others), or an earlier start in the same document. Windows are
    judged on the input. Returns one row per input row: the identifier, ``n_words``, ``n_removed``, ``removed`` (the
    maximal intervals of word numbers, start inclusive, end exclusive) and ``kept_text`` (the words left, joined by one
    space). Null and empty texts have no words; texts shorter than a window keep all. Rows repeated with one identifier
    and text are one document and get the same result, none removing the other; rows with one identifier and different
    texts are different documents, in an order of their own. An empty table gives an empty result. Other columns are not
    read. A text may have up to ``2 ** START_BITS`` words, which is half a gigabyte at least.
    """
    if not 0 < anchor_words <= width:
        raise ValueError("anchor_words must be between 1 and width")
    scratch = Scratch(docs.sparkSession, "substring")
    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(F.col(id_col), text).alias("row"), F.col(id_col).alias("id"), text.alias("text"))

    anchors = texts.drop("id").mapInArrow(_anchor_rows(width, anchor_words), "anchor long, row long, place int")
    anchors = scratch.write(anchors, "anchors")
    # What repeats is written first: only a join of two plain tables is split where a key is hot.
    repeated = anchors.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor")
    repeated = scratch.write(repeated, "repeated")
    places = anchors.join(repeated, "anchor").groupBy("row").agg(F.collect_set("place").alias("places"))
    places = scratch.write(places, "places")
    scratch.drop("anchors", "repeated")

    held = texts.select("row", "id").join(places.select("row"), "row", "left_semi").distinct()
    order = [F.col("id").isNotNull(), F.col("id"), F.col("row")]
    numbers = scratch.write(numbered(scratch, held, order, "ordered").select("row", "number"), "numbers")
    windows = texts.drop("id").join(places.join(numbers, "row"), "row")
    windows = scratch.write(windows.mapInArrow(_window_rows(width, anchor_words), "window long, place long"), "windows")
    firsts = windows.groupBy("window").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    firsts = scratch.write(firsts.drop("n"), "firsts")
    later = windows.join(firsts, "window").where("place > first")
    start = F.col("place").bitwiseAND(F.lit((1 << START_BITS) - 1)).cast("int")
    starts = later.groupBy(F.shiftright("place", START_BITS).alias("number")).agg(F.collect_set(start).alias("starts"))
    starts = scratch.write(starts.join(numbers, "number").select("row", "starts"), "starts")
    scratch.drop("places", "ordered", "numbers", "windows", "firsts")

    cut = texts.join(starts, "row", "left").drop("row").mapInArrow(
        _cut(width),
        f"id {id_type}, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept binary",
    )
    return cut.select(
        F.col("id").alias(id_col), "n_words", "n_removed", "removed", F.col("kept").cast("string").alias("kept_text")
    )
