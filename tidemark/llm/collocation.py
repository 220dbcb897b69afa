"""Collocations by the stripes pattern: phrases that occur more often than their parts let expect.

A *stripe* belongs to a prefix, the first word, and counts for each continuation of up to ``LONGEST - 1`` words how often it
follows. One structure gives all that is needed: its entries are the counts of all phrases that begin with the word, those
of an entry's beginnings are the totals of longer prefixes, its total is the count of the word itself, and an entry one word
longer is what can subsume a phrase. Every task makes the stripes of its texts and adds equal ones up as it goes; stripes are
then merged elementwise in Spark, those of up to ``2 ** FAN_BITS`` tasks at a time. Stripes of words that occur ``HOT``
times or more are split into ``SEGMENTS`` by the word that follows.

A phrase can be frequent only if its parts are. Before stripes are made, the phrases of each length are counted, length by
length, in hash classes, in which different phrases may share a class, and only phrases of classes with enough occurrences
go on: rare ones, which are most, are not shuffled as words. Classes are as many as the texts' size asks for, up to
``2 ** MOST_BITS``; one bit for each is broadcast, so 32 megabytes a length at most. That only saves work: all counts that
matter are those of the stripes, by the words themselves. A corpus too large for the classes shuffles all its phrases.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _BASE, _STEP, Scratch, _spans, mix, shuffles_removed, slices

LONGEST = 4
LEAST = 30
KEPT = 2000
FACTOR = 2_000_000
SUBSUMED_PERCENT = 80

FAN_BITS = 8
SEGMENTS = 64
HOT = 1 << 20
HOT_BITS = 20
LEAST_BITS, MOST_BITS = 16, 28
BLOCK_BITS = 16
BYTES_A_CLASS = 32
BUFFERED = 1 << 21
BUFFERED_ENTRIES = 3 << 19
BATCH_ROWS = 4096
TOP_GROUP = 200_000
SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_LANG_STEP = 0xA0761D6478BD642F | 1
_NEXT_STEP = 0xE7037ED1A0B428DB | 1


class Phrases:
    """The words and phrases of a run of texts; a phrase lies in one piece of a text, and pieces end at separators."""

    def __init__(self, data: np.ndarray, at: np.ndarray, langs: pa.Array) -> None:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        n = len(data)
        cuts = np.isin(data, np.frombuffer(SEPARATORS, np.uint8))
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~(cuts | (data == 32) | (data == 9))
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1])).astype(np.int64)
        ends = (np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1).astype(np.int64)
        text_of = np.repeat(np.arange(len(at) - 1), np.diff(np.searchsorted(starts, at)))
        before = np.concatenate(([0], np.cumsum(cuts)))
        #: Whether the next word is in the same piece.
        self.joined = np.zeros(len(starts), bool)
        self.joined[:-1] = (before[starts[1:]] == before[ends[:-1]]) & (text_of[1:] == text_of[:-1])
        self.langs = langs.dictionary_encode()
        lang = self.langs.indices.to_numpy().astype(np.int64)[text_of]
        if len(starts):
            # Words and what lies between them, in turn, as one array of spans: equal words get one number by their bytes.
            spans = np.stack([starts, ends], axis=1).ravel()
            spans = pa.LargeStringArray.from_buffers(2 * len(starts) - 1, pa.py_buffer(spans), pa.py_buffer(np.ascontiguousarray(data)))
            coded = spans.dictionary_encode()
            words, codes = coded.dictionary, coded.indices.to_numpy()[::2].astype(np.int64)
        else:
            words, codes = pa.array([], pa.large_string()), np.zeros(0, np.int64)
        #: The same word in two languages is two.
        self.kinds, self.words = np.unique(lang * max(len(words), 1) + codes, return_inverse=True)
        self.lang_of, self.word_of = self.kinds // max(len(words), 1), self.kinds % max(len(words), 1)
        self.dictionary = words
        self.hash_of = mix(_hashes(words)[self.word_of] + _hashes(self.langs.dictionary)[self.lang_of] * np.uint64(_LANG_STEP))

    def grown(self, maybe: list[np.ndarray], to: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For lengths 1 to ``to``: number of each place's phrase, then hashes and first places of the phrases.

        Phrases are those of classes marked in ``maybe`` as far as there is one for the length, and of such parts.
        """
        places, numbers = np.arange(len(self.words)), self.words
        hashes, first = self.hash_of, _first_places(numbers, len(self.hash_of))
        for size in range(1, to + 1):
            if size > 1:
                # A longer phrase is made of two that overlap in all but the first and the last word.
                alive = np.full(len(self.words) + 1, -1)
                alive[places] = numbers
                following = alive[places + 1] >= 0
                if size == 2:
                    following &= self.joined[places]
                places, numbers = places[following], numbers[following]
                last = self.words[places + size - 1]
                made, first, numbers = np.unique(numbers * len(self.hash_of) + last, return_index=True, return_inverse=True)
                heads, last = np.divmod(made, max(len(self.hash_of), 1))
                hashes = _extended(hashes[heads], self.hash_of[last])
                first = places[first]
            if size <= len(maybe):
                likely = marked(maybe[size - 1], hashes)
                new = np.cumsum(likely) - 1
                kept = likely[numbers]
                places, numbers = places[kept], new[numbers[kept]]
                hashes, first = hashes[likely], first[likely]
            yield numbers, hashes, first


def _extended(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with one more word."""
    return mix(hashes * np.uint64(_NEXT_STEP) + words)


def _first_places(numbers: np.ndarray, n: int) -> np.ndarray:
    first = np.zeros(n, np.int64)
    first[numbers[::-1]] = np.arange(len(numbers))[::-1]
    return first


def _hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string."""
    words = words.cast(pa.large_string())
    at = np.frombuffer(words.buffers()[1], np.int64, len(words) + 1, words.offset * 8) if len(words) else np.zeros(1, np.int64)
    # The dictionary of a run of texts is contiguous.
    raw = np.frombuffer(words.buffers()[2], np.uint8)[at[0] : at[-1]] if len(words) and at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    sums = _spans(raw.astype(np.uint64) + np.uint64(1), at[:-1], at[1:], _BASE)
    return mix(sums + np.diff(at).astype(np.uint64) * np.uint64(_STEP))


def class_of(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def marked(bitmap: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether the bit of each hash's class is set."""
    classes = class_of(hashes, (len(bitmap) * 8).bit_length() - 1)
    return (bitmap[classes >> 3] >> (classes & 7).astype(np.uint8)) & 1 == 1


# --- Counts in hash classes -----------------------------------------------------------------------------------------


def _combined(classes: np.ndarray, counts: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(classes, kind="stable")
    classes, counts = classes[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], classes[1:] != classes[:-1]))) if len(classes) else np.zeros(0, np.int64)
    if not len(first):
        return classes, counts
    return classes[first], np.minimum(np.add.reduceat(counts, first, dtype=np.int64), most).astype(np.uint32)


def _blocks(classes: np.ndarray, counts: np.ndarray, bits: int) -> pa.RecordBatch:
    """Counts of ascending classes, packed into a row for each block of ``2 ** BLOCK_BITS`` classes."""
    width = min(bits, BLOCK_BITS)
    block = classes >> width
    used, first = np.unique(block, return_index=True)
    bounds = np.append(first, len(classes))
    offsets = (classes & ((1 << width) - 1)).astype(np.uint16)
    rows = [(offsets[a:b].tobytes(), counts[a:b].tobytes()) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())],
        ["block", "offsets", "counts"],
    )


def _count_classes(size: int, bits: int, most: int, held):
    """Rows (block, offsets, counts): how often each class has phrases of ``size`` words, up to ``most``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe = held.value
        waiting: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                phrases = Phrases(data, at, batch.column("lang").slice(first, last - first))
                for numbers, hashes, _ in phrases.grown(maybe, size):
                    pass
                found = np.minimum(np.bincount(numbers, minlength=len(hashes)), most).astype(np.uint32)
                waiting.append((class_of(hashes, bits), found))
                if sum(len(c) for c, _ in waiting) > BUFFERED:
                    waiting = [_combined(*map(np.concatenate, zip(*waiting, strict=True)), most)]
                    if len(waiting[0][0]) > BUFFERED // 2:
                        yield _blocks(*waiting.pop(), bits)
        if waiting:
            yield _blocks(*_combined(*map(np.concatenate, zip(*waiting, strict=True)), most), bits)

    return run


def _add_classes(bits: int, most: int):
    width = min(bits, BLOCK_BITS)

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(1 << width, np.uint32)
        for offsets, counts in zip(rows["offsets"], rows["counts"], strict=True):
            at = np.frombuffer(offsets, np.uint16)
            total[at] = np.minimum(total[at] + np.frombuffer(counts, np.uint32), most)
        at = np.flatnonzero(total)
        return pd.DataFrame({"block": [key[0]], "offsets": [at.astype(np.uint16).tobytes()], "counts": [total[at].tobytes()], "part": [key[1]]})

    return add


def likely_classes(texts: DataFrame, size: int, bits: int, least: int, hot: int, maybe: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """A bit for each class of phrases of ``size`` words: whether it has ``least`` occurrences in all texts, or ``hot``.

    The bits of hot ones are for ``2 ** HOT_BITS`` coarser classes at most.
    """
    held = texts.sparkSession.sparkContext.broadcast(maybe)
    most = max(least, hot)
    rows = texts.mapInArrow(_count_classes(size, bits, most, held), "block int, offsets binary, counts binary")
    rows = rows.withColumn("part", F.spark_partition_id())
    add = _add_classes(bits, most)
    # Groups hold blocks of up to 2 ** FAN_BITS tasks; as many levels as lead from 2 ** 24 tasks to one row a block.
    for _ in range(3):
        rows = rows.withColumn("part", F.shiftright("part", FAN_BITS))
        rows = rows.groupBy("block", "part").applyInPandas(add, "block int, offsets binary, counts binary, part int")
    width = min(bits, BLOCK_BITS)
    coarser = 1 << max(0, bits - HOT_BITS)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            likely, often = [], []
            for offsets, counts in zip(batch["offsets"], batch["counts"], strict=True):
                total = np.zeros(1 << width, np.uint32)
                total[np.frombuffer(offsets, np.uint16)] = np.frombuffer(counts, np.uint32)
                likely.append(np.packbits(total >= least, bitorder="little").tobytes())
                often.append(np.packbits((total >= hot).reshape(-1, coarser).any(axis=1), bitorder="little").tobytes())
            yield pd.DataFrame({"block": batch["block"], "likely": likely, "often": often})

    marks = [np.zeros(1 << bits >> 3, np.uint8), np.zeros(1 << bits >> 3 >> max(0, bits - HOT_BITS), np.uint8)]
    # 2 ** bits bits in all, whatever the number of phrases.
    for row in rows.mapInPandas(pack, "block int, likely binary, often binary").collect():
        for mark, raw in zip(marks, (row["likely"], row["often"]), strict=True):
            mark[row["block"] * len(raw) : (row["block"] + 1) * len(raw)] = np.frombuffer(raw, np.uint8)
    held.destroy()
    return marks[0], marks[1]


# --- Stripes --------------------------------------------------------------------------------------------------------

# Continuations, and how often each occurs, in text form with a line for each: no word holds a line's end.
STRIPE = "lang string, prefix string, segment int, part int, total long, words string, counts string"
KEY = ["lang", "prefix", "segment"]
FIELDS = [f.split(" ")[0] for f in STRIPE.split(", ")]


def _lines(offsets: np.ndarray, values: pa.Array) -> pa.Array:
    """Values between offsets as lines of one text; null where there is none."""
    lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values.cast(pa.string()))
    return pa.compute.if_else(pa.array(np.diff(offsets) > 0), pa.compute.binary_join(lists, "\n"), pa.scalar(None, pa.string()))


class Entries:
    """Counted phrases of a task: rows of word numbers, -1 after the last word, and how often each occurred."""

    def __init__(self, longest: int) -> None:
        self.longest = longest
        self.number_of: dict[str, int] = {}
        self.hashes: list[np.ndarray] = []
        self.parts: list[np.ndarray] = []
        self.rows = 0

    def add(self, phrases: Phrases, maybe: list[np.ndarray]) -> None:
        number = np.full(len(phrases.kinds), -1, np.int64)
        for size, (numbers, hashes, first) in enumerate(phrases.grown(maybe, self.longest), 1):
            if size == 1:
                kinds = phrases.words[first]
                langs = phrases.langs.dictionary.cast(pa.large_string()).take(pa.array(phrases.lang_of[kinds]))
                # A word has no space, so the first one in front of it ends it.
                names = pa.compute.binary_join_element_wise(phrases.dictionary.take(pa.array(phrases.word_of[kinds])), langs, pa.scalar(" ", pa.large_string()))
                known = len(self.number_of)
                number[kinds] = [self.number_of.setdefault(name, len(self.number_of)) for name in names.to_pylist()]
                fresh = number[kinds] >= known
                self.hashes.append(phrases.hash_of[kinds][fresh][np.argsort(number[kinds][fresh])])
            row = np.full((len(first), self.longest + 1), -1, np.int32)
            for i in range(size):
                row[:, i] = number[phrases.words[first + i]]
            row[:, -1] = np.bincount(numbers, minlength=len(hashes))
            self.parts.append(row)
            self.rows += len(row)
        if self.rows > BUFFERED_ENTRIES:
            self.combine()

    def combine(self) -> None:
        """Add up equal phrases. Counts stay far below 2 ** 31 between two calls of :meth:`stripes`."""
        rows = np.concatenate(self.parts) if self.parts else np.zeros((0, self.longest + 1), np.int32)
        rows = rows[np.lexsort(rows[:, -2::-1].T)]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(rows)), bool), (rows[1:, :-1] != rows[:-1, :-1]).any(axis=1))))
        if len(first):
            counts = np.add.reduceat(rows[:, -1].astype(np.int64), first)
            rows = rows[first]
            rows[:, -1] = counts
        self.parts, self.rows = [rows], len(rows)

    @property
    def full(self) -> bool:
        return self.rows > BUFFERED_ENTRIES // 2 or len(self.number_of) > BUFFERED_ENTRIES // 2

    def stripes(self, often: np.ndarray, segments: int) -> Iterator[pa.RecordBatch]:
        """What was counted, as stripes; ``often`` marks the classes of hot words."""
        self.combine()
        rows, counts = self.parts[0][:, :-1], self.parts[0][:, -1].astype(np.int64)
        hashes = np.concatenate([np.zeros(0, np.uint64), *self.hashes])
        spelled = [name.split(" ", 1) for name in self.number_of]
        words, langs = pa.array([w for w, _ in spelled], pa.string()), pa.array([lang for _, lang in spelled], pa.string())
        # Rows are in the order of their words; those of a hot word are put in the order of their segments.
        split = marked(often, hashes)[rows[:, 0]] & (rows[:, 1] >= 0)
        segment = np.where(split, hashes[rows[:, 1]] % np.uint64(segments), np.uint64(0)).astype(np.int64)
        order = np.lexsort((segment, rows[:, 0]))
        rows, counts, segment = rows[order], counts[order], segment[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 0] != rows[:-1, 0]) | (segment[1:] != segment[:-1])
        first = np.append(np.flatnonzero(new), len(rows))
        for a in range(0, len(first) - 1, BATCH_ROWS):
            begins = first[a : a + BATCH_ROWS + 1]
            some = slice(begins[0], begins[-1])
            begins = begins[:-1]
            follows = rows[some, 1:]
            longer = follows[:, 0] >= 0
            taken = np.cumsum(np.concatenate(([0], longer)))
            offsets = taken[np.append(begins - some.start, some.stop - some.start)]
            inside = follows[longer]
            bounds = np.concatenate(([0], np.cumsum((inside >= 0).sum(axis=1)))).astype(np.int32)
            paths = pa.compute.binary_join(pa.ListArray.from_arrays(pa.array(bounds), words.take(pa.array(inside[inside >= 0]))), " ")
            totals = np.add.reduceat(np.where(longer, 0, counts[some]), begins - some.start)
            yield _batch(
                langs.take(pa.array(rows[begins, 0])), words.take(pa.array(rows[begins, 0])), segment[begins], totals,
                _lines(offsets, paths), _lines(offsets, pa.array(counts[some][longer])),
            )


def _batch(langs: pa.Array, prefixes: pa.Array, segment: np.ndarray, totals: np.ndarray, words: pa.Array, counts: pa.Array) -> pa.RecordBatch:
    columns = [langs, prefixes, pa.array(segment.astype(np.int32)), pa.array(totals.astype(np.int64)), words, counts]
    return pa.RecordBatch.from_arrays(columns, [f for f in FIELDS if f != "part"])


def _all_words(totals: dict[str, int]) -> pa.RecordBatch:
    """Stripes of the empty prefix: the number of words of each language."""
    n = len(totals)
    none = pa.nulls(n, pa.string())
    return _batch(pa.array(list(totals), pa.string()), pa.array([""] * n, pa.string()), np.zeros(n), np.array(list(totals.values()), np.int64), none, none)


def _make_stripes(longest: int, segments: int, held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, often = held.value
        entries, totals = Entries(longest), Counter()
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                phrases = Phrases(data, at, batch.column("lang").slice(first, last - first))
                found = np.bincount(phrases.lang_of[phrases.words], minlength=len(phrases.langs.dictionary))
                totals.update(dict(zip(phrases.langs.dictionary.to_pylist(), found.tolist(), strict=True)))
                entries.add(phrases, maybe)
                if entries.full:
                    yield from entries.stripes(often, segments)
                    entries = Entries(longest)
        if entries.rows:
            yield from entries.stripes(often, segments)
        yield _all_words(totals)

    return run


def _merge_stripes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add up stripes of one key, which come one after the other. The last key of a batch may go on in the next one."""
    schema, waiting = None, None
    for batch in batches:
        schema = batch.schema
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([waiting, rows]) if waiting is not None else rows
        n = rows.num_rows
        if not n:
            continue
        part = [rows.column(c).combine_chunks() for c in [*KEY, "part"]]
        same = np.ones(n, bool)
        for column in part:
            same &= pa.compute.equal(column, column[n - 1]).to_numpy(zero_copy_only=False)
        cut = n - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield from _merged(rows.slice(0, cut), schema)
        # What belongs to the last key is merged at once, so that what waits is one stripe.
        waiting = pa.Table.from_batches(list(_merged(rows.slice(cut), schema)), schema)
    if waiting is not None:
        yield from waiting.to_batches()


def _merged(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    n = rows.num_rows
    changed = np.zeros(n, bool)
    changed[:1] = True
    for name in [*KEY, "part"]:
        column = rows.column(name).combine_chunks()
        if n > 1:
            changed[1:] |= pa.compute.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(changed)
    lists = {c: pa.compute.split_pattern(rows.column(c).combine_chunks(), "\n") for c in ("words", "counts")}
    lengths = pa.compute.fill_null(pa.compute.list_value_length(lists["words"]), 0).to_numpy(zero_copy_only=False)
    group = np.repeat(np.cumsum(changed) - 1, lengths)
    entries = pa.table({"group": group, "word": lists["words"].flatten(), "n": lists["counts"].flatten().cast(pa.int64())})
    entries = entries.group_by(["group", "word"]).aggregate([("n", "sum")])
    order = np.argsort(entries.column("group").to_numpy(), kind="stable")
    offsets = np.searchsorted(entries.column("group").to_numpy()[order], np.arange(len(first) + 1))
    out = rows.take(pa.array(first))
    columns = {
        "total": pa.array(np.add.reduceat(rows.column("total").to_numpy(), first)),
        "words": _lines(offsets, entries.column("word").combine_chunks().take(pa.array(order))),
        "counts": _lines(offsets, entries.column("n_sum").combine_chunks().take(pa.array(order))),
    }
    arrays = [columns.get(f.name, out.column(f.name)) for f in schema]
    arrays = [(a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a).cast(f.type) for a, f in zip(arrays, schema, strict=True)]
    yield from pa.Table.from_arrays(arrays, schema=schema).to_batches()


def stripes(scratch: Scratch, texts: DataFrame, longest: int, least: int, bits: int, segments: int = SEGMENTS, hot: int = HOT) -> DataFrame:
    """A written table of merged stripes of texts (lang, text): one row for each prefix and segment of following words."""
    maybe: list[np.ndarray] = []
    for size in range(1, longest + 1):
        likely, frequent = likely_classes(texts, size, bits, least, hot, maybe)
        maybe.append(likely)
        often = frequent if size == 1 else often
    held = texts.sparkSession.sparkContext.broadcast((maybe, often))
    rows = texts.mapInArrow(_make_stripes(longest, segments, held), STRIPE.replace("part int, ", ""))
    rows = rows.withColumn("part", F.spark_partition_id()).select(*FIELDS)
    level, most = 0, None
    while most is None or most > 0:
        rows = rows.withColumn("part", F.shiftright("part", FAN_BITS))
        rows = rows.repartition(*KEY, "part").sortWithinPartitions(*KEY, "part").mapInArrow(_merge_stripes, STRIPE)
        rows = scratch.write(rows, f"stripes-{level}")
        scratch.drop(f"stripes-{level - 1}")
        most = rows.agg(F.max("part")).first()[0] or 0
        level += 1
    held.destroy()
    return rows


# --- Scores ---------------------------------------------------------------------------------------------------------


def _whole(column: Column | str) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("decimal(20,0)")


def top_per_group(scratch: Scratch, rows: DataFrame, group: str, order: list[Column], k: int, name: str, group_rows: int = TOP_GROUP) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``; large groups are cut down in rounds of small parts."""
    rows = scratch.write(rows, f"{name}-0")
    step = 0
    while True:
        most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
        if most <= max(group_rows, 2 * k):
            break
        step += 1
        salts = -(-most // max(group_rows, 2 * k))
        salt = F.pmod(F.xxhash64(*rows.columns), F.lit(salts))
        placed = rows.withColumn("__salt", salt).withColumn("__rank", F.row_number().over(Window.partitionBy(group, "__salt").orderBy(*order)))
        rows = scratch.write(placed.where(F.col("__rank") <= k).drop("__salt", "__rank"), f"{name}-{step}")
        scratch.drop(f"{name}-{step - 1}")
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("rank") <= k)


def collocations(
    docs: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    longest: int = LONGEST,
    least: int = LEAST,
    kept: int = KEPT,
    subsumed_percent: int = SUBSUMED_PERCENT,
    class_bits: int | None = None,
    segments: int = SEGMENTS,
    hot: int = HOT,
    group_rows: int = TOP_GROUP,
) -> DataFrame:
    """The ``kept`` best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Letters A-Z count as lower case. Texts are split into pieces at ``. , ; : ! ?`` and the control characters 10 to 13,
    pieces into words at spaces and tabs. ``n`` counts a language's words, f(phrase) the phrase's occurrences within
    pieces, overlapping ones included. Candidates are phrases of 2 to ``longest`` words with a = f(phrase) >= ``least``.
    Cut after its first k words a phrase has l = f(first part), r = f(rest) and the score floor(2000000 * a / (l + r));
    the lowest score counts, ties to the smallest k. A candidate is dropped if its words lie contiguously inside a
    longer candidate, dropped or not, whose count is at least ``subsumed_percent`` hundredths of its own. Best is by
    score, then a, both descending, then phrase by the order of its UTF-8 bytes.

    A null language counts as ``und``; null and empty texts have no words. Repeated rows count as often as they are
    there, whatever their identifiers, which are not read. An empty table gives an empty result. Other columns are not
    read. The result does not depend on ``class_bits``, ``segments``, ``hot`` and ``group_rows``.
    """
    scratch = Scratch(docs.sparkSession, "collocations")
    lang = F.coalesce(F.col(lang_col).cast("string"), F.lit("und"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(lang.alias("lang"), text.alias("text"))
    with shuffles_removed(docs.sparkSession):
        if class_bits is None:
            size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            class_bits = min(MOST_BITS, max(LEAST_BITS, int(size // BYTES_A_CLASS).bit_length()))
        merged = stripes(scratch, texts, longest, least, class_bits, segments, hot)
        return _best(scratch, merged, longest, least, kept, subsumed_percent, group_rows)


def _best(scratch: Scratch, merged: DataFrame, longest: int, least: int, kept: int, subsumed_percent: int, group_rows: int) -> DataFrame:
    empty = F.array().cast("array<bigint>")
    words = merged.where("prefix <> ''").groupBy("lang", "prefix").agg(F.sum("total").alias("f")).where(F.col("f") >= least)
    known = scratch.write(words.select("lang", F.col("prefix").alias("phrase"), "f", empty.alias("lefts"), empty.alias("rights")), "words")
    listed = F.arrays_zip(F.split("words", "\n").alias("path"), F.split("counts", "\n").cast("array<bigint>").alias("f"))
    entries = merged.where("words IS NOT NULL").select("lang", "prefix", F.explode(listed).alias("e")).where(F.col("e.f") >= least)
    entries = entries.select("lang", F.concat_ws(" ", "prefix", "e.path").alias("phrase"), "e.f")
    # Each with its words but the last and but the first; written first, as only a join of two plain tables is split where a key is hot.
    size = F.size(F.split("phrase", " "))
    grams = entries.select(
        "lang", size.alias("size"), "phrase", "f",
        F.expr("substring_index(phrase, ' ', size(split(phrase, ' ')) - 1)").alias("prefix"),
        F.expr("substring(phrase, instr(phrase, ' ') + 1)").alias("tail"),
    )
    grams = scratch.write(grams, "grams")
    # What can subsume a phrase is one that goes on with one more word, or begins with one more.
    ends = [grams.where("size > 2").select("lang", F.col(c).alias("phrase"), "f") for c in ("prefix", "tail")]
    longer = scratch.write(ends[0].unionAll(ends[1]).groupBy("lang", "phrase").agg(F.max("f").alias("longer")), "longer")

    candidates = None
    for size in range(2, longest + 1):
        head = known.select("lang", F.col("phrase").alias("prefix"), F.concat("lefts", F.array("f")).alias("lefts"))
        tail = known.select("lang", F.col("phrase").alias("tail"), F.concat(F.array("f"), "rights").alias("rights"))
        known = grams.where(F.col("size") == size).join(head, ["lang", "prefix"]).join(tail, ["lang", "tail"])
        known = scratch.write(known.select("lang", "phrase", "f", "lefts", "rights"), f"known-{size}")
        candidates = known if candidates is None else candidates.unionAll(known)

    scored = F.expr(
        f"""array_min(transform(arrays_zip(lefts, rights), (cut, k) -> struct(
            (CAST(f AS DECIMAL(20, 0)) * {FACTOR}BD) div (CAST(cut.lefts AS DECIMAL(20, 0)) + CAST(cut.rights AS DECIMAL(20, 0))) AS score,
            k, cut.lefts AS l, cut.rights AS r)))"""
    )
    found = candidates.join(longer, ["lang", "phrase"], "left")
    alone = F.col("longer").isNull() | (_whole("longer") * 100 < _whole("f") * subsumed_percent)
    found = found.where(alone).select("lang", "phrase", F.col("f").alias("a"), scored.alias("best"))
    found = found.select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    top = top_per_group(scratch, found, "lang", order, kept, "candidates", group_rows)
    n = merged.where("prefix = ''").groupBy("lang").agg(F.sum("total").alias("n"))
    return top.join(n, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
