"""Near duplicates by HyperMinHash sketches, banded, and verified on the whole texts.

A document is the set of its distinct shingles. Its sketch has ``BUCKETS`` registers. A shingle's hash names a bucket and
a number, a bucket holds the smallest number that it was given, and its register keeps of that minimum only the count of
leading zeros and the ``MANTISSA`` bits that follow the first one: two bytes instead of eight. A bucket without a shingle
borrows from another one, which a series of hashes of its own place names, the same for all documents; so the chance that
two documents agree in a register is their similarity, also for short documents. What is borrowed is mixed with the place.

Registers are banded: documents that agree in all ``rows`` registers of a band are a candidate pair. There are as many
bands as registers allow, and ``rows`` is the largest number for which a pair at the limit agrees in no band with a chance
of ``MISSED`` at most. From the last bit of each register the similarity of a pair is estimated where it is found: two
different minima agree in a bit by chance in one case of two, so of ``m`` agreeing bits of ``k`` the similarity is
``(m - k / 2) / (k / 2)``. A pair is dropped there only if its estimate is ``DEVIATIONS`` standard deviations below the
limit. A family of copies may lie just below the limit, where an estimate cannot tell: every shingle also flips one of
``PARITY`` bits, so the bits in which two documents differ are no more than the shingles that only one of them has, and a
pair with more of them than a link allows is dropped too, for certain. What is left is verified on the sets of the whole
texts.

Pairs within a group of copies are not all looked at: documents of equal words are one node, nodes become *centres* in
rounds, ``GROWTH`` times as many in each as before, and in each round only pairs of a centre and a node that no earlier
link connects are verified. A family of n copies is connected after about n comparisons; in the last round every node is
a centre, so no two nodes that agree in a band stay uncompared and unconnected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hint, mix, row_key, shuffles_removed, signed, slices
from .components import components
from .jaccard import Shingles, _verified

WIDTH = 5
PERCENT = 85
BUCKETS = 512
MANTISSA = 10
MISSED = 1e-8
DEVIATIONS = 7
GROWTH = 16
BORROWINGS = 256
TEXTS_AT_ONCE = 2048
PARITY = 1024
WORDS_OF_BITS = BUCKETS // 64
BITS = [f"b{i}" for i in range(WORDS_OF_BITS)]
PARITIES = [f"p{i}" for i in range(PARITY // 64)]
SKETCH = [*BITS, *PARITIES]
_BUCKET_BITS = BUCKETS.bit_length() - 1
_SEED = 0x589965CC75374CC3


def rows_of_band(percent: int) -> int:
    """The most registers a band can have so that pairs at the limit agree in one of the bands."""
    similarity = percent / 100
    fitting = [r for r in range(1, 33) if (1 - similarity**r) ** (BUCKETS // r) <= MISSED]
    return max(fitting, default=1)


def least_agreeing(percent: int) -> int:
    """The fewest equal bits of ``BUCKETS`` that a pair at the limit may have."""
    similarity = percent / 100
    least = similarity - DEVIATIONS * math.sqrt((1 - similarity**2) / BUCKETS)
    return max(0, math.floor(BUCKETS * (1 + least) / 2))


def _lenders() -> np.ndarray:
    """For each attempt and bucket the bucket that is asked, the same for all documents."""
    place = np.arange(BORROWINGS * BUCKETS, dtype=np.uint64) * np.uint64(_SEED)
    return (mix(place + np.uint64(_SEED)) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64).reshape(BORROWINGS, BUCKETS)


def minima(values: np.ndarray, owner: np.ndarray, texts: int) -> np.ndarray:
    """For each text and bucket the smallest number; each text without an empty bucket, unless it has no shingle at all."""
    hashes = mix(values ^ np.uint64(_SEED))
    bucket = (hashes >> np.uint64(64 - _BUCKET_BITS)).astype(np.int64)
    number = hashes & np.uint64((1 << (64 - _BUCKET_BITS)) - 1)
    out = np.full(texts * BUCKETS, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, owner * BUCKETS + bucket, number)
    out = out.reshape(texts, BUCKETS)
    empty = out == np.iinfo(np.uint64).max
    row, place = np.nonzero(empty & ~empty.all(axis=1, keepdims=True))
    lenders = _lenders()
    for attempt in range(BORROWINGS + BUCKETS):
        if not len(row):
            break
        # Past the hashed attempts the next buckets are asked in turn.
        asked = lenders[attempt, place] if attempt < BORROWINGS else (place + attempt - BORROWINGS + 1) % BUCKETS
        lends = ~empty[row, asked]
        to_row, to_place = row[lends], place[lends]
        lent = mix(out[to_row, asked[lends]] + (to_place.astype(np.uint64) + np.uint64(1)) * np.uint64(_SEED))
        out[to_row, to_place] = lent & np.uint64((1 << (64 - _BUCKET_BITS)) - 1)
        row, place = row[~lends], place[~lends]
    return out


def registers(numbers: np.ndarray) -> np.ndarray:
    """Leading zeros and the ``MANTISSA`` bits after the first one of numbers of ``64 - log2(BUCKETS)`` bits, in 16 bits."""
    width = 64 - _BUCKET_BITS
    # The exponent of a double is the place of its first bit; numbers are cut to what a double holds exactly.
    kept = (numbers >> np.uint64(max(0, width - 52))).astype(np.float64)
    bits = kept.view(np.uint64)
    exponent = (bits >> np.uint64(52)).astype(np.int64) - 1023
    zeros = np.where(numbers > 0, min(width, 52) - 1 - exponent, min(width, 52)).clip(0, 63)
    mantissa = (bits >> np.uint64(52 - MANTISSA)) & np.uint64((1 << MANTISSA) - 1)
    return (zeros.astype(np.uint16) << MANTISSA) | mantissa.astype(np.uint16)


def _sketches(width: int, rows: int):
    """Rows (row, id, one, two, n, b0.., p0.., bands): digests of the words, size of the set, last bits, parities, hash of each band."""
    bands = BUCKETS // rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                found = Shingles(data, at, width)
                one, two = found.digests()
                order = np.lexsort((found.values, found.owner))
                values, owner = found.values[order], found.owner[order]
                fresh = np.ones(len(values), bool)
                fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                values, owner = values[fresh], owner[fresh]
                n = np.bincount(owner, minlength=found.texts)
                parts = [np.zeros((0, BUCKETS), np.uint16)]
                for some in range(0, found.texts, TEXTS_AT_ONCE):
                    several = min(TEXTS_AT_ONCE, found.texts - some)
                    a, b = np.searchsorted(owner, (some, some + several))
                    parts.append(registers(minima(values[a:b], owner[a:b] - some, several)))
                kept = np.concatenate(parts)
                last_bits = np.packbits((kept & 1).astype(np.uint8), axis=1).view(np.int64)
                flipped = np.bincount(owner * PARITY + (values & np.uint64(PARITY - 1)).astype(np.int64), minlength=found.texts * PARITY) & 1
                parity = np.packbits(flipped.astype(np.uint8).reshape(-1, PARITY), axis=1).view(np.int64)
                banded = kept[:, : bands * rows].reshape(found.texts, bands, rows).astype(np.uint64)
                hashed = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(_SEED), (found.texts, bands)).copy()
                for i in range(rows):
                    hashed = mix((hashed ^ banded[:, :, i]) * np.uint64(_SEED))
                filled = np.where(n > 0, bands, 0)
                offsets = np.concatenate(([0], np.cumsum(filled))).astype(np.int32)
                flat = np.ascontiguousarray(hashed[n > 0]).ravel()
                row = slice(first, last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[row], batch.column("id")[row], pa.array(signed(one)), pa.array(signed(two)), pa.array(n.astype(np.int64)),
                        *[pa.array(np.ascontiguousarray(last_bits[:, i])) for i in range(len(BITS))],
                        *[pa.array(np.ascontiguousarray(parity[:, i])) for i in range(len(PARITIES))],
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(flat))),
                    ],
                    ["row", "id", "one", "two", "n", *SKETCH, "bands"],
                )

    return run


def _row_digest(id_col: str, text_col: str) -> Column:
    """What tells rows apart: the identifier and 128 bits of the text's SHA-256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(id_col).isNull().cast("string"), F.substring(F.sha2(text, 256), 1, 32))


def _candidates(tokens: DataFrame, draw: Column, low: float, high: float, percent: int) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) of a centre of this round and a later node that agree in a band, may link, and are not connected."""
    centres = tokens.where((draw >= low) & (draw < high)).select(
        "token", F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("comp").alias("comp_a"), draw.alias("draw_a"),
        *[F.col(c).alias(f"{c}_a") for c in SKETCH],
    )
    later = (draw > F.col("draw_a")) | ((draw == F.col("draw_a")) & (F.col("node") > F.col("a")))
    sizes = 100 * F.least("n", "n_a") >= percent * F.greatest("n", "n_a")
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in BITS)
    near = differ <= BUCKETS - least_agreeing(percent)
    # With I shared of n and m shingles, 100 I >= percent (n + m - I); n + m - 2 I are in one set only.
    apart = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"{c}_a"))) for c in PARITIES)
    near &= (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("n_a"))
    found = tokens.where(draw >= low).join(centres, "token").where(later & sizes & (F.col("comp") != F.col("comp_a")) & near)
    return found.select("a", F.col("node").alias("b"), "comp_a", F.col("comp").alias("comp_b")).distinct()


def _links(scratch: Scratch, texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that link, by the whole texts of both."""
    wanted = scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(nodes.select("node", "row"), "node"), f"wanted-{name}")
    held = texts.select("row", "text").join(join_hint(wanted), "row").dropDuplicates(["node"]).select("node", "text")
    # Written first: only a join of two plain tables is split where a centre is hot.
    held = scratch.write(held, f"texts-{name}")
    first = scratch.write(pairs.select("a", "b").join(held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b"), f"second-{name}")
    both = first.join(held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return both.mapInArrow(_verified(width, percent), "a long, b long")


def _groups(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, growth: int) -> DataFrame:
    """Rows (row, id, n, first): ``first`` is the smallest (none, id, row) of the document's group."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be between 1 and 100")
    scratch = Scratch(docs.sparkSession, "hyperminhash")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(_row_digest(id_col, text_col).alias("row"), F.col(id_col).alias("id"), text.alias("text"))
    id_type = docs.schema[id_col].dataType.simpleString()
    kinds = ", ".join(f"{c} long" for c in SKETCH)
    found = texts.mapInArrow(_sketches(width, rows_of_band(percent)), f"row string, id {id_type}, one long, two long, n long, {kinds}, bands array<long>")
    found = scratch.write(found, "sketches")

    # Documents with equal words are one node, known by its row number in a written table.
    least = row_key(F.col("id").isNull().alias("none"), "id", "row")
    same = [*SKETCH, "bands"]
    nodes = found.where("n > 0").groupBy("one", "two", "n").agg(F.min(least).alias("least"), *[F.min(c).alias(c) for c in same])
    nodes = nodes.select(F.monotonically_increasing_id().alias("node"), "one", "two", "n", "least", F.col("least.row").alias("row"), *same)
    nodes = scratch.write(nodes, "nodes")
    found = scratch.write(found.select("row", "id", "one", "two", "n"), "listed")
    scratch.drop("sketches")

    tokens = nodes.select("node", F.explode("bands").alias("token"))
    repeated = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    # Written first, as above.
    repeated = scratch.write(repeated, "repeated")
    most = repeated.agg(F.max("nodes")).first()[0] or 0
    tokens = scratch.write(tokens.join(repeated.select("token"), "token"), "shared")
    tokens = tokens.join(nodes.select("node", "n", *SKETCH), "node").withColumn("comp", F.col("node"))
    tokens = scratch.write(tokens, "tokens-0")
    scratch.drop("shared", "repeated")

    draw = F.shiftrightunsigned(F.xxhash64("node", F.lit(_SEED)), 11) / float(1 << 53)
    labels, low, step = None, 0.0, 0
    while most > 1 and low < 1.0:
        high = 2.0 * growth**step / most
        high = high if high < 0.5 else 1.1
        pairs = scratch.write(_candidates(tokens, draw, low, high, percent), f"pairs-{step}")
        links = _links(scratch, texts, nodes, pairs, width, percent, str(step))
        links = scratch.write(links.join(pairs, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), f"links-{step}")
        scratch.drop(f"pairs-{step}", f"wanted-{step}", f"texts-{step}", f"second-{step}")
        low, step = high, step + 1
        if links.isEmpty():
            continue
        merged = scratch.write(components(scratch, links, f"round-{step}"), f"merged-{step}")
        to = merged.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
        if labels is None:
            following = to.select(F.col("comp").alias("node"), F.col("new").alias("comp"))
        else:
            moved = labels.join(to, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
            fresh = to.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti")
            following = moved.unionAll(fresh.select(F.col("comp").alias("node"), F.col("new").alias("comp")))
        labels = scratch.write(following, f"labels-{step}")
        if low >= 1.0:
            break
        # A band's nodes that are all connected have nothing more to tell.
        tokens = tokens.where(draw >= low).join(to, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
        tokens = scratch.write(tokens, f"moved-{step}")
        open_tokens = tokens.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        tokens = scratch.write(tokens.join(scratch.write(open_tokens, f"open-{step}"), "token"), f"tokens-{step}")

    if labels is None:
        known = nodes.withColumn("comp", F.col("node"))
    else:
        known = nodes.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    known = scratch.write(known.select("one", "two", "n", "comp", "least"), "known")
    smallest = known.groupBy("comp").agg(F.min("least").alias("first"))
    named = known.join(smallest, "comp").select("one", "two", "n", "first")
    return found.join(named, ["one", "two", "n"], "left").select(
        "row", "id", "n", F.coalesce("first", row_key(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    )


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, growth: int = GROWTH
) -> DataFrame:
    """Groups of near duplicates. One row per input row: identifier, ``n_shingles``, ``component_id``, ``kept``.

    Letters A-Z count as lower case. Two documents link if the shingles they share are at least ``percent`` hundredths
    of those that either has; a link is confirmed on the sets of the whole texts. ``component_id`` is the smallest
    identifier that links lead to, the own one included, and ``kept`` whether it is the own one; a null identifier
    counts only where a group has no other, and is kept there. A text with fewer words than a shingle is one shingle;
    null texts and texts without words have none and link with nothing, not even each other, and stay. Rows repeated
    with one identifier and text are one document, each with the same result. An empty table gives an empty result.
    Other columns are not read. A pair at the limit escapes the bands with a chance of ``MISSED`` at most.
    """
    with shuffles_removed(docs.sparkSession):
        found = _groups(docs, id_col, text_col, width, percent, growth)
    return found.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_shingles"),
        F.col("first.id").alias("component_id"),
        F.col("id").eqNullSafe(F.col("first.id")).alias("kept"),
    )
