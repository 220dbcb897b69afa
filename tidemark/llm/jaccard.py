"""N-gram Jaccard join with adaptive multi-match prefixes, and the groups that its links form.

A document is the set of its distinct shingles. Shingles have one global order, rare before frequent. If two sets are
similar enough, then for any m their prefixes for m share at least m shingles; a prefix for m is m - 1 longer than the
shortest that must share one. Frequencies are those of hash classes, counted over all documents into a table of fixed
size. Each document estimates from them what looking up and verifying candidates would cost for each m, and chooses: one
whose rare shingles are rare takes a short prefix and one match, one made of frequent passages a longer prefix and
correspondingly more matches before a pair is verified.

For groups not all pairs are wanted, so pairs already known to be connected are never looked at; ``near_links`` and
``link_counts`` look at all pairs. Documents with equal word sequences are one node. Nodes become *hubs* in rounds, in
the order of a random number, few in the first round and ``GROWTH`` times as many in each next one. In a round all nodes
are compared with the round's hubs, where they share enough of the hub's prefix and are not connected to it yet. A
family of n near copies meets a first hub when it expects a few of them; that links most of it, after about n
comparisons instead of n * n. Each pair that shares enough is compared when the first of the two becomes a hub unless it
is connected by then, so no link between groups is lost.

Before a pair leaves the join its *parity sketches* are compared: every shingle flips one of ``SKETCH`` bits, so the bits
in which two sketches differ are no more than the shingles that only one of the sets has. A pair with more such bits than
a link allows is no link. Every pair that is left is verified on the whole texts. Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, Words, _spans, join_hint, mix, row_key, shuffles_removed, signed, slices, window_hashes
from .components import components

WORDS = 3
PERCENT = 90
MOST_MATCHES = 4
VERIFY_COST = 20
CLASS_BITS = 20
BLOCK_BITS = 14
FAN_BITS = 8
ADDED_TIMES = 3  # levels of sums, for up to 2 ** 24 tasks
GROWTH = 16
SKETCH = 256
LANES = SKETCH // 64
SKETCHES = [f"s{i}" for i in range(LANES)]
_OTHER_BASE = 0xA0761D6478BD642F | 1


class Shingles:
    """The shingles of a run of texts, in order of texts and places, not yet distinct."""

    def __init__(self, data: np.ndarray, at: np.ndarray, width: int) -> None:
        words = Words(data, at, lower=True)
        self.words, self.texts = words, len(at) - 1
        self.hashes = hashes = words.hashes()
        counts = words.counts
        numbers = np.arange(len(hashes))
        text_of = np.repeat(np.arange(self.texts), counts)
        full = numbers[numbers + width <= words.first[text_of + 1]] if len(numbers) else numbers
        parts, owners = [window_hashes(hashes, width)[full]], [text_of[full]]
        # Texts shorter than a shingle are one, as a whole.
        for n in range(1, width):
            short = np.flatnonzero(counts == n)
            parts.append(window_hashes(hashes, n)[words.first[short]] if len(short) else np.zeros(0, np.uint64))
            owners.append(short)
        self.values, self.owner = np.concatenate(parts), np.concatenate(owners)

    def digests(self) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of each text's sequence of words."""
        first, n = self.words.first, self.words.counts.astype(np.uint64)
        one = mix(_spans(self.hashes, first[:-1], first[1:], 0xD6E8FEB86659FD93 | 1) + n)
        return one, mix(_spans(self.hashes, first[:-1], first[1:], _OTHER_BASE) + n)


def _added(rows: DataFrame, fan_bits: int = FAN_BITS) -> DataFrame:
    """Rows (block, bytes, counts, part), each block once in a part, added up over ``2 ** fan_bits`` parts that follow."""

    def add(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        total = sum(
            np.frombuffer(raw, np.uint32 if size == 4 else np.uint64).astype(np.int64)
            for size, raw in zip(group["bytes"], group["counts"], strict=True)
        )
        return pd.DataFrame({"block": [key[0]], "bytes": [8], "counts": [total.tobytes()], "part": [key[1]]})

    parts = rows.withColumn("part", F.shiftright("part", fan_bits))
    return parts.groupBy("block", "part").applyInPandas(add, "block int, bytes int, counts binary, part int")


def frequencies(texts: DataFrame, width: int, class_bits: int) -> np.ndarray:
    """Number of shingles in each of ``2 ** class_bits`` hash classes, over all texts.

    A task sends the counts of its classes in blocks; blocks are added up in Spark, those of up to ``2 ** FAN_BITS`` tasks
    at a time, so that no group grows with the number of tasks. The result's size is fixed.
    """
    block_bits = min(BLOCK_BITS, class_bits)
    blocks = 1 << (class_bits - block_bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << class_bits, np.int64)
        for batch in batches:
            for _, _, data, at in slices(batch.column("text")):
                classes = Shingles(data, at, width).values >> np.uint64(64 - class_bits)
                total += np.bincount(classes.astype(np.int64), minlength=len(total))
        used = [i for i, block in enumerate(total.reshape(blocks, -1)) if block.any()]
        rows = [total.reshape(blocks, -1)[i].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.uint64) for i in used]
        yield pa.RecordBatch.from_arrays(
            [pa.array(used, pa.int32()), pa.array([x.dtype.itemsize for x in rows], pa.int32()), pa.array([x.tobytes() for x in rows], pa.binary())],
            ["block", "bytes", "counts"],
        )

    counted = texts.select("text").mapInArrow(count, "block int, bytes int, counts binary")
    out = np.zeros((blocks, 1 << block_bits), np.int64)
    added = counted.withColumn("part", F.spark_partition_id())
    for _ in range(ADDED_TIMES):
        added = _added(added)
    # One row per block, as there are fewer tasks than the levels hold.
    for row in added.collect():
        out[row["block"]] += np.frombuffer(row["counts"], np.int64)
    return out.ravel()


def least_overlap(n: np.ndarray, percent: int) -> np.ndarray:
    """The fewest shingles that a set of ``n`` shares with any set it links with."""
    return -(-n * percent // 100)


def _prefix_rows(width: int, percent: int, most: int, held):
    """Rows (row, id, one, two, n, matches, base, s0.., prefix): prefixes for ``most`` matches, rare shingles first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = held.value
        bits = np.uint64(64 - int(len(weights)).bit_length() + 1)
        noise = int(np.median(weights))
        for batch in batches:
            for first, last, data, at in slices(batch.column("text")):
                found = Shingles(data, at, width)
                one, two = found.digests()
                weight = weights[(found.values >> bits).astype(np.int64)]
                order = np.lexsort((found.values, weight, found.owner))
                values, owner, weight = found.values[order], found.owner[order], weight[order]
                fresh = np.ones(len(values), bool)
                fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                values, owner, weight = values[fresh], owner[fresh], weight[fresh]
                begins = np.searchsorted(owner, np.arange(found.texts + 1))
                n = np.diff(begins)
                least = least_overlap(n, percent)
                base = np.where(n > 0, n - least + 1, 0)
                # Estimated cost for each number of matches: reading the lists, and verifying what is in several.
                lists = np.concatenate(([0], np.cumsum(np.maximum(weight - noise, 0) + 1)))
                costs = np.full((most, found.texts), np.inf)
                for m in range(1, most + 1):
                    possible = least >= m
                    listed = lists[np.minimum(begins[:-1] + base + m - 1, begins[1:])] - lists[begins[:-1]]
                    costs[m - 1, possible] = (listed + VERIFY_COST * listed / m)[possible]
                matches = costs.argmin(axis=0) + 1
                kept = np.minimum(np.where(n > 0, base + most - 1, 0), n)
                inside = np.arange(len(values)) - begins[owner] < kept[owner]
                offsets = np.concatenate(([0], np.cumsum(kept))).astype(np.int32)
                prefix = pa.ListArray.from_arrays(pa.array(offsets), pa.array(signed(values[inside])))
                bits_of = owner * SKETCH + (values & np.uint64(SKETCH - 1)).astype(np.int64)
                odd = (np.bincount(bits_of, minlength=found.texts * SKETCH) & 1).astype(np.uint8).reshape(-1, SKETCH)
                sketch = np.packbits(odd, axis=1).view(np.int64)
                rows = slice(first, last)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row")[rows], batch.column("id")[rows],
                        pa.array(signed(one)), pa.array(signed(two)), pa.array(n.astype(np.int64)),
                        pa.array(matches.astype(np.int32)), pa.array(base.astype(np.int64)),
                        *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(LANES)], prefix,
                    ],
                    ["row", "id", "one", "two", "n", "matches", "base", *SKETCHES, "prefix"],
                )

    return run


def _verified(width: int, percent: int):
    """Of rows (a, b, text_a, text_b) the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Slices are cut by the first texts; linked texts differ little in length.
            for first, last, data, at in slices(batch.column("text_a"), 1 << 19):
                sides = []
                for _, _, data_b, at_b in slices(batch.column("text_b").slice(first, last - first), 1 << 62):
                    for d, t in ((data, at), (data_b, at_b)):
                        found = Shingles(d, t, width)
                        order = np.lexsort((found.values, found.owner))
                        values, owner = found.values[order], found.owner[order]
                        fresh = np.ones(len(values), bool)
                        fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
                        sides.append((values[fresh], owner[fresh]))
                values = np.concatenate([x[0] for x in sides])
                owner = np.concatenate([x[1] for x in sides])
                order = np.lexsort((values, owner))
                values, owner = values[order], owner[order]
                twice = owner[1:][(values[1:] == values[:-1]) & (owner[1:] == owner[:-1])]
                size = last - first
                both = np.bincount(twice, minlength=size)
                union = np.bincount(owner, minlength=size) - both
                linked = np.flatnonzero((100 * both >= percent * union) & (union > 0)) + first
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(linked)), batch.column("b").take(pa.array(linked))], ["a", "b"])

    return run


def _draw():
    return F.shiftrightunsigned(F.xxhash64("node"), 11) / float(1 << 53)


def _candidates(tokens: DataFrame, draw, low: float, high: float, percent: int) -> DataFrame:
    """Pairs (a, b, comp_a, comp_b) of a hub of this round and a later node that may link and are not connected."""
    hubs = tokens.where((draw >= low) & (draw < high) & (F.col("level") <= F.col("matches"))).select(
        "token", F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("matches").alias("least"), F.col("comp").alias("hub_comp"),
        draw.alias("hub_draw"), *[F.col(c).alias(f"hub_{c}") for c in SKETCHES],
    )
    later = (draw > F.col("hub_draw")) | ((draw == F.col("hub_draw")) & (F.col("node") > F.col("hub")))
    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    differ = sum(F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub_{c}"))) for c in SKETCHES)
    # With I shared of n and m shingles, 100 I >= percent (n + m - I); n + m - 2 I are in one set only.
    may_link = (100 + percent) * differ <= (100 - percent) * (F.col("n") + F.col("hub_n"))
    return (
        tokens.where(draw >= low)
        .join(hubs, "token")
        .where(later & alike & may_link & (F.col("level") <= F.col("least")) & (F.col("comp") != F.col("hub_comp")))
        .groupBy("hub", "node", "least", "hub_comp", "comp")
        .agg(F.count(F.lit(1)).alias("shared"))
        .where("shared >= least")
        .select(F.col("hub").alias("a"), F.col("node").alias("b"), F.col("hub_comp").alias("comp_a"), F.col("comp").alias("comp_b"))
    )


def _links(scratch: Scratch, texts: DataFrame, nodes: DataFrame, pairs: DataFrame, width: int, percent: int, name: str) -> DataFrame:
    """The pairs (a, b) that link, by the whole texts of both."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = scratch.write(wanted.join(nodes.select("node", "row"), "node").select("node", "row"), f"wanted-{name}")
    held = texts.select("row", "text").join(join_hint(rows), "row").dropDuplicates(["node"]).select("node", "text")
    # Texts and pairs are written first: only a join of two plain tables is split where a hub is hot.
    held = scratch.write(held, f"texts-{name}")
    a = held.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = held.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    half = scratch.write(pairs.select("a", "b").join(b, "b"), f"half-{name}")
    return half.join(a, "a").mapInArrow(_verified(width, percent), "a long, b long")


def _row_digest(id_col: str, text_col: str):
    """What tells rows apart: the identifier and 128 bits of the text's SHA-256."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return F.concat_ws(":", F.col(id_col).isNull().cast("string"), F.col(id_col).cast("string"), F.substring(F.sha2(text, 256), 1, 32))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(_row_digest(id_col, text_col).alias("row"), F.col(id_col).alias("id"), text.alias("text"))


def _shared(
    scratch: Scratch, texts: DataFrame, width: int, percent: int, most_matches: int, class_bits: int
) -> tuple[DataFrame, DataFrame, DataFrame, int]:
    """Written tables of the rows, of the nodes, of the tokens that nodes share, and the nodes of the most frequent one."""
    spark = texts.sparkSession
    id_type = texts.schema["id"].dataType.simpleString()

    held = spark.sparkContext.broadcast(frequencies(texts, width, class_bits))  # 8 * 2 ** class_bits bytes
    found = texts.mapInArrow(
        _prefix_rows(width, percent, most_matches, held),
        f"row string, id {id_type}, one long, two long, n long, matches int, base long, {', '.join(f'{c} long' for c in SKETCHES)}, prefix array<long>",
    )
    found = scratch.write(found, "documents")

    # Documents with equal words are one node, known by its row number in a written table.
    least = row_key(F.col("id").isNull().alias("none"), "id", "row")
    same = ["matches", "base", *SKETCHES, "prefix"]
    nodes = (
        found.where("n > 0")
        .groupBy("one", "two", "n")
        .agg(F.min(least).alias("least"), *[F.min(c).alias(c) for c in same])
        .select(F.monotonically_increasing_id().alias("node"), "one", "two", "n", "least", F.col("least.row").alias("row"), *same)
    )
    nodes = scratch.write(nodes, "nodes")
    found = scratch.write(found.select("row", "id", "one", "two", "n"), "listed")
    scratch.drop("documents")

    level = F.greatest(F.lit(1), F.col("pos") - F.col("base") + 2).cast("int")
    tokens = nodes.select("node", "base", F.posexplode("prefix").alias("pos", "token")).select("token", "node", level.alias("level"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("nodes")).where("nodes > 1")
    # Written first: only a join of two plain tables is split where a token is hot.
    shared = scratch.write(shared.select("token"), "repeated")
    tokens = scratch.write(tokens.join(shared, "token"), "shared")
    longest = tokens.groupBy("token").count().agg(F.max("count").alias("n")).first()["n"] or 0
    tokens = tokens.join(nodes.select("node", "n", "matches", *SKETCHES), "node").withColumn("comp", F.col("node"))
    tokens = scratch.write(tokens, "tokens-0")
    scratch.drop("shared")
    return found, nodes, tokens, longest


def _groups(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    width: int,
    percent: int,
    most_matches: int = MOST_MATCHES,
    growth: int = GROWTH,
    class_bits: int = CLASS_BITS,
) -> DataFrame:
    """Rows (row, id, n, first): ``first`` is the smallest (none, id, row) of the document's group."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    texts = _texts(docs, id_col, text_col)
    found, nodes, tokens, longest = _shared(scratch, texts, width, percent, most_matches, class_bits)

    draw = _draw()
    labels, low, step = None, 0.0, 0
    while longest > 1 and low < 1.0:
        high = 2.0 * growth**step / longest
        high = high if high < 0.5 else 1.1
        pairs = scratch.write(_candidates(tokens, draw, low, high, percent), f"pairs-{step}")
        links = _links(scratch, texts, nodes, pairs, width, percent, str(step))
        links = scratch.write(links.join(pairs, ["a", "b"]).select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")), f"links-{step}")
        scratch.drop(f"pairs-{step}", f"wanted-{step}", f"texts-{step}", f"half-{step}")
        low, step = high, step + 1
        if links.isEmpty():
            continue
        merged = scratch.write(components(scratch, links, f"round-{step}"), f"merged-{step}")
        to = merged.select(F.col("node").alias("comp"), F.col("comp").alias("new"))
        if labels is None:
            following = to.select(F.col("comp").alias("node"), F.col("new").alias("comp"))
        else:
            old = labels.join(to, "comp", "left").select("node", F.coalesce("new", "comp").alias("comp"))
            fresh = to.join(labels.select(F.col("node").alias("comp")), "comp", "left_anti")
            following = old.unionAll(fresh.select(F.col("comp").alias("node"), F.col("new").alias("comp")))
        labels = scratch.write(following, f"labels-{step}")
        if low >= 1.0:
            break
        moved = tokens.join(to, "comp", "left").withColumn("comp", F.coalesce("new", "comp")).drop("new")
        # Tokens whose nodes are all connected have nothing more to tell, nor have nodes that all later hubs come before.
        open_tokens = moved.groupBy("token").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("token")
        open_tokens = scratch.write(open_tokens, f"open-{step}")
        tokens = scratch.write(moved.where(draw >= low).join(open_tokens, "token"), f"tokens-{step}")

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


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """Groups of documents connected by links. One row per input row: identifier, ``n_shingles``, ``component_id``.

    Letters A-Z count as lower case. Two documents link if the shingles they share are at least ``percent`` hundredths
    of those that either has. ``component_id`` is the smallest identifier that links lead to, the own one included;
    nulls count only where a group has no other. A text with fewer words than a shingle is one shingle; null texts and
    texts without words have none and link with nothing, not even each other. Repeated rows are one document with one
    result each. An empty table gives an empty result. Other columns are not read.
    """
    with shuffles_removed(docs.sparkSession):
        found = _groups(docs, id_col, text_col, width, percent, **how)
    return found.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.col("first.id").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """One document of each group of ``near_groups``, that with the smallest identifier, with all its columns.

    Documents without words stay. Of repeated rows one stays.
    """
    with shuffles_removed(docs.sparkSession):
        found = _groups(docs, id_col, text_col, width, percent, **how)
    kept = found.where(F.col("row") == F.col("first.row")).select(F.col("row").alias("__row_key"))
    marked = docs.withColumn("__row_key", _row_digest(id_col, text_col))
    marked = marked.join(kept, "__row_key", "left_semi").dropDuplicates(["__row_key"])
    return marked.select(*[F.col(f"`{c}`") for c in docs.columns])


def _all_links(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    width: int,
    percent: int,
    most_matches: int = MOST_MATCHES,
    class_bits: int = CLASS_BITS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Written tables of the rows, of the nodes with their number of ``copies``, and of all linked pairs (a, b) of nodes."""
    scratch = Scratch(docs.sparkSession, "links")
    texts = _texts(docs, id_col, text_col)
    found, nodes, tokens, _ = _shared(scratch, texts, width, percent, most_matches, class_bits)
    # All nodes are hubs of one round, and none is connected yet, so no pair is left out.
    pairs = scratch.write(_candidates(tokens, _draw(), 0.0, 1.1, percent), "pairs")
    links = scratch.write(_links(scratch, texts, nodes, pairs, width, percent, "all"), "links")
    scratch.drop("pairs", "tokens-0", "wanted-all", "texts-all", "half-all")
    sizes = found.where("n > 0").select("one", "two", "n", "row").distinct().groupBy("one", "two", "n").agg(F.count(F.lit(1)).alias("copies"))
    nodes = scratch.write(nodes.select("node", "one", "two", "n", F.col("least.id").alias("id")).join(sizes, ["one", "two", "n"]), "sized")
    return found, nodes, links


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """All links between documents of different words, also within a group. One row per pair of word sequences that link.

    Links, words and shingles are those of ``near_groups``. Columns: ``a`` and ``b``, the smallest identifiers of the
    documents with the one and the other sequence (null where all are), and ``copies_a`` and ``copies_b``, their numbers
    of documents: a row stands for ``copies_a * copies_b`` links. ``a`` is not greater than ``b``. Documents with equal
    words link with each other too and are not listed; ``link_counts`` counts them. Repeated rows are one document.
    """
    with shuffles_removed(docs.sparkSession):
        _, nodes, links = _all_links(docs, id_col, text_col, width, percent, **how)
    sides = [nodes.select(F.col("node").alias(s), F.struct(F.col("id").isNull().alias("none"), "id", "copies").alias(f"side_{s}")) for s in "ab"]
    both = links.join(sides[0], "a").join(sides[1], "b")
    low, high = F.least("side_a", "side_b"), F.greatest("side_a", "side_b")
    return both.select(
        low["id"].alias("a"), high["id"].alias("b"), low["copies"].alias("copies_a"), high["copies"].alias("copies_b")
    )


def link_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, percent: int = PERCENT, **how) -> DataFrame:
    """The number of documents that each one links with. One row per input row: identifier, ``n_shingles``, ``n_links``.

    Links are those of ``near_groups``, those between documents with equal words included, which are counted by their
    number and not compared. Repeated rows are one document with one result each; a document without words has no link.
    """
    with shuffles_removed(docs.sparkSession):
        found, nodes, links = _all_links(docs, id_col, text_col, width, percent, **how)
    ends = links.unionAll(links.select("b", "a")).toDF("node", "other")
    others = nodes.select(F.col("node").alias("other"), F.col("copies").alias("reached"))
    reached = ends.join(others, "other").groupBy("node").agg(F.sum("reached").alias("reached"))
    counted = nodes.join(reached, "node", "left").select(
        "one", "two", "n", (F.col("copies") - 1 + F.coalesce("reached", F.lit(0))).alias("n_links")
    )
    return found.join(counted, ["one", "two", "n"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")
    )
