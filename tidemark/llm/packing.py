"""Best-fit packing of documents into sequences of several permitted lengths.

Documents longer than the longest sequence are cut into pieces. Pieces are dealt at random into groups of about
``GROUP_PIECES``, each packed in one task: with that many pieces a group's packing is within a fraction of a bin of what
one group for all would give, and memory does not grow with the table.

A group is packed largest piece first. A piece goes where it leaves the least room. Where it fits nowhere, a bin of the
length with the least cost per word is opened, counting only words that the group still has to place. The lengths are
optimised jointly: the group is packed once with each permitted length as the longest that is opened for pieces which
fit it, every bin is downsized to the shortest length that holds its contents, and the cheapest packing is taken.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .mixing import word_count

LENGTHS = (512, 1024, 2048, 4096)
OVERHEAD = 16
GROUP_PIECES = 50_000


def bin_cost(length: int, overhead: int = OVERHEAD) -> int:
    """Cost of one sequence: its length, padding included, and a fixed overhead."""
    return length + overhead


def best_fit(sizes: Sequence[int], lengths: Sequence[int], longest: int, overhead: int = OVERHEAD) -> tuple[list[int], list[int]]:
    """Pack sizes, given in descending order: the bin of each, and the length of each bin after downsizing.

    ``longest`` is the longest length opened for pieces that fit it.
    """
    free: list[int] = []  # rooms of open bins, ascending, each once
    bins: dict[int, list[int]] = {}
    used: list[int] = []
    opened: list[int] = []
    where = []
    remaining = sum(sizes)
    for size in sizes:
        i = bisect.bisect_left(free, size)
        if i < len(free):
            room = free[i]
            number = bins[room].pop()
            if not bins[room]:
                del bins[room], free[i]
        else:
            fits = [c for c in lengths if c >= size]
            allowed = [c for c in fits if c <= longest] or fits[:1]
            room = min(allowed, key=lambda c: (bin_cost(c, overhead) / max(1, min(c, remaining)), c))
            number = len(used)
            used.append(0)
            opened.append(room)
        used[number] += size
        remaining -= size
        where.append(number)
        left = room - size
        if left > 0:
            if left not in bins:
                bins[left] = []
                bisect.insort(free, left)
            bins[left].append(number)
    return where, [next(c for c in lengths if c >= u) for u in used]


def _pack_group(lengths: tuple[int, ...], overhead: int):
    def run(pieces: pd.DataFrame) -> pd.DataFrame:
        pieces = pieces.sort_values(["words", "row", "piece"], ascending=[False, True, True], kind="stable")
        sizes = pieces["words"].tolist()
        packings = [best_fit(sizes, lengths, longest, overhead) for longest in lengths]
        where, capacity = min(packings, key=lambda p: sum(bin_cost(c, overhead) for c in p[1]))
        out = pieces[["row", "piece", "start", "words"]].copy()
        bins = np.asarray(where, np.int64)
        out["bin_id"] = pieces["part"].to_numpy(np.int64) * (1 << 32) + bins
        out["capacity"] = np.asarray(capacity, np.int64)[bins] if len(bins) else bins
        out["offset"] = pieces.assign(b=bins).groupby("b")["words"].cumsum() - pieces["words"]
        out["filled"] = pieces.assign(b=bins).groupby("b")["words"].transform("sum")
        return out

    return run


def _text_key(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lengths: Sequence[int] = LENGTHS,
    overhead: int = OVERHEAD,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """Place every word of every document in a sequence. One row per piece.

    Columns: the identifier, ``piece`` (from 0), ``start`` and ``words`` (the piece's words in the document), ``bin_id``,
    ``capacity`` (the sequence's length), ``offset`` of the piece in it, ``filled`` (words in the sequence), and
    ``text_key``, a hash of the text that with the identifier names the document to ``texts``. Pieces of a document are
    all of the longest length but the last. Documents without words (null and empty texts) are in no
    sequence and give a row with 0 words and null sequence. Repeated rows are packed each for itself. An empty table
    gives an empty result. Other columns are not read.
    """
    lengths = tuple(sorted(lengths))
    if not lengths or lengths[0] < 1:
        raise ValueError("lengths must be positive")
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.write(
        docs.select(
            F.col(id_col).alias("id"), _text_key(text_col).alias("text_key"), word_count(F.col(text_col)).alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "rows",
    )
    longest = lengths[-1]
    total = rows.agg(F.sum(F.ceil(F.col("size") / longest)).alias("n")).first()["n"] or 0
    groups = max(1, -(-int(total) // group_pieces))
    last = F.floor((F.col("size") - 1) / longest)
    pieces = (
        rows.where("size > 0")
        .select("row", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select(
            "row", "piece",
            (F.col("piece") * longest).alias("start"),
            F.least(F.lit(longest), F.col("size") - F.col("piece") * longest).alias("words"),
            F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("int").alias("part"),
        )
    )
    placed = pieces.groupBy("part").applyInPandas(
        _pack_group(lengths, overhead),
        "row long, piece long, start long, words long, bin_id long, capacity long, offset long, filled long",
    )
    out = rows.select("id", "text_key", "row").join(placed, "row", "left")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("piece", F.lit(0).cast("long")).alias("piece"),
        F.coalesce("start", F.lit(0).cast("long")).alias("start"),
        F.coalesce("words", F.lit(0).cast("long")).alias("words"),
        "bin_id", "capacity", "offset", "filled", "text_key",
    )


def texts(docs: DataFrame, packed: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sequences' words for packed rows: one row per sequence with ``words`` joined by one space, in order.

    A piece is cut from the document with its identifier and text, also where the identifier is null or others share it.
    """
    words = F.expr(f"regexp_extract_all(cast(`{text_col}` as string), '[^\\\\x20\\\\x09-\\\\x0D]+', 0)")
    whole = docs.select(F.col(id_col).alias("__id"), _text_key(text_col).alias("__key"), words.alias("__words")).dropDuplicates(["__id", "__key"])
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("text_key") == F.col("__key"))
    held = packed.where("bin_id IS NOT NULL").join(whole, same)
    part = F.array_join(F.slice("__words", (F.col("start") + 1).cast("int"), F.col("words").cast("int")), " ")
    return (
        held.groupBy("bin_id", "capacity")
        .agg(F.array_sort(F.collect_list(F.struct("offset", part.alias("part")))).alias("parts"))
        .select("bin_id", "capacity", F.array_join(F.transform("parts", lambda p: p["part"]), " ").alias("words"))
    )
