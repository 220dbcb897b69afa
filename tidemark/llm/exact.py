"""Exact deduplication by a tree merge of sorted digest runs.

Every input partition makes one run: its distinct digests with the number of rows and the identifier to retain. Slots
then exchange runs in binomial rounds, like recursive halving in a reduce-scatter: in a round, the ``2 ** bits`` slots
that differ in the round's bits send each other the part of their run that belongs to the other, and each merges what it
receives with what it keeps. After all rounds a slot holds everything about its share of the digests, so work and memory
are spread evenly however large a group of copies is: a run has one entry for a digest, whatever its number of rows.

Texts are compared by SHA-256, byte length and a second, independent 64-bit hash together; entries merge only where all
three agree, at every level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, row_key

SLOT_BITS = 6
ROUND_BITS = 3
DIGEST = ("sha", "bytes", "second")


def digest_columns(text: Column) -> list[Column]:
    """The digest of a text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return [F.sha2(text, 256).alias("sha"), F.octet_length(text).alias("bytes"), F.xxhash64(text).alias("second")]


def merge_round(runs: DataFrame, slots: int, shift: int, bits: int, largest: bool) -> DataFrame:
    """One exchange between slots that differ in ``bits`` bits from ``shift`` on, and the merge of what meets."""
    mask = ((1 << bits) - 1) << shift
    home = F.pmod(F.col("second"), F.lit(slots)).cast("int")
    goes_to = F.col("slot").bitwiseAND(F.lit(~mask)).bitwiseOR(home.bitwiseAND(F.lit(mask)))
    retain = F.max if largest else F.min
    return (
        runs.withColumn("slot", goes_to)
        .repartitionById(slots, F.col("slot"))
        .sortWithinPartitions("slot", *DIGEST)
        .groupBy("slot", *DIGEST)
        .agg(retain("keep").alias("keep"), F.sum("rows").alias("rows"))
    )


def tree_merge(runs: DataFrame, slot_bits: int = SLOT_BITS, round_bits: int = ROUND_BITS, largest: bool = True) -> DataFrame:
    """One row per digest from runs (slot, sha, bytes, second, keep, rows) with slots below ``2 ** slot_bits``."""
    for shift in range(0, slot_bits, round_bits):
        runs = merge_round(runs, 1 << slot_bits, shift, min(round_bits, slot_bits - shift), largest)
    return runs


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    largest: bool = True,
    slot_bits: int = SLOT_BITS,
    round_bits: int = ROUND_BITS,
) -> DataFrame:
    """Groups of rows with identical texts, one row per input row.

    Columns: the identifier, ``keep_id`` (that of the row that stays: the largest, or the smallest), ``group_size``,
    ``kept`` and ``text_sha256``. Null texts count as empty, and empty texts are equal. A null identifier ranks below
    all others. Where one row occurs several times with one identifier, exactly one of them is kept. An empty table
    gives an empty result; other columns of the input are not read.
    """
    scratch = Scratch(docs.sparkSession, "exact")
    rows = scratch.write(
        docs.select(
            F.col(id_col).alias("id"),
            *digest_columns(F.col(text_col)),
            F.pmod(F.spark_partition_id(), F.lit(1 << slot_bits)).alias("slot"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "rows",
    )
    # Nulls come first in the order of structs, so a null identifier loses against any other if the largest stays;
    # the flag makes it lose also if the smallest stays.
    rank = row_key(F.col("id").isNotNull() if largest else F.col("id").isNull(), F.col("id"), F.col("tie"))
    retain = F.max if largest else F.min
    runs = rows.groupBy("slot", *DIGEST).agg(retain(rank).alias("keep"), F.count(F.lit(1)).alias("rows"))
    merged = tree_merge(runs, slot_bits, round_bits, largest)
    # Only groups of several rows are joined back; a digest with one row keeps that row.
    groups = merged.where("rows > 1").select(*DIGEST, "keep", F.col("rows").alias("n"))
    found = rows.join(groups, list(DIGEST), "left")
    return found.select(
        F.col("id").alias(id_col),
        F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        (F.col("n").isNull() | (F.col("keep.tie") == F.col("tie"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_rows(docs: DataFrame, keys: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose identifier and SHA-256 of the text are among ``keys``, one for each, with all columns.

    ``keys`` has the columns ``id`` and ``sha``.
    """
    same = F.sha2(F.coalesce(F.col(text_col).cast("string"), F.lit("")), 256)
    key = "__kept_row_key"
    marked = docs.withColumn(key, row_key(F.col(id_col).alias("id"), same.alias("sha")))
    wanted = keys.select(row_key("id", "sha").alias(key))
    return marked.join(wanted, key, "left_semi").dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in docs.columns])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", largest: bool = True) -> DataFrame:
    """The documents that stay, with their columns as they are."""
    kept = exact_groups(docs, id_col, text_col, largest).where("kept")
    return keep_rows(docs, kept.select(F.col(id_col).alias("id"), F.col("text_sha256").alias("sha")), id_col, text_col)
