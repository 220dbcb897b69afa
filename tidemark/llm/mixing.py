"""Mixing of sources to target weights by entropy balancing.

A document's *size* is its number of words. Of all rates with which documents could be taken, those closest in relative
entropy to taking each once, such that a source's expected words equal its target and no rate exceeds ``most``, are
``min(most, exp(tilt * size))`` with one tilt per source. The tilts solve the convex dual, here by Newton steps kept in a
bracket: each iteration is one aggregation over the numbers of documents per source and size, combined before the
shuffle, so a source that holds a third of all documents costs no more than others.

Rates are then rounded into copies. The whole part of a rate is taken for certain. Of the documents with a fraction, one
more copy is taken in the order of a stable random number divided by the fraction, until the source's target is reached;
where that point lies is found by descending through histograms of the order. The document at that point gives a cut
copy, so a source's words meet its target to the word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SMALL_ROWS, WORD, Scratch, join_small, numbered, row_key

MOST = 3
ITERATIONS = 100
TOLERANCE = 1e-9
ORDER_BITS = 50
LEVEL_BITS = 10


def word_count(text: Column) -> Column:
    """Number of words; null has none."""
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Add ``target`` to sources (weight, source_size): shares by weight of the total, none above ``most`` times its size."""
    total = sources.agg(F.sum("source_size").alias("n")).first()["n"] or 0
    full = F.lit(most) * F.col("source_size")
    share, capped = 0.0, None
    while True:
        over = F.col("weight") * F.lit(share) > full
        now = sources.agg(
            F.count(F.when(over, True)).alias("capped"),
            F.coalesce(F.sum(F.when(over, full)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("weights"),
        ).first()
        if now["capped"] == capped or not now["weights"]:
            return sources.withColumn("target", F.when(over, full.cast("double")).otherwise(F.col("weight") * F.lit(share)))
        capped, share = now["capped"], (total - now["given"]) / now["weights"]


def _rate(most: int) -> Column:
    tilted = F.exp(F.least(F.lit(700.0), F.col("tilt") * F.col("size") / F.col("scale")))
    return F.when(F.col("full"), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), tilted))


def balance(scratch: Scratch, counts: DataFrame, sources: DataFrame, n: int, most: int, tolerance: float) -> DataFrame:
    """Add the ``tilt`` of each source to sources (src, source_size, documents, target).

    ``counts`` has the number ``n`` of documents per src and size.
    """
    state = sources.select(
        "src", "source_size", "target", "weight",
        (F.col("source_size") / F.greatest(F.col("documents"), F.lit(1))).alias("scale"),
        (F.col("target") >= most * F.col("source_size")).alias("full"),
        F.lit(0.0).alias("tilt"),
        F.lit(-800.0).alias("low"),  # times size / scale; widened below by the scale
        F.lit(float("inf")).alias("error"),
    )
    # With the lower end all rates vanish, with the upper end all reach the cap, as sizes are 1 at least.
    state = state.withColumn("low", F.col("low") * F.col("scale")).withColumn("high", F.log(F.lit(float(most))) * F.col("scale"))
    state = scratch.write(state, "state-0")
    for step in range(1, ITERATIONS + 1):
        rate = _rate(most)
        words = F.col("n") * F.col("size")
        sums = (
            join_small(counts, state.select("src", "scale", "full", "tilt"), n, ["src"])
            .groupBy("src")
            .agg(
                F.sum(words * rate).alias("got"),
                F.sum(F.when(rate < most, words * rate * F.col("size") / F.col("scale")).otherwise(0.0)).alias("slope"),
            )
        )
        off = F.col("got") - F.col("target")
        low = F.when(off < 0, F.col("tilt")).otherwise(F.col("low"))
        high = F.when(off > 0, F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - off / F.nullif(F.col("slope"), F.lit(0.0))
        inside = newton.isNotNull() & (newton > low) & (newton < high)
        done = F.col("full") | F.col("got").isNull() | (F.abs(off) <= tolerance * F.col("target"))
        following = state.join(F.broadcast(sums) if n <= SMALL_ROWS else sums, "src", "left").select(
            "src", "source_size", "target", "weight", "scale", "full",
            F.when(done, F.col("tilt")).otherwise(F.when(inside, newton).otherwise((low + high) / 2)).alias("tilt"),
            low.alias("low"), high.alias("high"),
            F.when(done, 0.0).otherwise(F.abs(off)).alias("error"),
        )
        state = scratch.write(following, f"state-{step}")
        scratch.drop(f"state-{step - 1}")
        if not (state.agg(F.max("error").alias("e")).first()["e"] or 0.0):
            break
    # Sums of doubles depend on their order in the last bits; rounded tilts do not, so reruns agree.
    return state.withColumn("tilt", F.round("tilt", 12))


def _settle(scratch: Scratch, rows: DataFrame, sources: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Per source the place in the order up to which one more copy is taken: prefix, words missing, ties; and the bits below the prefix.

    Descends through histograms of 2 ** LEVEL_BITS classes: in each, the class that contains the last missing word.
    """
    base = rows.groupBy("src").agg(F.sum(F.col("copies") * F.col("size")).alias("sure"))
    state = sources.join(base, "src").select(
        "src", (F.round("target").cast("long") - F.col("sure")).alias("missing"), F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("ties")
    )
    state = scratch.write(state, f"settle-{ORDER_BITS}")
    shift = ORDER_BITS
    while shift > 0:
        shift -= LEVEL_BITS
        inside = join_small(rows.where("place IS NOT NULL"), state.select("src", "prefix"), n, ["src"]).where(
            F.shiftright("place", shift + LEVEL_BITS) == F.col("prefix")
        )
        classes = inside.groupBy("src", F.shiftright("place", shift).alias("class")).agg(
            F.sum("size").alias("words"), F.count(F.lit(1)).alias("n")
        )
        # At most 2 ** LEVEL_BITS rows per source.
        upto = Window.partitionBy("src").orderBy("class")
        running = classes.withColumn("upto", F.sum("words").over(upto))
        chosen = (
            join_small(running, state.select("src", "missing"), n, ["src"])
            .groupBy("src")
            .agg(
                F.min(F.when(F.col("upto") >= F.col("missing"), F.struct("class", "upto", "words", "n"))).alias("hit"),
                F.max(F.struct("class", "upto", "words", "n")).alias("last"),
            )
            .select("src", F.coalesce("hit", "last").alias("c"))
        )
        following = join_small(state, chosen, n, ["src"]).select(
            "src",
            (F.col("missing") - F.col("c.upto") + F.col("c.words")).alias("missing"),
            F.col("c.class").alias("prefix"),
            F.col("c.n").alias("ties"),
        )
        state = scratch.write(following, f"settle-{shift}")
        scratch.drop(f"settle-{shift + LEVEL_BITS}")
        if (state.agg(F.max("ties").alias("n")).first()["n"] or 0) <= 1:
            break
    return state, shift


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    most: int = MOST,
    tolerance: float = TOLERANCE,
) -> DataFrame:
    """How much of each document a mix takes whose size is that of all documents. One row per input row.

    Columns: the identifier, the source, ``size``, ``source_size``, ``target`` of the source, ``copies`` (whole ones),
    ``cut_words`` (words of one more, cut copy) and ``taken`` (words in all). Sources in order of code points, null last
    as a source of its own, have the ``weights`` in turn. A document without words is taken once, with no words. Rows
    repeated in all of identifier, source and size are treated alike. An empty table gives an empty result. Results
    depend only on the rows, not on their order or partitions. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    sizes = docs.select(
        F.col(id_col).alias("id"),
        row_key(F.col(source_col).cast("string").alias("source")).alias("src"),
        word_count(F.col(text_col)).alias("size"),
    )
    sizes = scratch.write(sizes, "sizes")
    counts = scratch.write(sizes.groupBy("src", "size").agg(F.count(F.lit(1)).alias("n")), "counts")
    sources = counts.groupBy("src").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("documents"))
    n = sources.count()
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    sources = scratch.write(numbered(scratch, sources, [F.col("src.source").isNull(), F.col("src.source")], "numbered").withColumn("weight", weight), "sources")
    sources = scratch.write(targets(sources, most), "targets")
    tilts = scratch.write(balance(scratch, counts.where("size > 0"), sources, n, most, tolerance), "tilts")

    wanted = join_small(sizes, tilts.select("src", "source_size", "target", "scale", "full", "tilt"), n, ["src"])
    wanted = wanted.withColumn("rate", F.when(F.col("size") == 0, 1.0).otherwise(_rate(most)))
    fraction = F.col("rate") - F.floor("rate")
    draw = (F.shiftrightunsigned(F.xxhash64("id", "src", "size"), 11) + 0.5) / float(1 << 53)
    odds = draw / F.when(fraction > 0, fraction)
    rows = wanted.select(
        "id", "src", "size", "source_size", "target",
        F.floor("rate").alias("copies"),
        F.least(F.floor(odds / (1 + odds) * float(1 << ORDER_BITS)), F.lit((1 << ORDER_BITS) - 1)).alias("place"),
    )
    rows = scratch.write(rows, "rows")
    settled, shift = _settle(scratch, rows, sources, n)
    at = F.shiftright("place", shift)
    whole = F.coalesce((at < F.col("prefix")).cast("long"), F.lit(0))
    share = F.floor(F.greatest(F.col("missing"), F.lit(0)) / F.greatest(F.col("ties"), F.lit(1)))
    cut = F.when(at == F.col("prefix"), F.least(F.col("size"), share)).otherwise(0).cast("long")
    # A cut copy of full length is a whole one.
    full_cut = (cut == F.col("size")) & (F.col("size") > 0) & (cut > 0)
    return (
        join_small(rows, settled.select("src", "missing", "prefix", "ties"), n, ["src"], "left")
        .select(
            F.col("id").alias(id_col),
            F.col("src.source").alias(source_col),
            "size", "source_size", "target",
            (F.col("copies") + whole + full_cut.cast("long")).alias("copies"),
            F.when(full_cut, F.lit(0)).otherwise(cut).cast("long").alias("cut_words"),
            (F.col("copies") * F.col("size") + whole * F.col("size") + cut).alias("taken"),
        )
    )


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The mix itself: each document as often as ``mix`` takes it, with all its columns.

    The text of a cut copy is its first ``cut_words`` words, joined by one space.
    """
    key = [F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source")]
    plan = mix(docs, id_col, text_col, source_col, **how).where("copies > 0 OR cut_words > 0")
    plan = plan.select(
        row_key(*key, "size").alias("__mix_key"), F.col("copies").alias("__copies"), F.col("cut_words").alias("__cut")
    ).dropDuplicates(["__mix_key"])
    taken = docs.withColumn("__mix_key", row_key(*key, word_count(F.col(text_col)).alias("size"))).join(plan, "__mix_key")
    taken = taken.withColumn(
        "__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies") + (F.col("__cut") > 0).cast("long")))
    )
    words = F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"({WORD})"))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("__cut").cast("int")), " ")
    text = F.when(F.col("__copy") > F.col("__copies"), cut).otherwise(F.col(text_col))
    return taken.select(*[text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
