"""Distributions of many features at once: exact quantiles, drift statistics, profiles.

Every statistic here is computed from one table of counts per (feature, value),
built by a single aggregation that combines on the map side. What follows works
on distinct values. Ordered passes over a feature are cut at approximate
quantiles of its values, so no task holds a whole feature; cut points never
influence a result.

``CUTS`` per feature and the number of features, which is the number of columns
of a table, bound everything that is broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import band, edges_below
from .timeline import running_totals

CUTS = 512
ONE_TASK = 1_000_000
FLOOR = 0.001
EXACT_PRODUCT = 1_000_000
CATEGORICAL_BELOW = 10
EPSILON = 1e-10

REFERENCE = 0
CURRENT = 1


def _is_number(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.NumericType, T.BooleanType))


def present(df: DataFrame, name: str) -> Column:
    """Whether a column holds a value: neither null nor, for fractions, NaN."""
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.col(name).isNotNull() & ~F.isnan(F.col(name))
    return F.col(name).isNotNull()


def is_comparable(data_type: T.DataType) -> bool:
    """Whether drift can be measured: text, numbers, flags, days and times, not nested or binary values."""
    return isinstance(data_type, (T.StringType, T.DateType, T.TimestampType, T.TimestampNTZType)) or _is_number(data_type)


def is_whole(data_type: T.DataType) -> bool:
    """Whether values are compared as 64-bit whole numbers, since a double does not hold them all: ids and times."""
    return isinstance(data_type, (T.LongType, T.TimestampType, T.TimestampNTZType))


def as_number(df: DataFrame, name: str, target: str = "double") -> Column:
    """A column's value as a number: days and microseconds since 1970 for days and times."""
    kind, value = df.schema[name].dataType, F.col(name)
    if isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        value = F.unix_micros(value.cast("timestamp"))
    return value.cast(target)


def long_form(df: DataFrame, features: Sequence[str], as_text: bool = False, whole: bool = False) -> DataFrame:
    """One row (feature, value) per feature of a row; missing values are null.

    Values are text, 64-bit whole numbers, or else doubles.
    """

    def value(name: str) -> Column:
        return F.col(name).cast("string") if as_text else as_number(df, name, "bigint" if whole else "double")

    pairs = [
        F.struct(F.lit(name).alias("feature"), F.when(present(df, name), value(name)).alias("value")) for name in features
    ]
    return df.select(F.explode(F.array(*pairs)).alias("__pair")).select("__pair.*")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per non-null value, and their share of all non-null rows."""
    counts = df.where(present(df, column)).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n")).scalar()
    return counts.withColumn("share", F.col("n") / total)


def _per_side() -> list[Column]:
    return [
        F.count_if(F.col("side") == REFERENCE).alias("n_ref"),
        F.count_if(F.col("side") == CURRENT).alias("n_cur"),
    ]


def _sides(
    reference: DataFrame, current: DataFrame, features: Sequence[str], as_text: bool = False, whole: bool = False
) -> DataFrame:
    """The values of both tables in long form with the side they are from."""
    return (
        long_form(reference, features, as_text, whole)
        .withColumn("side", F.lit(REFERENCE))
        .unionByName(long_form(current, features, as_text, whole).withColumn("side", F.lit(CURRENT)))
        .where(F.col("value").isNotNull())
    )


def side_counts(
    reference: DataFrame, current: DataFrame, features: Sequence[str], as_text: bool = False, whole: bool = False
) -> DataFrame:
    """Rows of each side per (feature, value): columns ``n_ref`` and ``n_cur``."""
    return (
        _sides(reference, current, features, as_text, whole)
        .groupBy("feature", "value")
        .agg(*_per_side())
        # Always true. It makes every use of the counts need both columns, so all
        # uses within a query are the same plan and share one scan and one shuffle.
        .where(F.col("n_ref") + F.col("n_cur") > 0)
    )


def side_totals(counts: DataFrame) -> DataFrame:
    """Rows and distinct values of each feature: one row per feature."""
    return counts.groupBy("feature").agg(
        F.sum("n_ref").alias("ref_rows"),
        F.sum("n_cur").alias("cur_rows"),
        F.count_if(F.col("n_ref") > 0).alias("ref_distinct"),
    )


def is_large(*tables: DataFrame) -> bool:
    """Whether a feature may have more values than one task should put in order."""
    return sum(table.count() for table in tables) > ONE_TASK


def cumulative(counts: DataFrame, columns: Sequence[str], large: bool = True) -> DataFrame:
    """Add running sums ``cum_<column>`` over each feature's values in order.

    ``large`` cuts features into ranges of values, one task each. Pass the result
    of :func:`is_large` to save that for small tables.
    """
    totals = {f"cum_{name}": F.col(name) for name in columns}
    if not large:
        return running_totals(counts, ["feature"], [F.col("value")], totals, False)
    percentages = [i / CUTS for i in range(1, CUTS)]
    edges = counts.groupBy("feature").agg(
        F.array_distinct(F.approx_percentile("value", percentages, 2 * CUTS)).alias("__edges")
    )
    cut = (
        counts.join(F.broadcast(edges), "feature")
        .withColumn("__cut", edges_below(F.col("__edges"), F.col("value"), CUTS).cast("bigint"))
        .drop("__edges")
    )
    return running_totals(cut, ["feature"], [F.col("value")], totals, True, "__cut").drop("__cut")


def ks_statistic(counts: DataFrame, large: bool = True) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic per feature with both sides' rows."""
    totals = F.broadcast(side_totals(counts))
    gap = F.abs(F.col("cum_n_ref") / F.col("ref_rows") - F.col("cum_n_cur") / F.col("cur_rows"))
    return (
        cumulative(counts, ["n_ref", "n_cur"], large)
        .join(totals, "feature")
        .where((F.col("ref_rows") > 0) & (F.col("cur_rows") > 0))
        .groupBy("feature")
        .agg(
            F.max(gap).alias("ks"),
            F.first("ref_rows").alias("ref_rows"),
            F.first("cur_rows").alias("cur_rows"),
        )
    )


def ks_p_value(statistic: Column, ref_rows: Column, cur_rows: Column, terms: int = 100) -> Column:
    """Asymptotic p-value of a two-sample statistic (Kolmogorov's series)."""
    scale = F.sqrt(ref_rows * cur_rows / (ref_rows + cur_rows).cast("double"))
    x = statistic * scale
    ks = F.sequence(F.lit(1), F.lit(terms))
    series = F.aggregate(
        ks,
        F.lit(0.0),
        lambda total, k: total + F.pow(F.lit(-1.0), k - 1) * F.exp(-2.0 * k * k * x * x),
    )
    # Below this point the series has not converged, and the value is 1 to many digits.
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * series)))


def ks_exact_p_value(statistic: Column, ref_rows: Column, cur_rows: Column, most_product: int = EXACT_PRODUCT) -> Column:
    """p-value of a two-sample statistic: exact for small samples, the series beyond ``most_product`` pairs of rows.

    Two samples of n and m rows without drift are a random path of n steps to the right and m up. The statistic stays
    below d if the path stays where ``|i / n - j / m| < d``. The chance of that is summed up step by step: the chance of
    being at each place, which needs no large numbers. One expression per row, of n * (n + m) terms.
    """
    n, m = ref_rows.cast("bigint"), cur_rows.cast("bigint")
    # Differences are whole multiples of 1 / (n m).
    limit = F.round(statistic * n * m).cast("bigint")
    places = F.sequence(F.lit(0).cast("bigint"), n)

    def step(chances: Column, s: Column) -> Column:
        left = (n + m - s + 1).cast("double")

        def at(i: Column) -> Column:
            j = s - i
            came = F.coalesce(F.get(chances, (i - 1).cast("int")), F.lit(0.0)) * (n - i + 1) + F.get(chances, i.cast("int")) * (m - j + 1)
            return F.when((j >= 0) & (j <= m) & (F.abs(i * m - j * n) < limit), came / left).otherwise(F.lit(0.0))

        return F.transform(places, at)

    start = F.transform(places, lambda i: F.when(i == 0, F.lit(1.0)).otherwise(F.lit(0.0)))
    inside = F.get(F.reduce(F.sequence(F.lit(1).cast("bigint"), n + m), start, step), n.cast("int"))
    exact = F.when(limit <= 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - inside))
    return F.when(n * m <= most_product, exact).otherwise(ks_p_value(statistic, ref_rows, cur_rows))


def _shares(counts: DataFrame) -> DataFrame:
    return (
        counts.join(F.broadcast(side_totals(counts)), "feature")
        .where((F.col("ref_rows") > 0) & (F.col("cur_rows") > 0))
        .withColumns({"p": F.col("n_ref") / F.col("ref_rows"), "q": F.col("n_cur") / F.col("cur_rows")})
    )


def chi_squared(counts: DataFrame) -> DataFrame:
    """Sum over values of (p - q)^2 / (p + epsilon), at most 1, per feature."""
    term = F.pow(F.col("p") - F.col("q"), 2) / (F.col("p") + EPSILON)
    return _shares(counts).groupBy("feature").agg(F.least(F.sum(term), F.lit(1.0)).alias("chi2"))


def _kl_part(a: str, b: str) -> Column:
    mid = (F.col(a) + F.col(b)) / 2
    return F.when(F.col(a) > 0, F.col(a) * F.log2(F.col(a) / mid)).otherwise(F.lit(0.0))


def jensen_shannon(counts: DataFrame) -> DataFrame:
    """Jensen-Shannon divergence in bits (0 to 1) over the values or bins of each feature."""
    parts = (_kl_part("p", "q") + _kl_part("q", "p")) / 2
    return _shares(counts).groupBy("feature").agg(F.greatest(F.sum(parts), F.lit(0.0)).alias("js"))


def exact_quantiles(
    counts: DataFrame, percentages: Sequence[float], weight: str = "n_ref", large: bool = True
) -> DataFrame:
    """Quantiles with linear interpolation per feature, as an array in the order asked.

    A rank falls on exactly one value, so all but a few rows per feature are
    dropped before the final aggregation.
    """
    rows = cumulative(counts.where(F.col(weight) > 0), [weight], large)
    total = F.broadcast(counts.groupBy("feature").agg(F.sum(weight).alias("__total")))
    asked = F.array(
        *[
            F.struct(F.lit(i).alias("place"), (F.lit(float(p)) * (F.col("__total") - 1)).alias("rank"))
            for i, p in enumerate(percentages)
        ]
    )
    last = F.col(f"cum_{weight}") - 1
    first = F.col(f"cum_{weight}") - F.col(weight)

    def covers(rank: Column) -> Column:
        return (F.floor(rank) <= last) & (F.ceil(rank) >= first)

    ranks = [F.lit(float(p)) * (F.col("__total") - 1) for p in percentages]
    hits = (
        rows.join(total, "feature")
        .withColumn("__first", first)
        .withColumn("__last", last)
        .where(reduce(lambda a, b: a | b, [covers(rank) for rank in ranks]))
        .withColumn("__hit", F.explode(F.filter(asked, lambda a: covers(a["rank"]))))
    )
    rank = F.col("__hit.rank")
    low = F.max(F.when(F.floor(rank).between(F.col("__first"), F.col("__last")), F.col("value")))
    high = F.max(F.when(F.ceil(rank).between(F.col("__first"), F.col("__last")), F.col("value")))
    points = hits.groupBy("feature", F.col("__hit.place").alias("place"), rank.alias("rank")).agg(
        low.alias("low"), high.alias("high")
    )
    value = F.col("low") + (F.col("high") - F.col("low")) * (F.col("rank") - F.floor("rank"))
    return (
        points.groupBy("feature")
        .agg(F.array_sort(F.collect_list(F.struct("place", value.alias("value")))).alias("__points"))
        .select("feature", F.transform("__points", lambda point: point["value"]).alias("quantiles"))
    )


def quantile_edges(
    reference: DataFrame,
    features: Sequence[str],
    buckets: int = 10,
    approximate: bool = False,
    large: bool | None = None,
) -> dict[str, list[float]]:
    """Sorted distinct edges of equal-share bins of a table, per feature.

    The edges are computed now, once: at most ``buckets + 1`` numbers per column
    of the table. ``approximate`` takes them from a sketch, without a shuffle of
    the values.
    """
    grid = [i / buckets for i in range(buckets + 1)]
    values = long_form(reference, features).where(F.col("value").isNotNull())
    if approximate:
        found = values.groupBy("feature").agg(F.approx_percentile("value", grid).alias("quantiles"))
    else:
        counts = values.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
        found = exact_quantiles(counts, grid, "n", is_large(reference) if large is None else large)
    return {row["feature"]: sorted(set(row["quantiles"])) for row in found.collect()}


def bin_counts(
    reference: DataFrame, current: DataFrame, edges: Mapping[str, Sequence[float]], open_ends: bool = False
) -> DataFrame:
    """Rows of each side per (feature, bin), every bin present, and rows outside.

    Bins are closed on the right, the first also on the left. Values outside the
    edges have a null bin, unless ``open_ends`` counts them in the outer bins.
    Rows are binned where they are read and counted before the shuffle, which
    moves a row per bin and task.
    """

    def binned(df: DataFrame, side: int) -> DataFrame:
        pairs = []
        for name, limits in edges.items():
            value = as_number(df, name)
            place = F.greatest(sum((value > limit).cast("int") for limit in limits), F.lit(1))
            if open_ends:
                place = F.least(place, F.lit(len(limits) - 1))
            else:
                place = F.when(value.between(limits[0], limits[-1]), place)
            pairs.append(
                F.struct(F.lit(name).alias("feature"), place.alias("bin"), present(df, name).alias("present"))
            )
        rows = df.select(F.explode(F.array(*pairs)).alias("__b")).select("__b.*")
        return rows.where("present").select("feature", "bin", F.lit(side).alias("side"))

    counted = (
        binned(reference, REFERENCE)
        .unionByName(binned(current, CURRENT))
        .groupBy("feature", "bin")
        .agg(*_per_side())
    )
    all_bins = [(name, i, 0, 0) for name, limits in edges.items() for i in range(1, len(limits))]
    empty = reference.sparkSession.createDataFrame(all_bins, "feature string, bin int, n_ref bigint, n_cur bigint")
    return counted.unionByName(empty).groupBy("feature", "bin").agg(
        F.sum("n_ref").alias("n_ref"), F.sum("n_cur").alias("n_cur")
    )


def psi(
    reference: DataFrame,
    current: DataFrame,
    features: Sequence[str],
    buckets: int = 10,
    floor: float = FLOOR,
    open_ends: bool = False,
    approximate: bool = False,
    large: bool | None = None,
) -> DataFrame:
    """Population stability index per feature, with its band and the share left out.

    Shares below ``floor`` are raised to it, so that empty bins give a finite
    index. A constant reference has no bins and an index of 0. A feature without
    reference values has no index; its band is ``no_reference``.
    """
    edges = quantile_edges(reference, features, buckets, approximate, large)
    unknown = [name for name in features if name not in edges]
    rows = _psi(reference, current, edges, floor, open_ends) if edges else None
    if unknown:
        listed = F.explode(F.array(*[F.lit(name) for name in unknown])).alias("feature")
        empty = reference.sparkSession.range(1).select(
            listed,
            F.lit(None).cast("double").alias("psi"),
            F.lit(0.0).alias("out_of_range"),
            F.lit("no_reference").alias("psi_band"),
        )
        rows = empty if rows is None else rows.unionByName(empty)
    return rows


def _psi(
    reference: DataFrame, current: DataFrame, edges: Mapping[str, Sequence[float]], floor: float, open_ends: bool
) -> DataFrame:
    inside = F.col("bin").isNotNull()
    # A few rows per feature from here on.
    binned = bin_counts(reference, current, edges, open_ends).groupBy("feature").agg(
        F.collect_list(F.when(inside, F.struct("n_ref", "n_cur"))).alias("bins"),
        F.coalesce(F.sum(F.when(inside, F.col("n_ref"))), F.lit(0)).alias("__ref"),
        F.coalesce(F.sum(F.when(inside, F.col("n_cur"))), F.lit(0)).alias("__cur"),
        F.coalesce(F.sum(F.when(~inside, F.col("n_cur"))), F.lit(0)).alias("__out"),
    )

    def share(count: Column, total: str) -> Column:
        return F.greatest(F.coalesce(F.try_divide(count, F.col(total)), F.lit(0.0)), F.lit(floor))

    def term(pair: Column) -> Column:
        p, q = share(pair["n_ref"], "__ref"), share(pair["n_cur"], "__cur")
        return (q - p) * F.log(q / p)

    index = F.aggregate("bins", F.lit(0.0), lambda total, pair: total + term(pair))
    flat = [name for name, limits in edges.items() if len(limits) < 2]
    return binned.select(
        "feature",
        F.when(F.col("feature").isin(*flat), F.lit(0.0)).otherwise(index).alias("psi"),
        F.coalesce(F.try_divide("__out", F.col("__out") + F.col("__cur")), F.lit(0.0)).alias("out_of_range"),
    ).withColumn("psi_band", band(F.col("psi"), [(0.1, "moderate"), (0.2, "significant")], "none"))


def profile(
    df: DataFrame, features: Sequence[str] | None = None, exact_distinct: bool = True
) -> DataFrame:
    """Mean, sample deviation, min, max, missing percent and distinct count per column.

    Text columns have nulls for the first four. All but the distinct counts come
    from one aggregation that shuffles a single row per task. Exact distinct
    counts shuffle the distinct values; ``exact_distinct=False`` replaces them
    by a sketch in the same aggregation.
    """
    features = list(features or df.columns)
    stats = []
    for name in features:
        here = present(df, name)
        number = F.when(here, F.col(name).cast("double")) if _is_number(df.schema[name].dataType) else None
        missing = F.lit(None).cast("double")
        stats.append(
            F.struct(
                F.lit(name).alias("feature"),
                (missing if number is None else F.avg(number)).alias("mean"),
                (missing if number is None else F.stddev_samp(number)).alias("std"),
                (missing if number is None else F.min(number)).alias("min"),
                (missing if number is None else F.max(number)).alias("max"),
                (F.avg((~here).cast("int")) * 100).alias("missing_pct"),
                (F.lit(0).cast("bigint") if exact_distinct else F.approx_count_distinct(F.when(here, F.col(name)))).alias(
                    "unique_count"
                ),
            )
        )
    rows = df.agg(F.array(*stats).alias("__rows")).select(F.explode("__rows").alias("__row")).select("__row.*")
    if not exact_distinct:
        return rows
    fractions = [f for f in features if isinstance(df.schema[f].dataType, (T.FloatType, T.DoubleType))]
    others = [f for f in features if f not in fractions]
    sets = [
        long_form(df, names, as_text)
        .where(F.col("value").isNotNull())
        .distinct()
        .groupBy("feature")
        .agg(F.count(F.lit(1)).alias("unique_count"))
        for names, as_text in ((fractions, False), (others, True))
        if names
    ]
    distinct = reduce(DataFrame.unionByName, sets)
    return rows.drop("unique_count").join(distinct, "feature", "left").fillna(0, ["unique_count"])
