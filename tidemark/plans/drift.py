"""Drift of line items shipped early and late, and of early and late event values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import distribution as D
from ..operators import sketches
from ..operators.drift import (
    detailed_report,
    drift_summary,
    feature_drift,
    prediction_drift,
    retraining_requests,
)
from ..session import shared_dir
from .tables import events, table

NUMERIC = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
TEXT = ["l_returnflag", "l_linestatus"]
SPLIT = "1998-07-01"


def _sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Reference and current line items; prices of the current side are raised, so one feature drifts."""
    rows = table(spark, folder, "lineitem")
    early = F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")
    current = rows.where(~early).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.5)
    return rows.where(early), current


def _numeric_counts(spark: SparkSession, folder: str) -> DataFrame:
    return D.side_counts(*_sides(spark, folder), NUMERIC)


def _large(spark: SparkSession, folder: str) -> bool:
    return D.is_large(*_sides(spark, folder))


def _text_counts(spark: SparkSession, folder: str) -> DataFrame:
    return D.side_counts(*_sides(spark, folder), TEXT, as_text=True)


def drift_ks(spark: SparkSession, folder: str) -> DataFrame:
    return D.ks_statistic(_numeric_counts(spark, folder), _large(spark, folder)).select(
        "feature", F.round("ks", 8).alias("ks"), "ref_rows", "cur_rows"
    )


def drift_chi2(spark: SparkSession, folder: str) -> DataFrame:
    return D.chi_squared(_text_counts(spark, folder)).select("feature", F.round("chi2", 8).alias("chi2"))


def drift_js(spark: SparkSession, folder: str) -> DataFrame:
    """Over categories, and over the reference's quantile bins for numbers."""
    reference, current = _sides(spark, folder)
    bins = D.bin_counts(reference, current, D.quantile_edges(reference, NUMERIC), open_ends=True)
    return (
        D.jensen_shannon(_text_counts(spark, folder))
        .unionByName(D.jensen_shannon(bins))
        .select("feature", F.round("js", 8).alias("js"))
    )


def drift_psi(spark: SparkSession, folder: str) -> DataFrame:
    return D.psi(*_sides(spark, folder), NUMERIC).select(
        "feature", F.round("psi", 8).alias("psi"), F.round("out_of_range", 8).alias("out_of_range"), "psi_band"
    )


def quantiles(spark: SparkSession, folder: str) -> DataFrame:
    """Exact deciles of the reference side, one row each."""
    grid = [i / 10 for i in range(11)]
    found = D.exact_quantiles(_numeric_counts(spark, folder), grid, large=_large(spark, folder))
    return found.select("feature", F.posexplode("quantiles").alias("decile", "value")).withColumn(
        "value", F.round("value", 6)
    )


LONG_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {c} * (CASE WHEN cur AND '{c}' = 'l_extendedprice' THEN 1.5::DOUBLE ELSE 1 END) AS value, cur FROM s"
    for c in NUMERIC
)
NUMERIC_SQL = f"""
    s AS (SELECT *, l_shipdate >= TIMESTAMP '{SPLIT}' AS cur FROM lineitem),
    long AS ({LONG_SQL})"""
KS_SQL = f"""{NUMERIC_SQL},
    n AS (SELECT feature, count(*) FILTER (NOT cur) AS ref_rows, count(*) FILTER (cur) AS cur_rows FROM long GROUP BY feature),
    cdf AS (SELECT feature, value, sum((NOT cur)::INT) OVER w AS r, sum(cur::INT) OVER w AS c FROM long
            WINDOW w AS (PARTITION BY feature ORDER BY value)),
    ks AS (SELECT feature, max(abs(r / ref_rows::DOUBLE - c / cur_rows::DOUBLE)) AS ks, any_value(ref_rows) AS ref_rows,
                  any_value(cur_rows) AS cur_rows FROM cdf JOIN n USING (feature) GROUP BY feature)"""
TEXT_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, {c} AS value,
               count(*) FILTER (l_shipdate < TIMESTAMP '{SPLIT}') AS n_ref,
               count(*) FILTER (l_shipdate >= TIMESTAMP '{SPLIT}') AS n_cur FROM lineitem GROUP BY {c}"""
    for c in TEXT
)
SHARES_SQL = f"""
    counts AS ({TEXT_SQL}),
    shares AS (SELECT feature, n_ref / sum(n_ref) OVER (PARTITION BY feature)::DOUBLE AS p,
                      n_cur / sum(n_cur) OVER (PARTITION BY feature)::DOUBLE AS q FROM counts)"""
BINS_SQL = f"""{NUMERIC_SQL},
    edges AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1])
              FILTER (NOT cur))) AS edges FROM long GROUP BY feature),
    placed AS (SELECT feature, cur, len(edges) - 1 AS bins, value BETWEEN edges[1] AND edges[-1] AS inside,
                      greatest(len(list_filter(edges, lambda e: e < value)), 1) AS bin
               FROM long JOIN edges USING (feature)),
    grid AS (SELECT feature, unnest(generate_series(1, len(edges) - 1)) AS bin FROM edges)"""
KL_SQL = "CASE WHEN {a} > 0 THEN {a} * log2({a} / (({a} + {b}) / 2)) ELSE 0 END"
JS_TERM_SQL = f"sum(({KL_SQL.format(a='p', b='q')} + {KL_SQL.format(a='q', b='p')}) / 2)"
PSI_SQL = f"""
    WITH {BINS_SQL},
    counts AS (SELECT grid.feature, grid.bin, count(*) FILTER (inside AND NOT cur) AS n_ref,
                      count(*) FILTER (inside AND cur) AS n_cur
               FROM grid LEFT JOIN placed ON grid.feature = placed.feature AND grid.bin = placed.bin GROUP BY ALL),
    shares AS (SELECT feature, greatest(n_ref / sum(n_ref) OVER f::DOUBLE, 0.001) AS p,
                      greatest(n_cur / sum(n_cur) OVER f::DOUBLE, 0.001) AS q FROM counts
               WINDOW f AS (PARTITION BY feature)),
    psi AS (SELECT feature, sum((q - p) * ln(q / p)) AS psi FROM shares GROUP BY feature),
    outside AS (SELECT feature, count(*) FILTER (cur AND NOT inside) / count(*) FILTER (cur)::DOUBLE AS out
                FROM placed GROUP BY feature)
    SELECT feature, round(psi, 8) AS psi, round(out, 8) AS out_of_range,
           CASE WHEN psi >= 0.2 THEN 'significant' WHEN psi >= 0.1 THEN 'moderate' ELSE 'none' END AS psi_band
    FROM psi JOIN outside USING (feature)"""
JS_SQL = f"""
    WITH {SHARES_SQL}, {BINS_SQL},
    counted AS (SELECT feature, least(bin, bins) AS bin, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur
                FROM placed GROUP BY ALL),
    binned AS (SELECT feature, n_ref / sum(n_ref) OVER (PARTITION BY feature)::DOUBLE AS p,
                      n_cur / sum(n_cur) OVER (PARTITION BY feature)::DOUBLE AS q FROM counted),
    every AS (SELECT * FROM shares UNION ALL SELECT * FROM binned)
    SELECT feature, round({JS_TERM_SQL}, 8) AS js FROM every GROUP BY feature"""
QUANTILES_SQL = f"""
    WITH {NUMERIC_SQL},
    q AS (SELECT feature, quantile_cont(value, [0, .1, .2, .3, .4, .5, .6, .7, .8, .9, 1]) FILTER (NOT cur) AS qs
          FROM long GROUP BY feature)
    SELECT feature, i::INT AS decile, round(qs[i + 1], 6) AS value FROM q, generate_series(0, 10) g(i)"""


def drift_report(spark: SparkSession, folder: str) -> DataFrame:
    report = feature_drift(*_sides(spark, folder), NUMERIC + TEXT)
    return report.withColumn("score", F.round("score", 8))


# Line items have fewer than 10 distinct taxes but more distinct discounts.
REPORT_SQL = f"""
    {SHARES_SQL}, {KS_SQL},
    numeric_counts AS (SELECT feature, value, count(*) FILTER (NOT cur) AS n_ref, count(*) FILTER (cur) AS n_cur
                       FROM long GROUP BY ALL),
    numeric_shares AS (SELECT feature, n_ref / sum(n_ref) OVER f::DOUBLE AS p, n_cur / sum(n_cur) OVER f::DOUBLE AS q
                       FROM numeric_counts WINDOW f AS (PARTITION BY feature)),
    kinds AS (SELECT feature, count(*) FILTER (n_ref > 0) < 10 AS categorical FROM numeric_counts GROUP BY feature),
    chi AS (SELECT feature, least(sum((p - q) ** 2 / (p + 1e-10)), 1) AS chi2
            FROM (SELECT * FROM shares UNION ALL SELECT * FROM numeric_shares) GROUP BY feature),
    report AS (
        SELECT feature, true AS checked, CASE WHEN categorical THEN 'chi_squared' ELSE 'ks' END AS method,
               CASE WHEN categorical THEN chi2 ELSE ks END AS score
        FROM kinds JOIN ks USING (feature) JOIN chi USING (feature)
        UNION ALL SELECT feature, true, 'chi_squared', chi2 FROM chi WHERE feature IN ('l_returnflag', 'l_linestatus'))"""


def drift_dataset(spark: SparkSession, folder: str) -> DataFrame:
    """Dataset drift, where the current side also lacks a reference feature."""
    reference, current = _sides(spark, folder)
    summary = drift_summary(feature_drift(reference, current.drop("l_tax"), NUMERIC + TEXT))
    return summary.select(
        "dataset_drift",
        "num_drifted_features",
        "num_checked",
        F.round("drift_percentage", 6).alias("drift_percentage"),
        F.concat_ws(",", "drifted_features").alias("drifted_features"),
    )


DATASET_SQL = f"""
    WITH {REPORT_SQL}
    SELECT bool_or(score > 0.1) AS dataset_drift, count(*) FILTER (score > 0.1) AS num_drifted_features,
           count(*) AS num_checked, round(count(*) FILTER (score > 0.1) / 6.0::DOUBLE * 100, 6) AS drift_percentage,
           string_agg(feature, ',' ORDER BY feature) FILTER (score > 0.1) AS drifted_features
    FROM report WHERE feature <> 'l_tax'"""


def drift_detailed(spark: SparkSession, folder: str) -> DataFrame:
    report = detailed_report(*_sides(spark, folder), NUMERIC + TEXT)
    return report.select(
        "feature",
        "method",
        F.round("score", 8).alias("score"),
        "drifted",
        *[F.round(f"{side}_{c}", 4).alias(f"{side}_{c}") for side in ("ref", "cur") for c in ("mean", "std")],
        "ref_unique_count",
        "cur_unique_count",
    )


DETAILED_SQL = f"""
    WITH {REPORT_SQL},
    stats AS (SELECT feature, avg(value) FILTER (NOT cur) AS ref_mean, avg(value) FILTER (cur) AS cur_mean,
                     stddev_samp(value) FILTER (NOT cur) AS ref_std, stddev_samp(value) FILTER (cur) AS cur_std,
                     count(DISTINCT value) FILTER (NOT cur) AS ref_unique_count,
                     count(DISTINCT value) FILTER (cur) AS cur_unique_count FROM long GROUP BY feature
              UNION ALL SELECT feature, NULL, NULL, NULL, NULL, count(*) FILTER (n_ref > 0), count(*) FILTER (n_cur > 0)
              FROM counts GROUP BY feature)
    SELECT feature, method, round(score, 8) AS score, score > 0.1 AS drifted, round(ref_mean, 4) AS ref_mean,
           round(ref_std, 4) AS ref_std, round(cur_mean, 4) AS cur_mean, round(cur_std, 4) AS cur_std,
           ref_unique_count, cur_unique_count
    FROM report JOIN stats USING (feature)"""


def retraining(spark: SparkSession, folder: str) -> DataFrame:
    reference, current = _sides(spark, folder)
    summary = drift_summary(feature_drift(reference, current, NUMERIC + TEXT))
    requests = retraining_requests(summary, "eta-prediction", F.lit("2024-02-01").cast("timestamp"))
    return requests.select("model_name", "num_drifted_features", F.round("drift_percentage", 6).alias("drift_percentage"))


RETRAINING_SQL = f"""
    WITH {REPORT_SQL}
    SELECT 'eta-prediction' AS model_name, count(*) FILTER (score > 0.1) AS num_drifted_features,
           round(count(*) FILTER (score > 0.1) / count(*)::DOUBLE * 100, 6) AS drift_percentage
    FROM report HAVING bool_or(score > 0.1)"""


def prediction_drift_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder)
    early = F.col("ts") < F.lit("2024-01-16").cast("timestamp")
    found = prediction_drift(rows.where(early), rows.where(~early), "value", "eta")
    rounded = ["drift_score", "p_value", "reference_mean", "current_mean", "reference_std", "current_std"]
    return found.select("model_name", "drift_detected", *[F.round(c, 6).alias(c) for c in rounded])


PREDICTION_SQL = """
    WITH s AS (SELECT value, ts >= TIMESTAMP '2024-01-16' AS cur FROM events),
    n AS (SELECT count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS b, avg(value) FILTER (NOT cur) AS ma,
                 avg(value) FILTER (cur) AS mb, stddev_pop(value) FILTER (NOT cur) AS sa,
                 stddev_pop(value) FILTER (cur) AS sb FROM s),
    cdf AS (SELECT sum((NOT cur)::INT) OVER (ORDER BY value) AS r, sum(cur::INT) OVER (ORDER BY value) AS c FROM s),
    d AS (SELECT max(abs(r / a::DOUBLE - c / b::DOUBLE)) AS ks FROM cdf, n),
    p AS (SELECT 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * ks * ks * (a * b / (a + b)::DOUBLE))) AS p
          FROM d, n, generate_series(1, 100) g(k))
    SELECT 'eta' AS model_name, ks > 0.15 AS drift_detected, round(ks, 6) AS drift_score,
           round(greatest(0, least(1, p)), 6) AS p_value, round(ma, 6) AS reference_mean, round(mb, 6) AS current_mean,
           round(sa, 6) AS reference_std, round(sb, 6) AS current_std
    FROM d, n, p"""

# Every column of events and orders, split in the middle of their times.
COLUMNS = {
    "events": ("ts", "2024-01-16", {"event_id": "n", "ts": "t", "user_id": "n", "event_type": "s", "value": "n", "props": "s"}),
    "orders": (
        "o_orderdate",
        "1998-01-01",
        {"o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "s", "o_totalprice": "n", "o_orderdate": "t", "o_orderpriority": "s"},
    ),
}


def drift_all_columns(spark: SparkSession, folder: str) -> DataFrame:
    """All columns of two tables, ids and times included, by default."""
    reports = []
    for name, (ts, middle, _) in COLUMNS.items():
        rows = table(spark, folder, name)
        early = F.col(ts) < F.lit(middle).cast("timestamp_ntz")
        reports.append(feature_drift(rows.where(early), rows.where(~early)))
    return reports[0].unionByName(reports[1]).withColumn("score", F.round("score", 8))


def _column_sql(name: str, ts: str, middle: str, column: str, kind: str) -> str:
    value = {"n": f"{column}::DOUBLE", "t": f"epoch_us({column})::DOUBLE", "s": "NULL::DOUBLE"}[kind]
    text = f"{column}::VARCHAR" if kind == "s" else "NULL::VARCHAR"
    return f"SELECT '{column}' AS feature, {value} AS value, {text} AS word, {ts} >= TIMESTAMP '{middle}' AS cur FROM {name}"


ALL_COLUMNS_SQL = f"""
    WITH long AS (SELECT * FROM ({" UNION ALL ".join(
        _column_sql(name, ts, middle, column, kind)
        for name, (ts, middle, columns) in COLUMNS.items() for column, kind in columns.items()
    )}) WHERE value IS NOT NULL OR word IS NOT NULL),
    n AS (SELECT feature, bool_or(word IS NOT NULL) AS is_text, count(*) FILTER (NOT cur) AS a, count(*) FILTER (cur) AS b FROM long GROUP BY feature),
    counts AS (SELECT feature, value, word, count(*) FILTER (NOT cur) AS r, count(*) FILTER (cur) AS c FROM long GROUP BY ALL),
    cdf AS (SELECT feature, sum(r) OVER w AS r, sum(c) OVER w AS c FROM counts WINDOW w AS (PARTITION BY feature ORDER BY value)),
    ks AS (SELECT feature, max(abs(r / a::DOUBLE - c / b::DOUBLE)) AS ks FROM cdf JOIN n USING (feature) WHERE a > 0 AND b > 0 GROUP BY feature),
    chi AS (SELECT feature, least(sum((r / a::DOUBLE - c / b::DOUBLE) ** 2 / (r / a::DOUBLE + 1e-10)), 1) AS chi2, count(*) FILTER (r > 0) AS different
            FROM counts JOIN n USING (feature) GROUP BY feature),
    report AS (SELECT feature, CASE WHEN is_text OR different < 10 THEN 'chi_squared' ELSE 'ks' END AS method,
                      CASE WHEN is_text OR different < 10 THEN chi2 ELSE ks END AS score
               FROM n JOIN chi USING (feature) LEFT JOIN ks USING (feature))
    SELECT feature, true AS checked, method, round(coalesce(score, 0), 8) AS score, coalesce(score, 0) > 0.1 AS drifted FROM report"""


def prediction_drift_no_reference(spark: SparkSession, folder: str) -> DataFrame:
    """One row each, of one schema: no reference table, one without rows, and no current rows."""
    rows = events(spark, folder)
    none = rows.where("event_id < 0")
    found = [
        prediction_drift(None, rows, "value", "no table"),
        prediction_drift(none, rows, "value", "no rows"),
        prediction_drift(rows, none, "value", "no current"),
    ]
    rounded = ["drift_score", "p_value", "reference_mean", "current_mean", "reference_std", "current_std"]
    return found[0].unionByName(found[1]).unionByName(found[2]).select(
        "model_name", "drift_detected", "message", *[F.round(c, 6).alias(c) for c in rounded]
    )


NO_REFERENCE_SQL = """
    WITH m AS (SELECT round(avg(value), 6) AS m, round(stddev_pop(value), 6) AS s FROM events),
    r AS (SELECT 'no table' AS model_name, 'No reference data' AS message, NULL::DOUBLE AS reference_mean, m AS current_mean,
                 NULL::DOUBLE AS reference_std, s AS current_std FROM m
          UNION ALL SELECT 'no rows', 'No reference data', NULL, m, NULL, s FROM m
          UNION ALL SELECT 'no current', 'No current data', m, NULL, s, NULL FROM m)
    SELECT *, false AS drift_detected, NULL::DOUBLE AS drift_score, NULL::DOUBLE AS p_value FROM r"""

def prediction_drift_small(spark: SparkSession, folder: str) -> DataFrame:
    """Mornings against afternoons of each day: samples small enough for the exact p-value."""
    rows = events(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd").alias("feature"),
        F.when(F.hour("ts") < 12, F.col("value")).otherwise(F.col("value") * 1.2).alias("value"),
        (F.hour("ts") < 12).alias("early"),
    )
    counts = rows.groupBy("feature", "value").agg(F.count_if("early").alias("n_ref"), F.count_if(~F.col("early")).alias("n_cur"))
    found = D.ks_statistic(counts)
    exact = D.ks_exact_p_value(F.col("ks"), F.col("ref_rows"), F.col("cur_rows"))
    return found.select(F.col("feature").alias("day"), "ref_rows", "cur_rows", F.round("ks", 8).alias("ks"), F.round(exact, 8).alias("p_value"))


PREDICTION_SMALL_SQL = """
    WITH RECURSIVE e AS (SELECT strftime(ts, '%Y-%m-%d') AS day, hour(ts) < 12 AS early,
                                CASE WHEN hour(ts) < 12 THEN value ELSE value * 1.2::DOUBLE END AS value FROM events),
    size AS (SELECT day, count(*) FILTER (early) AS n, count(*) FILTER (NOT early) AS m FROM e GROUP BY day),
    cdf AS (SELECT day, sum(early::INT) OVER w AS r, sum((NOT early)::INT) OVER w AS c FROM e WINDOW w AS (PARTITION BY day ORDER BY value)),
    d AS (SELECT day, n, m, max(abs(r * m - c * n))::BIGINT AS h FROM cdf JOIN size USING (day) WHERE n > 0 AND m > 0 GROUP BY ALL),
    walk AS (
        SELECT day, n, m, h, 0::BIGINT AS s, 0::BIGINT AS i, 1::DOUBLE AS p FROM d WHERE n * m <= 1000000
        UNION ALL
        SELECT day, n, m, h, s + 1, i + step, sum(p * CASE step WHEN 1 THEN n - i ELSE m - (s - i) END / (n + m - s)::DOUBLE)
        FROM walk, (SELECT unnest([0, 1]) AS step)
        WHERE s < n + m AND i + step <= n AND s + 1 - i - step <= m AND abs((i + step) * m - (s + 1 - i - step) * n) < h
        GROUP BY day, n, m, h, s, i + step),
    inside AS (SELECT day, p FROM walk WHERE s = n + m),
    x AS (SELECT *, h / (n * m)::DOUBLE AS ks FROM d),
    series AS (SELECT day, 2 * sum((-1) ** (k - 1) * exp(-2 * k * k * ks * ks * (n * m / (n + m)::DOUBLE))) AS q FROM x, generate_series(1, 100) g(k) GROUP BY day)
    SELECT day, n AS ref_rows, m AS cur_rows, round(ks, 8) AS ks,
           round(CASE WHEN n * m > 1000000 THEN greatest(0, least(1, q)) ELSE greatest(0, 1 - coalesce(p, 0)) END, 8) AS p_value
    FROM x LEFT JOIN inside USING (day) JOIN series USING (day)"""

SKETCHED = ["value", "user_id", "k"]
CHANGE = "2024-01-21"


def _measured(spark: SparkSession, folder: str) -> DataFrame:
    """Events with three numbers, of which one rises and one is missing now and then."""
    rows = events(spark, folder)
    later = F.col("ts") >= F.lit(CHANGE).cast("timestamp")
    return rows.select(
        "ts",
        later.alias("later"),
        F.when(later, F.col("value") * 1.5).otherwise(F.col("value")).alias("value"),
        F.when(F.col("event_type") != "error", F.col("user_id")).alias("user_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def _sketch_table(spark: SparkSession, folder: str) -> str:
    """A table of daily sketches, of which the last days are written again."""
    root = shared_dir(spark, "sketches")
    made = sketches.daily_sketches(_measured(spark, folder), "ts", SKETCHED)
    sketches.write_sketches(made, root)
    sketches.write_sketches(made.where(F.col("ds") >= F.lit("2024-01-29").cast("date")), root)
    return root


def _day(text: str) -> Column:
    return F.lit(text).cast("date")


def drift_from_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """Drift of two windows of days from sketches; the exact statistic of the rows, and whether it is within the error stated."""
    root = _sketch_table(spark, folder)
    reference = sketches.window(spark, root, _day("2024-01-01"), _day("2024-01-20"))
    current = sketches.window(spark, root, _day(CHANGE), _day("2024-12-31"))
    found = sketches.sketched_drift(reference, current)
    rows = _measured(spark, folder)
    counts = D.side_counts(rows.where("NOT later"), rows.where("later"), SKETCHED)
    exact = D.ks_statistic(counts).select("feature", F.col("ks").alias("exact"))
    return found.join(exact, "feature").select(
        "feature", "ref_rows", "cur_rows", F.round("exact", 8).alias("exact"),
        (F.abs(F.col("ks") - F.col("exact")) <= F.col("ks_error")).alias("within_error"), (F.col("ks_error") < 0.02).alias("small_error"), "drift",
    )


DRIFT_FROM_SKETCHES_SQL = f"""
    WITH m AS (SELECT ts >= TIMESTAMP '{CHANGE}' AS cur, value * CASE WHEN ts >= TIMESTAMP '{CHANGE}' THEN 1.5::DOUBLE ELSE 1 END AS value,
                      CASE WHEN event_type <> 'error' THEN user_id END AS user_id, (props->>'$.k')::INT AS k FROM events),
    long AS (SELECT 'value' AS feature, value, cur FROM m UNION ALL SELECT 'user_id', user_id, cur FROM m WHERE user_id IS NOT NULL
             UNION ALL SELECT 'k', k, cur FROM m WHERE k IS NOT NULL),
    n AS (SELECT feature, count(*) FILTER (NOT cur) AS ref_rows, count(*) FILTER (cur) AS cur_rows FROM long GROUP BY feature),
    cdf AS (SELECT feature, sum((NOT cur)::INT) OVER w AS r, sum(cur::INT) OVER w AS c FROM long
            WINDOW w AS (PARTITION BY feature ORDER BY value)),
    ks AS (SELECT feature, any_value(ref_rows) AS ref_rows, any_value(cur_rows) AS cur_rows,
                  max(abs(r / ref_rows::DOUBLE - c / cur_rows::DOUBLE)) AS ks FROM cdf JOIN n USING (feature) GROUP BY feature)
    SELECT feature, ref_rows, cur_rows, round(ks, 8) AS exact, true AS within_error, true AS small_error,
           CASE WHEN ks > 0.1 THEN 'yes' ELSE 'no' END AS drift FROM ks"""


def profile_from_sketches(spark: SparkSession, folder: str) -> DataFrame:
    """A profile of ten days from sketches; quartiles and distinct counts are compared with those of the rows."""
    root = _sketch_table(spark, folder)
    found = sketches.sketched_profile(sketches.window(spark, root, _day("2024-01-15"), _day("2024-01-24")))
    rows = _measured(spark, folder).where(F.to_date("ts").between(_day("2024-01-15"), _day("2024-01-24")))
    values = D.long_form(rows, SKETCHED, False).where(F.col("value").isNotNull())
    at = F.array(*[F.struct((F.col("value") < F.col("quantiles")[i]).alias("below"), (F.col("value") <= F.col("quantiles")[i]).alias("upto")) for i in range(3)])
    ranks = values.join(F.broadcast(found), "feature").withColumn("at", at)
    near = F.lit(True)
    for i, p in enumerate((0.25, 0.5, 0.75)):
        near &= (F.avg(F.col("at")[i]["below"].cast("int")) - F.first("rank_error") <= p) & (F.avg(F.col("at")[i]["upto"].cast("int")) + F.first("rank_error") >= p)
    checked = ranks.groupBy("feature").agg(near.alias("quartiles_within_error"), F.count_distinct("value").alias("unique_count"))
    distinct = F.abs(F.col("estimate") - F.col("unique_count")) <= F.col("unique_error") * F.col("unique_count")
    return found.withColumnRenamed("unique_count", "estimate").join(checked, "feature").select(
        "feature", "rows", F.round("missing_pct", 6).alias("missing_pct"), F.round("mean", 6).alias("mean"), "min", "max", "unique_count",
        distinct.alias("unique_within_error"), "quartiles_within_error",
    )


PROFILE_FROM_SKETCHES_SQL = f"""
    WITH m AS (SELECT value * CASE WHEN ts >= TIMESTAMP '{CHANGE}' THEN 1.5::DOUBLE ELSE 1 END AS value,
                      CASE WHEN event_type <> 'error' THEN user_id END AS user_id, (props->>'$.k')::INT AS k FROM events
               WHERE ts::DATE BETWEEN DATE '2024-01-15' AND DATE '2024-01-24'),
    long AS (SELECT 'value' AS feature, value FROM m UNION ALL SELECT 'user_id', user_id FROM m UNION ALL SELECT 'k', k FROM m)
    SELECT feature, count(value) AS rows, round(100 * (count(*) - count(value)) / count(*)::DOUBLE, 6) AS missing_pct, round(avg(value), 6) AS mean,
           min(value)::DOUBLE AS min, max(value)::DOUBLE AS max, count(DISTINCT value) AS unique_count, true AS unique_within_error, true AS quartiles_within_error
    FROM long GROUP BY feature"""


QUERIES = {
    "prediction_drift_small": prediction_drift_small,
    "drift_from_sketches": drift_from_sketches,
    "profile_from_sketches": profile_from_sketches,
    "drift_all_columns": drift_all_columns,
    "prediction_drift_no_reference": prediction_drift_no_reference,
    "drift_ks": drift_ks,
    "drift_chi2": drift_chi2,
    "drift_psi": drift_psi,
    "drift_js": drift_js,
    "exact_quantiles": quantiles,
    "drift_report": drift_report,
    "drift_dataset": drift_dataset,
    "drift_detailed": drift_detailed,
    "retraining_requests": retraining,
    "prediction_drift": prediction_drift_query,
}

ORACLE = {
    "prediction_drift_small": PREDICTION_SMALL_SQL,
    "drift_from_sketches": DRIFT_FROM_SKETCHES_SQL,
    "profile_from_sketches": PROFILE_FROM_SKETCHES_SQL,
    "drift_all_columns": ALL_COLUMNS_SQL,
    "prediction_drift_no_reference": NO_REFERENCE_SQL,
    "drift_ks": f"WITH {KS_SQL} SELECT feature, round(ks, 8) AS ks, ref_rows, cur_rows FROM ks",
    "drift_chi2": f"""
        WITH {SHARES_SQL}
        SELECT feature, round(least(sum((p - q) ** 2 / (p + 1e-10)), 1), 8) AS chi2 FROM shares GROUP BY feature""",
    "drift_psi": PSI_SQL,
    "drift_js": JS_SQL,
    "exact_quantiles": QUANTILES_SQL,
    "drift_report": f"""
        WITH {REPORT_SQL}
        SELECT feature, checked, method, round(score, 8) AS score, score > 0.1 AS drifted FROM report""",
    "drift_dataset": DATASET_SQL,
    "drift_detailed": DETAILED_SQL,
    "retraining_requests": RETRAINING_SQL,
    "prediction_drift": PREDICTION_SQL,
}
