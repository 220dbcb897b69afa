"""Runs, approvals, stages, audit, lineage and compliance over tables in those roles."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import features_hash
from ..operators import governance as G
from ..operators.evaluation import bias_scores, fairness_gaps, group_rates
from ..operators.monitoring import metric_map
from .tables import SQL_TIME, events, table, text_day, text_time


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as runs: the customer is the experiment; urgent runs lack a metric."""
    orders = table(spark, folder, "orders").withColumns(
        {"loss": F.col("o_totalprice"), "accuracy": F.col("o_totalprice") / 1e6}
    )
    all_metrics = metric_map(["loss", "accuracy"])
    metrics = F.when(F.col("o_orderpriority") == "1-URGENT", F.map_filter(all_metrics, lambda k, _: k != "loss"))
    return orders.select(
        F.col("o_custkey").alias("experiment"),
        F.col("o_orderkey").cast("string").alias("run_id"),
        F.col("o_orderpriority").alias("run_name"),
        F.col("o_orderdate").cast("timestamp").alias("start_time"),
        metrics.otherwise(all_metrics).alias("metrics"),
    )


def best_run(spark: SparkSession, folder: str) -> DataFrame:
    """The best run of each experiment by least loss, and over all by greatest accuracy."""
    runs = _runs(spark, folder)
    least = G.best_run(runs, "loss", ascending=True, by=["experiment"])
    most = G.best_run(runs, "accuracy")
    return least.select("experiment", "run_id", F.col("loss").alias("value"), F.lit("loss").alias("metric")).unionByName(
        most.select("experiment", "run_id", F.col("accuracy").alias("value"), F.lit("accuracy").alias("metric"))
    )


BEST_RUN_SQL = """
    WITH r AS (SELECT o_custkey AS experiment, o_orderkey::VARCHAR AS run_id,
                      CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS loss,
                      o_totalprice / 1e6 AS accuracy FROM orders)
    SELECT experiment, run_id, loss AS value, 'loss' AS metric FROM r
    QUALIFY row_number() OVER (PARTITION BY experiment ORDER BY loss NULLS LAST, run_id) = 1
    UNION ALL
    (SELECT experiment, run_id, accuracy, 'accuracy' FROM r ORDER BY accuracy DESC, run_id LIMIT 1)"""


def compare_runs(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.compare_runs(_runs(spark, folder))
    return rows.withColumn("start_time", text_time("start_time"))


COMPARE_SQL = f"""
    SELECT o_orderkey::VARCHAR AS run_id, o_orderpriority AS run_name, strftime(o_orderdate, {SQL_TIME}) AS start_time,
           o_totalprice / 1e6 AS accuracy, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS loss
    FROM orders"""


def _approval_log(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as decisions: a customer is a request, its orders are what happened to it."""
    priority = F.col("o_orderpriority")
    event = (
        F.when(priority == "1-URGENT", "rejected")
        .when(priority.isin("2-HIGH", "3-MEDIUM"), "approved")
        .otherwise("requested")
    )
    return table(spark, folder, "orders").select(
        F.col("o_custkey").alias("approval_id"),
        event.alias("event"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        F.concat(F.lit("user"), F.col("o_orderkey") % 7).alias("user_id"),
        F.col("o_orderstatus").alias("comments"),
        F.concat(F.lit("model"), F.col("o_custkey") % 11).alias("model_name"),
        (F.col("o_custkey") % 5).cast("string").alias("model_version"),
        F.lit("production").alias("stage"),
    )


def _shown_approval(rows: DataFrame) -> DataFrame:
    return rows.select(
        "approval_id",
        "model_name",
        "model_version",
        "status",
        "requested_by",
        text_time("requested_at").alias("requested_at"),
        "approved_by",
        text_time("approved_at").alias("approved_at"),
        "comments",
    )


def approval_state(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_approval(G.approval_state(_approval_log(spark, folder)))


def approval_lookup(spark: SparkSession, folder: str) -> DataFrame:
    return _shown_approval(G.by_id(G.approval_state(_approval_log(spark, folder)), "approval_id", 77))


APPROVAL_SQL = f"""
    WITH log AS (
        SELECT o_custkey AS approval_id, o_orderdate AS ts, o_orderkey AS seq, 'user' || (o_orderkey % 7) AS user_id,
               o_orderstatus AS comments,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'rejected' WHEN '2-HIGH' THEN 'approved'
                    WHEN '3-MEDIUM' THEN 'approved' ELSE 'requested' END AS event FROM orders),
    req AS (SELECT * FROM log WHERE event = 'requested'
            QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY ts, seq) = 1),
    dec AS (SELECT * FROM log WHERE event <> 'requested'
            QUALIFY row_number() OVER (PARTITION BY approval_id ORDER BY (event = 'rejected') DESC,
                CASE WHEN event = 'rejected' THEN -epoch_us(ts) ELSE epoch_us(ts) END,
                CASE WHEN event = 'rejected' THEN -seq ELSE seq END) = 1)
    SELECT req.approval_id, 'model' || (req.approval_id % 11) AS model_name, (req.approval_id % 5)::VARCHAR AS model_version,
           coalesce(dec.event, 'pending') AS status, req.user_id AS requested_by,
           strftime(req.ts, {SQL_TIME}) AS requested_at, dec.user_id AS approved_by,
           strftime(dec.ts, {SQL_TIME}) AS approved_at, dec.comments
    FROM req LEFT JOIN dec USING (approval_id)"""


def _stage_log(spark: SparkSession, folder: str) -> DataFrame:
    status = F.col("o_orderstatus")
    return table(spark, folder, "orders").select(
        (F.col("o_custkey") % 97).alias("model_name"),
        (F.col("o_orderkey") % 13).alias("version"),
        F.when(status == "F", "Staging").when(status == "O", "Production").otherwise("None").alias("stage"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderkey").alias("seq"),
        (F.col("o_orderpriority") == "1-URGENT").alias("archive_existing"),
    )


def stage_state(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.stage_state(_stage_log(spark, folder))
    return rows.withColumn("transitioned_at", text_time("transitioned_at"))


STAGE_SQL = """
    log AS (
        SELECT o_custkey % 97 AS model_name, o_orderkey % 13 AS version, o_orderdate AS ts, o_orderkey AS seq,
               CASE o_orderstatus WHEN 'F' THEN 'Staging' WHEN 'O' THEN 'Production' ELSE 'None' END AS stage,
               o_orderpriority = '1-URGENT' AS archive_existing FROM orders),
    cur AS (SELECT * FROM log
            QUALIFY row_number() OVER (PARTITION BY model_name, version ORDER BY ts DESC, seq DESC) = 1),
    state AS (
        SELECT model_name, version, ts, seq,
               CASE WHEN EXISTS (SELECT 1 FROM log a WHERE a.model_name = cur.model_name AND a.stage = cur.stage
                                 AND a.archive_existing AND a.version <> cur.version
                                 AND (a.ts > cur.ts OR (a.ts = cur.ts AND a.seq > cur.seq)))
                    THEN 'Archived' ELSE stage END AS stage
        FROM cur)"""


def production_versions(spark: SparkSession, folder: str) -> DataFrame:
    rows = G.in_production(G.stage_state(_stage_log(spark, folder)))
    return rows.withColumn("transitioned_at", text_time("transitioned_at"))


def rollback_versions(spark: SparkSession, folder: str) -> DataFrame:
    return G.previous_production(_stage_log(spark, folder))


ROLLBACK_SQL = f"""
    WITH {STAGE_SQL},
    p AS (SELECT model_name, version, max((ts, seq)) AS entered FROM log WHERE stage = 'Production' GROUP BY ALL)
    SELECT model_name, version FROM p QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY entered DESC) = 2"""


def audit_of_kinds(spark: SparkSession, folder: str) -> DataFrame:
    """Training, deployment, access and prediction events from the events of four types."""
    rows = events(spark, folder)
    model, version = F.concat(F.lit("model"), F.col("user_id") % 3), F.lit("1")
    user, item = F.concat(F.lit("user"), F.col("user_id")), F.col("event_id").cast("string")
    parts = {
        "signup": G.training_start_event(F.col("ts"), model, version, item, user),
        "purchase": G.deployment_event(F.col("ts"), model, version, F.lit("production"), user, item),
        "view": G.data_access_event(F.col("ts"), item, user, F.lit("read"), F.lit("training")),
        "click": G.prediction_event(F.col("ts"), model, version, item, features_hash(["value", "event_type"]), user),
    }
    logs = reduce(
        DataFrame.unionByName, [rows.where(F.col("event_type") == kind).select(*cs) for kind, cs in parts.items()]
    )
    return logs.select(
        "event_type",
        "user_id",
        "model_name",
        "action",
        F.coalesce(*[F.col("details")[k] for k in ("dataset_id", "approval_id", "request_id")]).alias("item"),
        F.col("details")["features_hash"].alias("features_hash"),
    )


AUDIT_KINDS_SQL = """
    SELECT CASE event_type WHEN 'signup' THEN 'model_training_start' WHEN 'purchase' THEN 'model_deployment'
                WHEN 'view' THEN 'data_access' ELSE 'prediction_request' END AS event_type,
           'user' || user_id AS user_id, CASE WHEN event_type <> 'view' THEN 'model' || (user_id % 3) END AS model_name,
           CASE event_type WHEN 'signup' THEN 'train_model' WHEN 'purchase' THEN 'deploy_model' WHEN 'view' THEN 'read'
                ELSE 'predict' END AS action, event_id::VARCHAR AS item,
           CASE WHEN event_type = 'click'
                THEN sha256(concat_ws(chr(31), 'event_type', event_type, 'value', value::VARCHAR)) END AS features_hash
    FROM events WHERE event_type <> 'error'"""


def model_versions(spark: SparkSession, folder: str) -> DataFrame:
    registered = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 97).alias("model_name"),
        F.col("o_orderkey").alias("run_id"),
        F.col("o_orderdate").cast("timestamp").alias("registered_at"),
        F.create_map(F.lit("team"), F.col("o_orderstatus"), F.lit("tier"), F.lit("none")).alias("tags"),
        "o_orderpriority",
    )
    numbered = G.number_versions(registered, "registered_at", ["run_id"])
    tagged = G.tagged(numbered, {"tier": F.col("o_orderpriority"), "run": F.col("run_id")})
    return tagged.select(
        "model_name", "run_id", "version", *[F.col("tags")[t].alias(t) for t in ("team", "tier", "run")]
    )


MODEL_VERSIONS_SQL = """
    SELECT o_custkey % 97 AS model_name, o_orderkey AS run_id,
           row_number() OVER (PARTITION BY o_custkey % 97 ORDER BY o_orderdate, o_orderkey) AS version,
           o_orderstatus AS team, o_orderpriority AS tier, o_orderkey::VARCHAR AS run
    FROM orders"""


def _audit_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Events as audit rows."""
    return events(spark, folder).select(
        *G.audit_event(
            event_type=F.concat(F.lit("model_"), "event_type"),
            ts=F.col("ts"),
            user_id=F.concat(F.lit("user"), F.col("user_id") % 10),
            action=F.col("event_type"),
            model_name=F.concat(F.lit("model"), F.col("user_id") % 3),
            details={"event_id": F.col("event_id"), "stage": F.lit("production")},
            log_id=F.col("event_id"),
        )
    )


def _shown_audit(rows: DataFrame) -> DataFrame:
    return rows.select(
        "log_id",
        text_time("timestamp").alias("timestamp"),
        "event_type",
        "user_id",
        "model_name",
        "action",
        F.col("details")["event_id"].alias("event_id"),
        F.col("details")["stage"].alias("stage"),
    )


AUDIT_SQL = f"""
    SELECT event_id::VARCHAR AS log_id, strftime(ts, {SQL_TIME}) AS timestamp, 'model_' || event_type AS event_type,
           'user' || (user_id % 10) AS user_id, 'model' || (user_id % 3) AS model_name, event_type AS action,
           event_id::VARCHAR AS event_id, 'production' AS stage
    FROM events"""


def audit_trail(spark: SparkSession, folder: str) -> DataFrame:
    trail = G.audit_trail(
        _audit_logs(spark, folder), model_name="model1", start=datetime(2024, 1, 5), end=datetime(2024, 1, 25)
    )
    return _shown_audit(trail)


def audit_counts(spark: SparkSession, folder: str) -> DataFrame:
    return G.audit_counts(_audit_logs(spark, folder)).withColumn("day", text_day("day"))


def audit_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """All audit rows, with the id that a replay would give them again."""
    rows = _audit_logs(spark, folder)
    again = F.sha2(F.concat_ws("\x1f", "log_id", "event_type", "action"), 256)
    return _shown_audit(rows).withColumn("replay_id", again)


def _lineage(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as datasets that models were trained on."""
    trained = F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(days=F.length("text") % 120)
    return table(spark, folder, "documents").select(
        *G.lineage_record(
            training_date=trained,
            data_sources=F.array("source", "lang"),
            transformations=F.array(F.create_map(F.lit("step"), F.lit("tokenize"))),
            model_name=F.concat(F.lit("model-"), "lang"),
            model_version=F.lit("1"),
            dataset_id=F.col("doc_id").cast("string"),
        )
    )


def lineage_retention(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets whose retention ended before May."""
    rows = G.expired(_lineage(spark, folder), "data_retention_date", F.lit("2024-05-01").cast("timestamp"))
    return rows.select(
        "dataset_id",
        "model_name",
        text_time("training_date").alias("training_date"),
        text_time("data_retention_date").alias("data_retention_date"),
    )


LINEAGE_SQL = f"""
    WITH d AS (SELECT *, TIMESTAMP '2024-01-01' + to_days((length(text) % 120)::INT) AS trained FROM documents)
    SELECT doc_id::VARCHAR AS dataset_id, 'model-' || lang AS model_name, strftime(trained, {SQL_TIME}) AS training_date,
           strftime(trained + INTERVAL 90 DAYS, {SQL_TIME}) AS data_retention_date
    FROM d WHERE trained + INTERVAL 90 DAYS <= TIMESTAMP '2024-05-01'"""


def expired_rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = events(spark, folder).withColumn("expires_at", F.col("ts") + F.expr("INTERVAL 24 HOURS"))
    return G.expired(rows, "expires_at", F.lit("2024-01-20").cast("timestamp")).select("event_id", "user_id")


def compliance_gdpr(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in whole texts, by language."""
    return G.personal_data_counts(table(spark, folder, "documents"), "text", ["lang"])


def _pattern_counts_sql() -> str:
    return ", ".join(
        f"sum(len(regexp_extract_all(text, '{pattern}')))::BIGINT AS {name}" for name, pattern in G.PERSONAL_DATA.items()
    )


GDPR_SQL = f"""
    SELECT lang, count(*) AS texts, count(*) FILTER ({' OR '.join(
        f"regexp_matches(text, '{p}')" for p in G.PERSONAL_DATA.values())}) AS texts_with_personal_data,
           {_pattern_counts_sql()}
    FROM documents GROUP BY lang"""


def compliance_soc2(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as models: those that no event mentions have no audit record."""
    models = table(spark, folder, "customer").select(F.col("c_custkey").alias("model_name"), "c_mktsegment")
    logs = events(spark, folder).select(F.col("user_id").alias("model_name"))
    return G.unaudited(models, logs, ["model_name"])


def compliance_result(spark: SparkSession, folder: str) -> DataFrame:
    """One result per check: personal data and retention, unaudited models, and a check that finds nothing."""
    texts = G.with_personal_data_counts(table(spark, folder, "documents").select("text"), "text")
    unaudited = compliance_soc2(spark, folder).select(F.lit("unaudited").alias("kind"))
    gdpr = texts.where("has_personal_data").select(F.lit("personal_data").alias("kind")).unionByName(
        lineage_retention(spark, folder).select(F.lit("retention").alias("kind"))
    )
    logs = events(spark, folder).select(F.col("user_id").alias("model_name"))
    logged = G.unaudited(logs.distinct(), logs, ["model_name"]).select(F.lit("unaudited").alias("kind"))
    at = F.lit("2024-05-01").cast("timestamp")
    rows = [G.compliance_result(kinds, check, "auditor", at) for check, kinds in (("gdpr", gdpr), ("soc2", unaudited), ("logged", logged))]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select(
        "check_type",
        "status",
        "remediation_required",
        "violations",
        *[F.coalesce(F.try_element_at("findings", F.lit(k)), F.lit(0)).alias(k) for k in ("personal_data", "retention", "unaudited")],
        "checked_by",
    )


RESULT_SQL = f"""
    WITH u AS (SELECT nullif(count(*), 0) AS unaudited FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)),
    r AS (SELECT nullif(count(*), 0) AS retention FROM documents
          WHERE TIMESTAMP '2024-01-01' + to_days((length(text) % 120)::INT) + INTERVAL 90 DAYS <= TIMESTAMP '2024-05-01'),
    p AS (SELECT nullif(count(*), 0) AS personal_data FROM documents
          WHERE {' OR '.join(f"regexp_matches(text, '{x}')" for x in G.PERSONAL_DATA.values())}),
    c AS (SELECT 'gdpr' AS check_type, personal_data, retention, NULL::BIGINT AS unaudited FROM p, r
          UNION ALL SELECT 'soc2', NULL, NULL, unaudited FROM u
          UNION ALL SELECT 'logged', NULL, NULL, (SELECT nullif(count(*), 0) FROM (SELECT user_id FROM events EXCEPT SELECT user_id FROM events))),
    v AS (SELECT *, (coalesce(personal_data, 0) + coalesce(retention, 0) + coalesce(unaudited, 0))::BIGINT AS violations FROM c)
    SELECT check_type, CASE WHEN violations > 0 THEN 'non_compliant' ELSE 'compliant' END AS status,
           violations > 0 AS remediation_required, violations, coalesce(personal_data, 0) AS personal_data,
           coalesce(retention, 0) AS retention, coalesce(unaudited, 0) AS unaudited, 'auditor' AS checked_by
    FROM v"""


def _rates(spark: SparkSession, folder: str) -> DataFrame:
    """Languages and, as a group of their own, texts of poor quality; a long text is predicted to be of quality.

    The group of poor texts has no positive label.
    """
    labelled = table(spark, folder, "documents").select("doc_id", "lang", "n_chars").join(
        table(spark, folder, "labels"), "doc_id"
    )
    poor = labelled.where("quality = 0").withColumn("lang", F.lit("poor"))
    return group_rates(labelled.unionByName(poor), "lang", F.col("quality") == 1, F.col("n_chars") > 1000)


RATES_SQL = """
    g AS (SELECT lang, (quality = 1) AS y, (n_chars > 1000) AS p FROM documents JOIN labels USING (doc_id)
          UNION ALL SELECT 'poor', false, (n_chars > 1000) FROM documents JOIN labels USING (doc_id) WHERE quality = 0),
    rates AS (SELECT lang AS protected_group, count(*) AS n, count(*) FILTER (p) / count(*)::DOUBLE AS positive_rate,
                     count(*) FILTER (p AND y) / nullif(count(*) FILTER (y), 0)::DOUBLE AS true_positive_rate,
                     count(*) FILTER (p AND NOT y) / nullif(count(*) FILTER (NOT y), 0)::DOUBLE AS false_positive_rate
              FROM g GROUP BY lang)"""


def compliance_bias(spark: SparkSession, folder: str) -> DataFrame:
    scores = bias_scores(_rates(spark, folder))
    return scores.select(
        F.round("demographic_parity_score", 8).alias("demographic_parity_score"),
        F.round("equal_opportunity_score", 8).alias("equal_opportunity_score"),
        "bias_detected",
    )


BIAS_SQL = f"""
    WITH {RATES_SQL}
    SELECT round(min(positive_rate) / max(positive_rate), 8) AS demographic_parity_score,
           round(min(true_positive_rate) / max(true_positive_rate), 8) AS equal_opportunity_score,
           least(min(positive_rate) / max(positive_rate), min(true_positive_rate) / max(true_positive_rate)) < 0.8
               AS bias_detected
    FROM rates"""


def compliance_fairness(spark: SparkSession, folder: str) -> DataFrame:
    gaps = fairness_gaps(_rates(spark, folder))
    rates = [
        "positive_rate", "true_positive_rate", "false_positive_rate", "positive_rate_gap", "true_positive_rate_gap", "fairness_score",
    ]
    return gaps.select("protected_group", F.col("rows").alias("n"), *[F.round(c, 8).alias(c) for c in rates])


FAIRNESS_SQL = f"""
    WITH {RATES_SQL}
    SELECT protected_group, n, round(positive_rate, 8) AS positive_rate, round(true_positive_rate, 8) AS true_positive_rate,
           round(false_positive_rate, 8) AS false_positive_rate,
           round(max(positive_rate) OVER () - positive_rate, 8) AS positive_rate_gap,
           round(max(true_positive_rate) OVER () - true_positive_rate, 8) AS true_positive_rate_gap,
           round(1 - (SELECT greatest(max(positive_rate) - min(positive_rate), max(true_positive_rate) - min(true_positive_rate)) FROM rates), 8)
               AS fairness_score
    FROM rates"""

QUERIES = {
    "best_run": best_run,
    "compare_runs": compare_runs,
    "approval_state": approval_state,
    "approval_lookup": approval_lookup,
    "stage_state": stage_state,
    "production_versions": production_versions,
    "rollback_versions": rollback_versions,
    "model_versions": model_versions,
    "audit_trail": audit_trail,
    "audit_counts": audit_counts,
    "audit_from_events": audit_from_events,
    "audit_of_kinds": audit_of_kinds,
    "lineage_retention": lineage_retention,
    "lineage_impact": lambda spark, folder: G.lineage_impact(_lineage(spark, folder)),
    "expired_rows": expired_rows,
    "compliance_gdpr": compliance_gdpr,
    "compliance_soc2": compliance_soc2,
    "compliance_result": compliance_result,
    "compliance_bias": compliance_bias,
    "compliance_fairness": compliance_fairness,
}

ORACLE = {
    "best_run": BEST_RUN_SQL,
    "compare_runs": COMPARE_SQL,
    "approval_state": APPROVAL_SQL,
    "approval_lookup": f"{APPROVAL_SQL} WHERE approval_id = 77",
    "stage_state": f"""
        WITH {STAGE_SQL}
        SELECT model_name, version, stage, strftime(ts, {SQL_TIME}) AS transitioned_at, seq FROM state""",
    "production_versions": f"""
        WITH {STAGE_SQL}
        SELECT model_name, version, strftime(ts, {SQL_TIME}) AS transitioned_at FROM state WHERE stage = 'Production'
        QUALIFY row_number() OVER (PARTITION BY model_name ORDER BY ts DESC, seq DESC) = 1""",
    "rollback_versions": ROLLBACK_SQL,
    "model_versions": MODEL_VERSIONS_SQL,
    "audit_trail": f"""
        {AUDIT_SQL} WHERE user_id % 3 = 1 AND ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25'
        ORDER BY events.ts DESC, log_id""",
    "audit_counts": """
        SELECT 'model_' || event_type AS event_type, 'user' || (user_id % 10) AS user_id,
               strftime(ts, '%Y-%m-%d') AS day, count(*) AS n
        FROM events GROUP BY 1, 2, 3""",
    "audit_from_events": f"""
        SELECT *, sha256(concat_ws(chr(31), log_id, event_type, action)) AS replay_id FROM ({AUDIT_SQL})""",
    "audit_of_kinds": AUDIT_KINDS_SQL,
    "lineage_retention": LINEAGE_SQL,
    "lineage_impact": """
        SELECT data_source, count(DISTINCT lang) AS models, count(DISTINCT doc_id) AS datasets
        FROM (SELECT source AS data_source, lang, doc_id FROM documents UNION ALL SELECT lang, lang, doc_id FROM documents)
        GROUP BY data_source""",
    "expired_rows": """
        SELECT event_id, user_id FROM events WHERE ts + INTERVAL 24 HOURS <= TIMESTAMP '2024-01-20'""",
    "compliance_gdpr": GDPR_SQL,
    "compliance_soc2": """
        SELECT c_custkey AS model_name, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM events)""",
    "compliance_result": RESULT_SQL,
    "compliance_bias": BIAS_SQL,
    "compliance_fairness": FAIRNESS_SQL,
}
