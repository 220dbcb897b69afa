"""Governance tables: approvals, model stages, audit trail, lineage, retention, compliance.

State is folded from append-only event logs by aggregates, which combine before
the shuffle, so a model or an approval with very many events is no special case.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ids import record_id
from .timeline import HotKeys, row_numbers

RETENTION_DAYS = 90

# What is searched for as personal data. Patterns are plain enough
# to mean the same in every regular-expression engine.
MOST_COLUMNS = 1000
PERSONAL_DATA = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "phone": r"[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ipv4": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}",
}


def where_given(df: DataFrame, *conditions: Column | None) -> DataFrame:
    """Rows meeting every condition that is given."""
    present = [c for c in conditions if c is not None]
    return df.where(reduce(lambda a, b: a & b, present)) if present else df


# Approvals


def approval_state(log: DataFrame) -> DataFrame:
    """Current state of each approval from a log of ``requested/approved/rejected/revoked``.

    Log columns: approval_id, event, ts, seq, user_id, comments, model_name,
    model_version, stage. The first approval of a pending request counts and
    later ones do not. A rejection always counts, the last one is shown, and it
    cannot be approved away. A revocation ends an approval.
    """
    order = F.struct("ts", "seq")
    who = F.struct("ts", "seq", "user_id", "comments")

    def on(event: str, value: Column) -> Column:
        return F.when(F.col("event") == event, value)

    folded = log.groupBy("approval_id").agg(
        F.min_by(F.struct("model_name", "model_version", "stage", "user_id", "ts"), on("requested", order)).alias("r"),
        F.min(on("approved", who)).alias("a"),
        F.max(on("rejected", who)).alias("x"),
        F.max(on("revoked", who)).alias("v"),
    )
    revoked = F.col("a").isNotNull() & (F.col("v.ts") >= F.col("a.ts"))
    status = (
        F.when(F.col("x").isNotNull(), "rejected")
        .when(revoked, "revoked")
        .when(F.col("a").isNotNull(), "approved")
        .otherwise("pending")
    )
    decided = F.coalesce("x", "a")
    return (
        folded.where(F.col("r").isNotNull())
        .withColumns({"__d": decided, "status": status})
        .select(
            "approval_id",
            "r.model_name",
            "r.model_version",
            "r.stage",
            F.col("r.user_id").alias("requested_by"),
            F.col("r.ts").alias("requested_at"),
            "status",
            F.col("__d.user_id").alias("approved_by"),
            F.col("__d.ts").alias("approved_at"),
            F.col("__d.comments").alias("comments"),
        )
    )


def approval_event(
    event: str,
    approval_id: Column,
    ts: Column,
    user_id: Column,
    comments: Column | None = None,
    model_name: Column | None = None,
    model_version: Column | None = None,
    stage: Column | None = None,
    seq: Column | None = None,
) -> list[Column]:
    """The columns of a row of the approval log; a decision need not repeat the model.

    ``seq`` orders events of one time.
    """
    if event not in ("requested", "approved", "rejected", "revoked"):
        raise ValueError(f"unknown approval event: {event}")
    nothing = F.lit(None).cast("string")
    texts = {"comments": comments, "model_name": model_name, "model_version": model_version, "stage": stage}
    return [
        approval_id.alias("approval_id"),
        F.lit(event).alias("event"),
        ts.alias("ts"),
        (F.lit(0) if seq is None else seq).cast("bigint").alias("seq"),
        user_id.alias("user_id"),
        *[(nothing if c is None else c).alias(name) for name, c in texts.items()],
    ]


def by_id(df: DataFrame, column: str, value: object) -> DataFrame:
    """The row of an id: a filter that reaches the scan, and one row at most."""
    return df.where(F.col(column) == value).limit(1)


# Model stages


def stage_state(log: DataFrame) -> DataFrame:
    """Current stage of each (model, version) from a log of transitions.

    Log columns: model_name, version, stage, ts, seq, archive_existing. A
    transition that archives existing versions moves every other version that
    was in the same stage before it to Archived.
    """
    order = F.struct("ts", "seq")
    current = log.groupBy("model_name", "version").agg(
        F.max_by(F.struct("stage", "ts", "seq"), order).alias("now")
    )
    archiving = log.where("archive_existing").groupBy("model_name", "stage")
    last = archiving.agg(F.max(F.struct("ts", "seq", "version")).alias("by"))
    archived = (F.struct("now.ts", "now.seq") < F.struct("by.ts", "by.seq")) & (F.col("version") != F.col("by.version"))
    return (
        current.withColumn("stage", F.col("now.stage"))
        .join(last, ["model_name", "stage"], "left")
        .select(
            "model_name",
            "version",
            F.when(archived, "Archived").otherwise(F.col("stage")).alias("stage"),
            F.col("now.ts").alias("transitioned_at"),
            F.col("now.seq").alias("seq"),
        )
    )


def promotion_events(
    passed: DataFrame, ts: Column, stage: str = "Production", archive_existing: bool = True
) -> DataFrame:
    """Stage-log rows that promote the (model_name, version) of each given row."""
    return passed.select(
        "model_name",
        "version",
        F.lit(stage).alias("stage"),
        ts.alias("ts"),
        F.lit(0).cast("bigint").alias("seq"),
        F.lit(archive_existing).alias("archive_existing"),
    )


def previous_production(log: DataFrame) -> DataFrame:
    """The version of each model to roll back to: in Production before the current one."""
    entered = (
        log.where(F.col("stage") == "Production")
        .groupBy("model_name", "version")
        .agg(F.max(F.struct("ts", "seq")).alias("at"))
    )
    last = entered.groupBy("model_name").agg(F.max(F.struct("at", "version")).alias("last"))
    earlier = entered.join(last, "model_name").where(F.struct("at", "version") < F.col("last"))
    return earlier.groupBy("model_name").agg(F.max_by("version", F.struct("at", "version")).alias("version"))


def in_production(state: DataFrame) -> DataFrame:
    """The version of each model that reached Production last."""
    live = state.where(F.col("stage") == "Production")
    return live.groupBy("model_name").agg(
        F.max_by("version", F.struct("transitioned_at", "seq")).alias("version"),
        F.max("transitioned_at").alias("transitioned_at"),
    )


def number_versions(
    registrations: DataFrame, ts: str, tie: Sequence[str], hot: HotKeys | None = None
) -> DataFrame:
    """Number each model's registrations from 1 by time."""
    return row_numbers(registrations, ["model_name"], ts, tie, "version", hot)


def tagged(df: DataFrame, tags: Mapping[str, Column], column: str = "tags") -> DataFrame:
    """Set tags in a map column; existing tags of the same name are replaced."""
    added = F.map_from_arrays(
        F.array(*[F.lit(name) for name in tags]), F.array(*[value.cast("string") for value in tags.values()])
    )
    if column not in df.columns:
        return df.withColumn(column, added)
    kept = F.map_filter(
        F.coalesce(F.col(column), F.create_map().cast("map<string,string>")), lambda name, _: ~name.isin(*tags)
    )
    return df.withColumn(column, F.map_concat(kept, added))


# Runs


def best_run(runs: DataFrame, metric: str, ascending: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """The run with the best value of a metric, over all or per ``by``; ties by run id.

    Runs without the metric come last, as does NaN.
    """
    value = F.nullif(F.try_element_at("metrics", F.lit(metric)), F.lit(float("nan")))
    ranked = runs.withColumn("__value", value)
    if not by:
        order = F.col("__value").asc_nulls_last() if ascending else F.col("__value").desc_nulls_last()
        return ranked.orderBy(order, "run_id").limit(1).withColumnRenamed("__value", metric)
    key = F.col("__value") if ascending else -F.col("__value")
    row = F.struct(*runs.columns, "__value")
    best = F.min_by(row, F.struct(F.col("__value").isNull(), key, F.col("run_id")))
    return (
        ranked.groupBy(*by)
        .agg(best.alias("__best"))
        .select("__best.*")
        .withColumnRenamed("__value", metric)
    )


def compare_runs(
    runs: DataFrame, metrics: Sequence[str] | None = None, run_ids: Sequence[str] | None = None
) -> DataFrame:
    """One row per run with a column per metric; a metric the run lacks is null.

    Without ``metrics`` the names in use among the runs become the columns, which
    takes a pass of its own. More than ``MOST_COLUMNS`` of them are refused: name
    the ones to compare.
    """
    chosen = runs if run_ids is None else runs.where(F.col("run_id").isin(*run_ids))
    if metrics is None:
        found = metric_names(chosen).limit(MOST_COLUMNS + 1).collect()
        if len(found) > MOST_COLUMNS:
            raise ValueError(f"the runs have more than {MOST_COLUMNS} metrics; name the ones to compare")
        metrics = sorted(row["metric"] for row in found)
    return chosen.select(
        "run_id",
        "run_name",
        "start_time",
        *[F.try_element_at("metrics", F.lit(m)).alias(m) for m in metrics],
    )


def metric_names(runs: DataFrame) -> DataFrame:
    """The distinct metric names in use, for :func:`compare_runs`."""
    return runs.select(F.explode(F.map_keys("metrics")).alias("metric")).distinct()


# Audit


def audit_event(
    event_type: Column,
    ts: Column,
    user_id: Column,
    action: Column,
    model_name: Column | None = None,
    model_version: Column | None = None,
    details: Mapping[str, Column] | None = None,
    ip_address: Column | None = None,
    user_agent: Column | None = None,
    log_id: Column | None = None,
) -> list[Column]:
    """The columns of an audit row; what is not given is null.

    Without ``log_id`` the id is a hash of the row, so appending a batch again
    yields the same ids.
    """
    nothing = F.lit(None).cast("string")
    pairs = details or {}
    values = F.map_from_arrays(
        F.array(*[F.lit(name) for name in pairs]).cast("array<string>"),
        F.array(*[value.cast("string") for value in pairs.values()]).cast("array<string>"),
    )
    parts = {
        "timestamp": ts,
        "event_type": event_type,
        "user_id": user_id,
        "model_name": nothing if model_name is None else model_name,
        "model_version": nothing if model_version is None else model_version,
        "action": action,
    }
    if log_id is None:
        log_id = record_id(*parts.values(), F.to_json(values))
    return [
        log_id.cast("string").alias("log_id"),
        *[(v if k == "timestamp" else v.cast("string")).alias(k) for k, v in parts.items()],
        values.alias("details"),
        (nothing if ip_address is None else ip_address).alias("ip_address"),
        (nothing if user_agent is None else user_agent).alias("user_agent"),
    ]


def training_start_event(
    ts: Column, model_name: Column, model_version: Column, dataset_id: Column, user_id: Column, **more: Column
) -> list[Column]:
    details = {"dataset_id": dataset_id, **more}
    kind, action = F.lit("model_training_start"), F.lit("train_model")
    return audit_event(kind, ts, user_id, action, model_name, model_version, details)


def deployment_event(
    ts: Column,
    model_name: Column,
    model_version: Column,
    environment: Column,
    deployed_by: Column,
    approval_id: Column | None = None,
    **more: Column,
) -> list[Column]:
    details = {"environment": environment, **more}
    if approval_id is not None:
        details["approval_id"] = approval_id
    kind, action = F.lit("model_deployment"), F.lit("deploy_model")
    return audit_event(kind, ts, deployed_by, action, model_name, model_version, details)


def data_access_event(
    ts: Column, dataset_id: Column, user_id: Column, access_type: Column, purpose: Column, **more: Column
) -> list[Column]:
    details = {"dataset_id": dataset_id, "purpose": purpose, **more}
    return audit_event(F.lit("data_access"), ts, user_id, access_type, details=details)


def prediction_event(
    ts: Column,
    model_name: Column,
    model_version: Column,
    request_id: Column,
    features_hash: Column,
    user_id: Column,
    **more: Column,
) -> list[Column]:
    details = {"request_id": request_id, "features_hash": features_hash, **more}
    return audit_event(F.lit("prediction_request"), ts, user_id, F.lit("predict"), model_name, model_version, details)


def audit_trail(
    logs: DataFrame,
    model_name: str | None = None,
    user_id: str | None = None,
    start: object | None = None,
    end: object | None = None,
) -> DataFrame:
    """Audit rows meeting the given filters, newest first; both time bounds are included."""
    found = where_given(
        logs,
        None if model_name is None else F.col("model_name") == model_name,
        None if user_id is None else F.col("user_id") == user_id,
        None if start is None else F.col("timestamp") >= F.lit(start),
        None if end is None else F.col("timestamp") <= F.lit(end),
    )
    return found.select("log_id", "timestamp", "event_type", "user_id", "model_name", "action", "details").orderBy(
        F.desc("timestamp"), "log_id"
    )


def audit_counts(logs: DataFrame) -> DataFrame:
    return logs.groupBy("event_type", "user_id", F.to_date("timestamp").alias("day")).agg(
        F.count(F.lit(1)).alias("n")
    )


# Lineage and retention


def lineage_record(
    training_date: Column,
    data_sources: Column,
    transformations: Column,
    model_name: Column,
    model_version: Column,
    dataset_id: Column,
    retention_days: int = RETENTION_DAYS,
) -> list[Column]:
    return [
        record_id(model_name, model_version, dataset_id, training_date).alias("lineage_id"),
        model_name.alias("model_name"),
        model_version.alias("model_version"),
        dataset_id.alias("dataset_id"),
        training_date.alias("training_date"),
        data_sources.alias("data_sources"),
        transformations.alias("transformations"),
        (training_date + F.lit(timedelta(days=retention_days))).alias("data_retention_date"),
    ]


def lineage_impact(lineage: DataFrame) -> DataFrame:
    """Per data source: how many models and datasets were built from it."""
    return (
        lineage.select("model_name", "dataset_id", F.explode(F.array_distinct("data_sources")).alias("data_source"))
        .groupBy("data_source")
        .agg(F.count_distinct("model_name").alias("models"), F.count_distinct("dataset_id").alias("datasets"))
    )


def expired(df: DataFrame, column: str, now: Column) -> DataFrame:
    """Rows whose time to live or retention has ended at ``now``."""
    return df.where(F.col(column) <= now)


def unexpired(df: DataFrame, column: str, now: Column) -> DataFrame:
    return df.where(F.col(column).isNull() | (F.col(column) > now))


# Compliance


def personal_data_counts(df: DataFrame, text: str, by: Sequence[str] = ()) -> DataFrame:
    """Occurrences of each kind of personal data in whole texts, and texts holding any."""
    return with_personal_data_counts(df, text).groupBy(*by).agg(
        F.count(F.lit(1)).alias("texts"),
        F.count_if("has_personal_data").alias("texts_with_personal_data"),
        *[F.coalesce(F.sum(name), F.lit(0)).cast("bigint").alias(name) for name in PERSONAL_DATA],
    )


def with_personal_data_counts(df: DataFrame, text: str) -> DataFrame:
    """Add the number of matches of each kind, and whether there is any."""
    counts = {name: F.regexp_count(F.col(text), F.lit(pattern)) for name, pattern in PERSONAL_DATA.items()}
    # Cheap tests first: no address without its sign, no number without digits.
    counts["email"] = F.when(F.col(text).contains("@"), counts["email"]).otherwise(F.lit(0))
    digits = F.col(text).rlike("[0-9][0-9][0-9][-. ][0-9]")
    for name in ("phone", "ssn"):
        counts[name] = F.when(digits, counts[name]).otherwise(F.lit(0))
    counts["ipv4"] = F.when(F.col(text).rlike(r"[0-9]\.[0-9]"), counts["ipv4"]).otherwise(F.lit(0))
    found = df.withColumns(counts)
    some = reduce(lambda a, b: a | b, [F.col(name) > 0 for name in counts])
    return found.withColumn("has_personal_data", some)


def unaudited(models: DataFrame, logs: DataFrame, keys: Sequence[str] = ("model_name", "model_version")) -> DataFrame:
    """Models with no audit record.

    The log is reduced to its distinct keys on the map side before the shuffle.
    """
    return models.join(logs.select(*keys).distinct(), list(keys), "left_anti")


def compliance_result(
    violations: DataFrame, check_type: str, checked_by: str, checked_at: Column
) -> DataFrame:
    """One compliance row from a table of violations with a ``kind`` column.

    Violations are counted by kind, so the findings stay small.
    """
    kinds = violations.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    return kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("violations"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "n")))).alias("findings"),
    ).select(
        F.lit(check_type).alias("check_type"),
        F.when(F.col("violations") > 0, "non_compliant").otherwise("compliant").alias("status"),
        (F.col("violations") > 0).alias("remediation_required"),
        "violations",
        "findings",
        F.lit(checked_by).alias("checked_by"),
        checked_at.alias("checked_at"),
    )
