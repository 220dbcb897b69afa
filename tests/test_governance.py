from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluation as V
from tidemark.operators import governance as G
from tidemark.operators import monitoring as M
from tidemark.operators import quality as Q

T0 = datetime(2024, 1, 1)
DAY = timedelta(days=1)


def test_approvals(spark):
    log = [(i, e, T0 + DAY * n, n, u) for i, e, n, u in [
        ("twice", "requested", 0, "ann"), ("twice", "approved", 1, "bob"), ("twice", "approved", 2, "cy"),
        ("after", "requested", 0, "ann"), ("after", "approved", 1, "bob"), ("after", "rejected", 2, "cy"),
        ("late", "requested", 0, "ann"), ("late", "rejected", 1, "bob"), ("late", "approved", 2, "cy"),
        ("open", "requested", 0, "ann"), ("gone", "requested", 0, "ann"), ("gone", "approved", 1, "bob"),
        ("gone", "revoked", 2, "cy"), ("unknown", "approved", 1, "bob"),
    ]]
    df = spark.createDataFrame(log, "approval_id string, event string, ts timestamp, seq int, user_id string").withColumns(
        {c: F.lit("x") for c in ("comments", "model_name", "model_version", "stage")}
    )
    got = {r.approval_id: (r.status, r.approved_by) for r in G.approval_state(df).collect()}
    assert got == {"twice": ("approved", "bob"), "after": ("rejected", "cy"), "late": ("rejected", "bob"),
                   "open": ("pending", None), "gone": ("revoked", "bob")}
    assert G.by_id(df, "approval_id", "nobody").count() == 0


def test_stages(spark):
    log = [("m", "1", "Production", 0, False), ("m", "2", "Production", 1, False), ("m", "3", "Production", 2, True),
           ("m", "4", "Staging", 0, False), ("m", "5", "Production", 3, False), ("n", "1", "Production", 1, True)]
    df = spark.createDataFrame(
        [(m, v, s, T0 + DAY * n, n, a) for m, v, s, n, a in log],
        "model_name string, version string, stage string, ts timestamp, seq int, archive_existing boolean",
    )
    state = G.stage_state(df)
    assert {(r.model_name, r.version): r.stage for r in state.collect()} == {
        ("m", "1"): "Archived", ("m", "2"): "Archived", ("m", "3"): "Production", ("m", "4"): "Staging",
        ("m", "5"): "Production", ("n", "1"): "Production"}
    assert {r.model_name: r.version for r in G.in_production(state).collect()} == {"m": "5", "n": "1"}


def runs(spark):
    rows = [("r1", "a", T0, {"accuracy": 0.9, "loss": 0.1}), ("r2", "b", T0, {"accuracy": 0.95}),
            ("r3", "c", T0, {"accuracy": 0.95, "loss": float("nan")})]
    return spark.createDataFrame(rows, "run_id string, run_name string, start_time timestamp, metrics map<string,double>")


def test_runs(spark):
    df = runs(spark)
    assert G.best_run(df, "accuracy").first().run_id == "r2"
    assert G.best_run(df, "accuracy", ascending=True).first().run_id == "r1"
    assert G.best_run(df, "loss").first().run_id == "r1"
    by = G.best_run(df.withColumn("e", F.lit(1)), "loss", ascending=True, by=["e"]).collect()
    assert [(r.run_id, r.loss) for r in by] == [("r1", 0.1)]
    assert G.best_run(df.limit(0), "loss").count() == 0
    table = {r.run_id: (r.accuracy, r.loss) for r in G.compare_runs(df, ["accuracy", "loss"], ["r1", "r2"]).collect()}
    assert table == {"r1": (0.9, 0.1), "r2": (0.95, None)}
    assert {r.metric for r in G.metric_names(df).collect()} == {"accuracy", "loss"}


def audit(spark):
    rows = spark.createDataFrame([(i, f"u{i % 2}", f"m{i % 3}", T0 + DAY * i) for i in range(6)], "i int, u string, m string, t timestamp")
    return rows.select(*G.audit_event(F.lit("deploy"), F.col("t"), F.col("u"), F.lit("go"), F.col("m"), details={"i": F.col("i")}))


def test_audit(spark):
    logs = audit(spark)
    assert [r.details["i"] for r in G.audit_trail(logs).collect()] == ["5", "4", "3", "2", "1", "0"]
    some = G.audit_trail(logs, user_id="u0", start=T0 + DAY, end=T0 + 4 * DAY).collect()
    assert [r.details["i"] for r in some] == ["4", "2"]
    assert {r.log_id for r in logs.collect()} == {r.log_id for r in audit(spark).collect()}
    models = spark.createDataFrame([("m0", None), ("m9", None)], "model_name string, model_version string")
    assert [r.model_name for r in G.unaudited(models, logs, ["model_name"]).collect()] == ["m9"]
    bare = spark.range(1).select(*G.audit_event(F.lit("e"), F.lit(T0), F.lit("u"), F.lit("a"))).first()
    assert bare.details == {} and bare.model_name is None


def test_lineage_and_retention(spark):
    rows = spark.range(1).select(
        *G.lineage_record(F.lit(T0), F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.create_map(F.lit("s"), F.lit("t"))),
                          F.lit("m"), F.lit("1"), F.lit("d"))
    )
    assert rows.first().data_retention_date == T0 + 90 * DAY
    assert G.expired(rows, "data_retention_date", F.lit(T0 + 90 * DAY)).count() == 1
    assert G.unexpired(rows, "data_retention_date", F.lit(T0 + 90 * DAY)).count() == 0
    assert {(r.data_source, r.models) for r in G.lineage_impact(rows).collect()} == {("a", 1), ("b", 1)}


def test_versions_and_tags(spark):
    rows = spark.createDataFrame([("m", T0 + DAY, "b"), ("m", T0, "a"), ("n", T0, "c")], "model_name string, ts timestamp, id string")
    numbered = G.number_versions(rows, "ts", ["id"])
    assert {(r.id, r.version) for r in numbered.collect()} == {("a", 1), ("b", 2), ("c", 1)}
    tagged = G.tagged(G.tagged(rows, {"x": F.lit("1"), "y": F.lit("2")}), {"x": F.lit("3")})
    assert tagged.first().tags == {"x": "3", "y": "2"}


def test_compliance(spark):
    texts = spark.createDataFrame(
        [("mail a.b@c.org and x@y.co.uk now",), ("call 555-123-4567",), ("id 123-45-6789 at 10.0.0.1",), ("none",)], "text string"
    )
    row = G.personal_data_counts(texts, "text").first()
    assert (row.texts, row.texts_with_personal_data, row.email, row.phone, row.ssn, row.ipv4) == (4, 3, 2, 1, 1, 1)
    kinds = spark.createDataFrame([("a",), ("a",), ("b",)], "kind string")
    row = G.compliance_result(kinds, "gdpr", "ann", F.lit(T0)).first()
    assert (row.status, row.remediation_required, row.findings) == ("non_compliant", True, {"a": 2, "b": 1})
    row = G.compliance_result(kinds.limit(0), "gdpr", "ann", F.lit(T0)).first()
    assert (row.status, row.remediation_required, row.findings) == ("compliant", False, {})


def test_bias_and_fairness(spark):
    rows = [("a", 1, 1), ("a", 0, 1), ("a", 1, 1), ("a", 0, 0), ("b", 1, 1), ("b", 1, 0), ("b", 0, 0), ("b", 0, 0)]
    df = spark.createDataFrame(rows, "g string, y int, p int")
    rates = V.group_rates(df, "g", F.col("y"), F.col("p"))
    row = V.bias_scores(rates).first()
    assert (row.demographic_parity_score, row.equal_opportunity_score, row.bias_detected) == (pytest.approx(1 / 3), 0.5, True)
    gaps = {r.protected_group: r.positive_rate_gap for r in V.fairness_gaps(rates).collect()}
    assert gaps == {"a": 0.0, "b": 0.5}
    assert {r.fairness_score for r in V.fairness_gaps(rates).collect()} == {0.5}


def test_a_group_without_positive_labels_shows_no_bias(spark):
    rows = [("a", 1, 1), ("a", 0, 0), ("b", 0, 1), ("b", 0, 0)]
    rates = V.group_rates(spark.createDataFrame(rows, "g string, y int, p int"), "g", F.col("y"), F.col("p"))
    assert {r.protected_group: r.true_positive_rate for r in rates.collect()} == {"a": 1.0, "b": None}
    row = V.bias_scores(rates).first()
    assert (row.demographic_parity_score, row.equal_opportunity_score, row.bias_detected) == (1.0, 1.0, False)
    gaps = {r.protected_group: (r.true_positive_rate_gap, r.fairness_score) for r in V.fairness_gaps(rates).collect()}
    assert gaps == {"a": (0.0, 1.0), "b": (None, 1.0)}
    empty = V.bias_scores(rates.limit(0)).first()
    assert (empty.demographic_parity_score, empty.bias_detected) == (None, False)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (0.0, 1.0), (None, 5.0), (4.0, None)], "y double, p double")
    row = V.regression_metrics(df, "y", "p").first()
    assert (row.rows, row.mae, row.rmse) == (3, pytest.approx(2 / 3), pytest.approx((2 / 3) ** 0.5))
    assert row.r2 == pytest.approx(0.0) and row.mape == pytest.approx(50.0)
    assert V.passes_gate(V.regression_metrics(df, "y", "p")).count() == 1
    assert V.passes_gate(V.regression_metrics(df, "y", "p"), max_mae=0.5).count() == 0


def test_monitoring(spark):
    rows = [("eta", T0, 100.0, "success"), ("eta", T0 + timedelta(minutes=4), 2000.0, "success"), ("eta", T0 + timedelta(minutes=6), 50.0, "error")]
    log = spark.createDataFrame(rows, "model_name string, ts timestamp, latency_ms double, status string")
    windows = {r.window_start: (r.requests, r.error_rate, r.healthy) for r in M.health_windows(log).collect()}
    assert windows == {T0: (2, 0.0, False), T0 + timedelta(minutes=5): (1, 1.0, False)}
    buckets = {r.le: r.n for r in M.latency_histogram(log, [50, 1000]).collect()}
    assert buckets == {50.0: 1, 1000.0: 2, None: 3}
    assert {(r.status, r.n) for r in M.prediction_counts(log).collect()} == {("success", 2), ("error", 1)}
    ids = spark.range(2000)
    arms = {p: {r.id for r in ids.where(M.canary_arm(F.col("id"), p) == "canary").collect()} for p in M.CANARY_STEPS}
    assert arms[10] < arms[25] < arms[50] < arms[100] and len(arms[100]) == 2000


def test_expectations(spark):
    df = spark.createDataFrame([(1, 4.5, "F"), (None, 9.0, "X"), (3, None, None)], "k int, rating double, s string")
    report = Q.evaluate(df, [Q.row_count(5), Q.not_null("k"), Q.between("rating", 1, 5), Q.allowed("s", ["F"]),
                             Q.rule("small", F.col("k") < 3, "k")])
    assert {(r.expectation, r.column): (r.rows, r.failed, r.success) for r in report.collect()} == {
        ("row_count", None): (3, 2, False), ("not_null", "k"): (3, 1, False), ("between", "rating"): (3, 1, False),
        ("allowed", "s"): (3, 1, False), ("small", "k"): (3, 2, False)}
    with pytest.raises(Q.QualityError, match="row_count"):
        Q.require(report)
    Q.require(Q.evaluate(df, [Q.row_count()]))
    empty = Q.evaluate(df.limit(0), [Q.row_count(), Q.not_null("k")]).collect()
    assert [r.success for r in empty] == [False, True]


def test_orphans_and_coordinates(spark):
    child = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    parent = spark.createDataFrame([(1,)], "id int")
    assert [r.k for r in Q.orphans(child, "k", parent, "id").collect()] == [2]
    points = spark.createDataFrame([(0.0, 0.0), (90.0, 180.0), (90.1, 0.0), (0.0, -181.0), (None, 0.0)], "a double, b double")
    got = [r.v for r in points.select(Q.valid_coordinates(F.col("a"), F.col("b")).alias("v")).collect()]
    assert got == [True, True, False, False, False]


def test_promotion_and_rollback(spark):
    passed = spark.createDataFrame([("m", "3")], "model_name string, version string")
    log = spark.createDataFrame(
        [("m", "1", "Production", T0, 0, False), ("m", "2", "Production", T0 + DAY, 0, False)],
        "model_name string, version string, stage string, ts timestamp, seq bigint, archive_existing boolean",
    )
    assert [r.version for r in G.previous_production(log).collect()] == ["1"]
    log = log.unionByName(G.promotion_events(passed, F.lit(T0 + 2 * DAY)))
    assert {r.version: r.stage for r in G.stage_state(log).collect()} == {"1": "Archived", "2": "Archived", "3": "Production"}
    assert [r.version for r in G.previous_production(log).collect()] == ["2"]


def test_approval_events_and_all_metrics(spark):
    ids = spark.createDataFrame([("a1", T0)], "i string, t timestamp")
    ask = ids.select(*G.approval_event("requested", F.col("i"), F.col("t"), F.lit("ann"), model_name=F.lit("m"), stage=F.lit("production")))
    yes = ids.select(*G.approval_event("approved", F.col("i"), F.col("t") + F.lit(DAY), F.lit("bob"), F.lit("fine")))
    row = G.approval_state(ask.unionByName(yes)).first()
    assert (row.status, row.approved_by, row.comments, row.model_name, row.stage) == ("approved", "bob", "fine", "m", "production")
    with pytest.raises(ValueError):
        G.approval_event("shipped", F.lit("i"), F.lit(T0), F.lit("u"))
    assert G.compare_runs(runs(spark)).columns == ["run_id", "run_name", "start_time", "accuracy", "loss"]


def test_latency_percentiles(spark):
    log = spark.createDataFrame([("a", float(x)) for x in range(101)] + [("b", 7.0), ("b", None), ("c", None)], "model_name string, latency_ms double")
    got = {r.model_name: (r.p50, r.p95, r.p99) for r in M.latency_percentiles(log).collect()}
    assert got == {"a": (50.0, 95.0, 99.0), "b": (7.0, 7.0, 7.0)}
    rows = M.latency_histogram(log, [50], percents=[25]).collect()
    assert {(r.model_name, r.le, r.n, r.p25) for r in rows} == {
        ("a", 50.0, 51, 25.0), ("a", None, 101, 25.0), ("b", 50.0, 1, 7.0), ("b", None, 1, 7.0), ("c", 50.0, 0, None), ("c", None, 0, None)
    }


def test_rollout_decisions(spark):
    """Steps of an hour; each model's requests by key, all of which are in the canary's arm at the last step."""
    start = datetime(2024, 1, 1)

    def decide(rows, hours, **limits):
        log = spark.createDataFrame(
            [("m", i, start + timedelta(minutes=t), status, latency) for i, (t, status, latency) in enumerate(rows)],
            "model_name string, key long, ts timestamp, status string, latency_ms double",
        )
        now = F.lit(start + timedelta(hours=hours))
        found = M.rollout_decision(log, "key", F.lit(start), timedelta(hours=1), now, steps=(100, 100, 100), min_requests=2, **limits).first()
        return (found.decision, found.step, found.traffic, found.reason)

    well = [(t, "success", 10.0) for t in range(0, 180, 10)]
    assert decide(well, 0.5) == ("advance", 100, 100, "waiting")
    assert decide(well, 1) == ("advance", 100, 100, "healthy")
    assert decide(well, 3) == ("promote", 100, 100, "healthy")
    assert decide(well[:7], 3) == ("hold", 100, 100, "too few requests")
    assert decide(well[:1], 3) == ("hold", 100, 0, "too few requests")
    failing = [(t, "error" if t >= 60 else s, x) for t, s, x in well]
    assert decide(failing, 1) == ("advance", 100, 100, "healthy") and decide(failing, 3) == ("roll_back", 100, 0, "errors")
    assert decide(well, 3, max_latency_ms=5.0) == ("roll_back", 100, 0, "latency")
    # What is served before the start and after the last step says nothing, and later steps do not mend an earlier one.
    assert decide([(-5, "error", 1.0), (500, "error", 1.0), *well], 9) == ("promote", 100, 100, "healthy")
    assert decide([(t, "error" if t < 60 else s, x) for t, s, x in well], 3) == ("roll_back", 100, 0, "errors")
