import datetime as dt

from pyspark.sql import functions as F

from wardline.operators import eda, tables


def test_descriptive_and_label_stats(spark):
    df = spark.createDataFrame([(70.0, 100.0, 0), (80.0, None, 0), (None, None, 1), (90.0, None, 1)],
                               "HR double, Glucose double, SepsisLabel int")
    d = {r.channel: r for r in eda.descriptive_stats(df, ["HR", "Glucose"]).collect()}
    assert d["HR"]["count"] == 3 and d["HR"].pct_missing == 25.0 and d["HR"].mean == 80.0 and d["HR"].p50 == 80.0
    ls = {r.SepsisLabel: r for r in eda.label_group_stats(df, ["HR"], "SepsisLabel").collect()}
    assert ls[0].HR_mean == 75.0


def test_missingness(spark):
    df = spark.createDataFrame([("p1", None, None, 1.0), ("p1", 1.0, None, 1.0), ("p2", None, 1.0, 1.0), ("p2", None, 1.0, 1.0)],
                               "patient_id string, A double, B double, C double")
    m = eda.missingness(df, ["A", "B", "C"]).orderBy(F.col("pct_missing").desc()).collect()
    assert [r.channel for r in m] == ["A", "B", "C"] and m[0].pct_missing == 75.0
    pp = {r.channel: r.avg_per_patient_missing_rate for r in eda.missingness_by_entity(df, ["A"], "patient_id").collect()}
    assert pp["A"] == 0.75


def test_correlation_min_periods_and_pairs(spark):
    rows = [(float(i), 2.0 * i, -float(i)) for i in range(50)]
    df = spark.createDataFrame(rows, "A double, B double, C double")
    c = {(r.channel_a, r.channel_b): r.corr for r in eda.correlation_matrix(df, ["A", "B", "C"]).collect()}
    assert abs(c[("A", "B")] - 1.0) < 1e-12 and abs(c[("A", "C")] + 1.0) < 1e-12
    assert eda.top_pairs(eda.correlation_matrix(df, ["A", "B", "C"]), ["A", "B", "C"]).count() == 3
    few = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0)] + [(None, 1.0)] * 40, "A double, B double")
    c2 = {(r.channel_a, r.channel_b): r.corr for r in eda.correlation_matrix(few, ["A", "B"]).collect()}
    assert c2[("A", "B")] is None


def test_coverage_and_demographics(spark):
    tall = spark.createDataFrame([("p1", "HR", 80.0), ("p1", "HR", 81.0), ("p2", "HR", 90.0), ("p2", "Temp", None)],
                                 "patient_id string, channel string, value double")
    cov = {r.channel: r for r in eda.channel_coverage(tall).collect()}
    assert cov["HR"].n_readings == 3 and cov["HR"].n_patients == 2
    stays = spark.createDataFrame([(1, "a", 60.0, "F", "MICU"), (2, "a", 60.0, "F", "SICU"), (3, "b", 90.0, "M", "MICU"), (4, "c", 70.0, "F", "MICU")],
                                  "stay_id long, patient_id string, age double, sex string, unit_admitted string")
    d = {(r.metric, r.category): r.value for r in eda.demographics(stays).collect()}
    assert d[("n_patients", None)] == 3 and d[("age_mean", None)] == 70.0
    assert d[("sex_count", "F")] == 2 and d[("sex_count", "M")] == 1 and d[("unit_count", "MICU")] == 3


T0 = dt.datetime(2024, 1, 1)


def test_latest_history_and_scope(spark):
    v = spark.createDataFrame([(i, "p1", T0 + dt.timedelta(hours=i)) for i in range(5)] + [(9, "p2", T0)],
                              "id long, patient_id string, ts timestamp")
    latest = {r.patient_id: r.id for r in tables.latest_per_key(v, "patient_id", ["ts", "id"]).collect()}
    assert latest == {"p1": 4, "p2": 9}
    h = tables.history(v, "ts", "id", "patient_id", "p1", T0 + dt.timedelta(hours=1), T0 + dt.timedelta(hours=3)).collect()
    assert [r.id for r in h] == [3, 2, 1]
    pats = spark.createDataFrame([("p1", "alice"), ("p2", "bob")], "patient_id string, created_by string")
    assert [r.patient_id for r in tables.scope_to_owner(v, pats, "bob").collect()] == ["p2"]


def test_insert_patch_delete_ack(spark):
    base = spark.createDataFrame([("p1", "active", T0), ("p2", "active", T0)], "patient_id string, current_status string, updated_at timestamp")
    new = spark.createDataFrame([("p2", T0, 1), ("p3", T0, 2), ("p3", T0 + dt.timedelta(hours=1), 3)], "patient_id string, created_at timestamp, seq long")
    res = tables.insert_if_absent(new, base, "patient_id", ["created_at", "seq"])
    assert [r.patient_id for r in res.inserted.collect()] == ["p3"]
    assert sorted(r.reason for r in res.rejected.collect()) == ["duplicate key", "duplicate key in batch"]
    patch = spark.createDataFrame([("p1", ["current_status"], "discharged", T0 + dt.timedelta(days=1)),
                                   ("p2", [], "deceased", T0 + dt.timedelta(days=1)),
                                   ("p9", ["current_status"], "deceased", T0)],
                                  "patient_id string, set_fields array<string>, current_status string, ts timestamp")
    out = {r.patient_id: r for r in tables.apply_patch(base, patch, "patient_id", ["current_status"], updated_at=F.col("ts")).collect()}
    assert out["p1"].current_status == "discharged" and out["p1"].updated_at == T0 + dt.timedelta(days=1)
    assert out["p2"].current_status == "active" and out["p2"].updated_at == T0 and "p9" not in out
    assert tables.delete_by_key(base, spark.createDataFrame([("p1",)], "patient_id string"), "patient_id").count() == 1
    al = spark.createDataFrame([(1, False), (2, False)], "id long, acknowledged boolean")
    acks = spark.createDataFrame([(1, "alice", T0), (7, "bob", T0)], "id long, acknowledged_by string, acknowledged_at timestamp")
    got = {r.id: r for r in tables.acknowledge(al, acks).collect()}
    assert got[1].acknowledged and got[1].acknowledged_by == "alice" and not got[2].acknowledged


def test_rules(spark):
    df = spark.createDataFrame([("p1", "active", 0.5), ("p1", "bogus", 1.5), (None, "active", None)],
                               "patient_id string, current_status string, prob double")
    v = tables.validate(df, [tables.required("patient_id"), tables.enum("current_status", ["active", "discharged"]),
                             tables.in_range_rule("prob", 0.0, 1.0)], unique_key="patient_id").collect()
    got = sorted(tuple(sorted(r.violations)) for r in v)
    assert got == [("enum:current_status", "range:prob", "unique:patient_id"), ("required:patient_id",), ("unique:patient_id",)]


def test_cohort_pick_fixture(spark):
    labels = {"p000001": 1, "p000002": 0, "p000003": 0, "p000004": 1, "p000005": 0}
    rows = [(p, t, 1 if (lab and t == 3) else 0) for p, lab in labels.items() for t in range(1, 4)]
    df = spark.createDataFrame(rows, "patient_id string, ICULOS int, SepsisLabel int")
    got = {r.patient_id for r in eda.cohort_pick(df, "patient_id", "SepsisLabel", 2, 2, 300).collect()}
    assert {"p000001", "p000004", "p000002"} <= got and len(got) == 4


def test_patch_applies_explicit_null(spark):
    base = spark.createDataFrame([("p1", "active", 60.0)], "patient_id string, current_status string, age double")
    patch = spark.createDataFrame([("p1", ["age"], None, None)], "patient_id string, set_fields array<string>, current_status string, age double")
    r = tables.apply_patch(base, patch, "patient_id", ["current_status", "age"]).first()
    assert r.age is None and r.current_status == "active"


def test_latest_explanation_audit_rows_and_count(spark):
    preds = spark.createDataFrame([(1, "p", T0, 0.2), (2, "p", T0 + dt.timedelta(hours=1), 0.7), (3, "q", T0, 0.4)],
                                  "id long, patient_id string, created_at timestamp, sepsis_probability double")
    hist = spark.createDataFrame([(2, "p", {"HR": 0.3}), (1, "p", {"HR": -0.1})],
                                 "prediction_id long, patient_id string, shap_values map<string,double>")
    got = {r.patient_id: (r.id, r.explanation_shap_values) for r in tables.latest_with_explanation(preds, hist).collect()}
    assert got == {"p": (2, {"HR": 0.3}), "q": (3, None)}
    audit = tables.audit_rows(preds, "system", "prediction_run", "prediction", "id", {"patient_id": F.col("patient_id")}, "created_at")
    r = audit.filter("target_id = '2'").first()
    assert r.id == "prediction_run:2" and r.details == {"patient_id": "p"} and r.actor == "system"
    assert tables.row_count(preds).first().n == 3


def test_several_patches_of_a_key_act_in_order(spark):
    base = spark.createDataFrame([("p", "active", 50, 0), ("q", "active", 60, 0)], "patient_id string, current_status string, age int, updated_at int")
    patch = spark.createDataFrame([("p", ["current_status"], "left", None, 1), ("p", ["current_status", "age"], "back", None, 2),
                                   ("p", ["age"], "ignored", 51, 3)],
                                  "patient_id string, set_fields array<string>, current_status string, age int, ts int")
    out = {r.patient_id: tuple(r) for r in tables.apply_patch(base, patch, "patient_id", ["current_status", "age"],
                                                               updated_at=F.col("ts"), order=["ts"]).collect()}
    assert out == {"p": ("p", "back", 51, 3), "q": ("q", "active", 60, 0)}


def test_acknowledgement_audit(spark):
    alerts = spark.createDataFrame([(1,), (2,)], "id long")
    acks = spark.createDataFrame([(1, "nurse", 10), (1, "doctor", 5), (9, "x", 1)], "id long, acknowledged_by string, acknowledged_at int")
    rows = tables.acknowledge_audit(alerts, acks).collect()
    assert [(r.actor, r.target_id, r.action) for r in rows] == [("doctor", "1", "alert_acknowledged")]
    assert [r.id for r in tables.unmatched(acks, alerts, "id").collect()] == [9]
