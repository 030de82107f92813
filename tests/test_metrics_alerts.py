import datetime as dt
import math

from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators import alerts, ranking


def _scores(spark, ys, ps):
    return spark.createDataFrame(list(zip(ys, ps)), "y int, score double")


def test_confusion_perfect_and_reversed(spark):
    r = ranking.confusion_at(_scores(spark, [0, 0, 1, 1], [.1, .2, .8, .9]), 0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (2, 0, 0, 2) and r.precision == r.recall_sensitivity == r.specificity == r.f1_score == 1
    r = ranking.confusion_at(_scores(spark, [0, 0, 1, 1], [.9, .8, .2, .1]), 0.5).first()
    assert (r.tn, r.fp, r.fn, r.tp) == (0, 2, 2, 0) and r.precision == 0 and r.recall_sensitivity == 0
    r = ranking.confusion_at(_scores(spark, [0, 0, 1, 1], [.01] * 4), 0.5).first()
    assert r.precision == 0 and r.recall_sensitivity == 0 and r.specificity == 1


def test_best_threshold_and_auroc(spark):
    df = _scores(spark, [0] * 50 + [1] * 50, [0.1] * 50 + [0.9] * 50)
    t = ranking.best_f1_threshold(ranking.cumulative_desc(ranking.score_histogram(df))).first().threshold
    assert 0.1 < t <= 0.9
    df = _scores(spark, [0] * 100 + [1] * 100, [0.05] * 100 + [0.95] * 100)
    cum = ranking.cumulative_desc(ranking.score_histogram(df))
    a = ranking.auroc_auprc(cum).first()
    assert a.auroc == 1.0 and a.auprc == 1.0
    assert ranking.best_f1_threshold(cum).first().f1 == 1.0


def test_auroc_with_ties_equals_pairwise_definition(spark):
    ys = [0, 1, 0, 1, 1, 0, 0, 1, 0, 1, 1, 1]
    ps = [.1, .1, .2, .3, .3, .3, .5, .5, .7, .9, .2, .05]
    a = ranking.auroc_auprc(ranking.cumulative_desc(ranking.score_histogram(_scores(spark, ys, ps)), 3)).first().auroc
    pos = [p for y, p in zip(ys, ps) if y]
    neg = [p for y, p in zip(ys, ps) if not y]
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert abs(a - exp) < 1e-12


def test_risk_levels_inclusive(spark):
    t = vocab.FALLBACK_THRESHOLD
    df = spark.createDataFrame([(x,) for x in [.01, .10, .15, t + .01, .5, .9]], "p double")
    got = [r[0] for r in df.select(clinical.risk_level(F.col("p"))).collect()]
    assert got == ["Low", "Medium", "Medium", "High", "Critical", "Critical"]


def test_focal_loss_finite_and_clipped(spark):
    df = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0), (0, 0.0), (1, 0.9), (1, 0.6)], "y int, p double")
    v = [r[0] for r in df.select(clinical.focal_loss(F.col("y"), F.col("p"))).collect()]
    assert all(math.isfinite(x) and x >= 0 for x in v)
    assert v[4] < v[5]  # easy example is down-weighted


T0 = dt.datetime(2024, 1, 1, 12, 0)


def _preds(spark, rows):
    return spark.createDataFrame([(i, p, T0 + dt.timedelta(minutes=m), lvl, 0.6) for i, (p, m, lvl) in enumerate(rows)],
                                 "id long, patient_id string, created_at timestamp, risk_level string, sepsis_probability double")


def _raised(spark, rows, **kw):
    return sorted(r.id for r in alerts.cooldown_alerts(_preds(spark, rows), **kw).collect())


def test_cooldown_rules(spark):
    assert _raised(spark, [("p", 0, "Low"), ("p", 1, "Medium")]) == []
    assert _raised(spark, [("p", 0, "High")]) == [0]
    assert _raised(spark, [("p", 0, "High"), ("p", 5, "High")]) == [0]
    assert _raised(spark, [("p", 0, "High"), ("p", 5, "Critical")]) == [0, 1]
    assert _raised(spark, [("p", 0, "Critical"), ("p", 5, "High")]) == [0]
    assert _raised(spark, [("p", 0, "High"), ("p", 30, "High")]) == [0, 1]  # age equal to cooldown raises
    assert _raised(spark, [("p", 0, "High"), ("p", 10, "High"), ("p", 35, "High")]) == [0, 2]
    assert _raised(spark, [("p1", 0, "Critical"), ("p2", 0, "Critical")]) == [0, 1]


def test_cooldown_existing_alert_counts(spark):
    existing = spark.createDataFrame([("p", T0 - dt.timedelta(minutes=999), "High"), ("q", T0 - dt.timedelta(minutes=5), "High")],
                                     "patient_id string, created_at timestamp, risk_level string")
    assert _raised(spark, [("p", 0, "High"), ("q", 0, "High")], existing=existing) == [0]


def test_reason_and_message(spark):
    ch = spark.createDataFrame([(118.0, 39.1, 82.0, None, None, None)], "HR double, Temp double, SBP double, O2Sat double, MAP double, Resp double")
    cols = {c: F.col(c) for c in ch.columns}
    r = ch.select(clinical.abnormal_reason(cols).alias("r")).first().r
    assert r == "Elevated Heart rate (118bpm), Elevated Temperature (39°C), Low Systolic BP (82mmHg)"
    ok = spark.createDataFrame([(80.0, 37.0, 120.0, 97.0, 80.0, 16.0)], "HR double, Temp double, SBP double, O2Sat double, MAP double, Resp double")
    assert ok.select(clinical.abnormal_reason(cols)).first()[0] == ""
    m = ok.select(clinical.alert_message(F.lit("High"), F.lit("p1"), F.lit(0.285), F.lit(""))).first()[0]
    assert m == "[High] Sepsis risk for patient p1: 28% probability -- " + vocab.FALLBACK_REASON
    # strict bounds, nulls ignored, at most three findings, half-even rounding
    edge = spark.createDataFrame([(100.0, 38.3, 90.0, 91.5, 64.0, 23.0)], "HR double, Temp double, SBP double, O2Sat double, MAP double, Resp double")
    assert edge.select(clinical.abnormal_reason(cols)).first()[0] == "Low Oxygen saturation (92%), Low MAP (64mmHg), Elevated Respiratory rate (23breaths/min)"


def _python_fold(rows, cd_min):
    out, state = set(), {}
    for rid, pid, minute, lvl in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        if lvl not in ("High", "Critical"):
            continue
        r = vocab.RISK_RANK[lvl]
        last = state.get(pid)
        if last is None or r > last[1] or minute - last[0] >= cd_min:
            out.add(rid)
            state[pid] = (minute, r)
    return out


def test_cooldown_matches_python_fold(spark):
    import random
    rnd = random.Random(7)
    rows, rid = [], 0
    for pid in ("a", "b", "c"):
        m = 0
        for _ in range(150):
            m += rnd.choice([1, 2, 5, 10, 29, 30, 31, 45, 200])
            rows.append((rid, pid, m, rnd.choice(["High", "High", "Critical", "Medium"])))
            rid += 1
    df = spark.createDataFrame([(i, p, T0 + dt.timedelta(minutes=m), lvl, 0.5) for i, p, m, lvl in rows],
                               "id long, patient_id string, created_at timestamp, risk_level string, sepsis_probability double")
    exp = _python_fold(rows, 30)
    assert {r.id for r in alerts.cooldown_alerts(df, 30).collect()} == exp
    assert {r.id for r in alerts.cooldown_alerts(df, 30, segment=2, fan=3).collect()} == exp  # functions composed in rounds


def test_asof_carries_across_days(spark):
    day = dt.timedelta(days=1)
    vit = spark.createDataFrame([(1, "p", T0, 70.0), (2, "p", T0 + dt.timedelta(hours=2), 71.0), (3, "q", T0, 50.0)],
                                "id long, patient_id string, ts timestamp, HR double")
    left = spark.createDataFrame([(10, "p", T0 + dt.timedelta(hours=1)), (11, "p", T0 + dt.timedelta(hours=5)),
                                  (12, "p", T0 + 2 * day), (13, "q", T0 - day), (14, "p", T0 + dt.timedelta(hours=2)),
                                  (15, None, T0 + dt.timedelta(hours=3))],
                                 "pid long, patient_id string, created_at timestamp")
    got = {r.pid: r.v_id for r in alerts.asof_latest(left, vit, "patient_id", "created_at", "ts", "id", ["HR"]).collect()}
    assert got == {10: 1, 11: 2, 12: 2, 13: None, 14: 2, 15: None}


def test_cooldown_with_existing_alerts_matches_python_fold(spark):
    import random
    rnd = random.Random(13)
    preds, manual, rid = [], [], 0
    for pid in ("a", "b"):
        m = 0
        for _ in range(120):
            m += rnd.choice([1, 3, 7, 15, 29, 31, 60])
            if rnd.random() < 0.1:
                manual.append((pid, m, rnd.choice(["Low", "High", "Critical"])))
            else:
                preds.append((rid, pid, m, rnd.choice(["High", "Critical", "Low"])))
                rid += 1
    # reference fold over the merged sequence; existing alerts update the state and come first at equal times
    events = [(p, m, 0, lvl, None) for p, m, lvl in manual] + [(p, m, 1, lvl, i) for i, p, m, lvl in preds]
    exp, state = set(), {}
    for p, m, kind, lvl, i in sorted(events, key=lambda e: (e[0], e[1], e[2], e[4] if e[4] is not None else -1)):
        r = vocab.RISK_RANK.get(lvl, 0)
        if kind == 0:
            state[p] = (m, r)
            continue
        if lvl not in ("High", "Critical"):
            continue
        last = state.get(p)
        if last is None or r > last[1] or m - last[0] >= 30:
            exp.add(i)
            state[p] = (m, r)
    df = spark.createDataFrame([(i, p, T0 + dt.timedelta(minutes=m), lvl, 0.5) for i, p, m, lvl in preds],
                               "id long, patient_id string, created_at timestamp, risk_level string, sepsis_probability double")
    ex = spark.createDataFrame([(p, T0 + dt.timedelta(minutes=m), lvl) for p, m, lvl in manual],
                               "patient_id string, created_at timestamp, risk_level string")
    assert {r.id for r in alerts.cooldown_alerts(df, 30, existing=ex).collect()} == exp
    assert {r.id for r in alerts.cooldown_alerts(df, 30, existing=ex, segment=1, fan=2).collect()} == exp


def test_transfer_functions_equal_following_the_rows():
    import random

    import numpy as np
    import pyarrow as pa

    from wardline.operators import cooldown as C
    rnd = random.Random(3)
    for _ in range(100):
        cd, span, rows = 10, 40, []
        for k in range(rnd.randint(1, 5)):
            times = sorted(rnd.randrange(40) for _ in range(rnd.randint(1, 14)))
            rows += [(k, 7, 280 + t, int(rnd.random() < 0.1), rnd.randint(0, 3)) for t in times]
        rows.sort(key=lambda r: (r[0], r[2], -r[3]))
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        columns = zip(*[(str(r[0]), *r[1:]) for r in rows], strict=True)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["_k", "_s", "_us", "_m", "_rank"])
        cut = rnd.randint(0, len(rows))
        functions = {}
        for out in C._functions(iter([batch.slice(0, cut), batch.slice(cut)]), cd, span):
            for r in out.to_pylist():
                functions.setdefault(r["_k"], C.Function()).add(r["rank"], r["upto"], None if r["us"] is None else (r["us"], r["to_rank"]))
        for k in {r[0] for r in rows}:
            for state in [None, *[(280 - d, r) for d in range(1, 14) for r in range(4)]]:
                last, changed, raised = state, False, []
                for i, (key, _, us, manual, rank) in enumerate(rows):
                    if key == k and (manual or last is None or rank > last[1] or us - last[0] >= cd):
                        last, changed = (us, rank), True
                        raised += [] if manual else [i]
                assert functions[str(k)](state, cd) == (last if changed else None)
                with_state = batch.append_column("_in_us", pa.array([state and state[0]] * len(rows), pa.int64())) \
                    .append_column("_in_rank", pa.array([state and state[1]] * len(rows), pa.int32())) \
                    .append_column("i", pa.array(np.arange(len(rows))))
                if state is None or rnd.random() < 0.1:
                    got = [r["i"] for out in C._raised(iter([with_state]), cd, span, ["_k", "i"]) for r in out.to_pylist() if r["_k"] == str(k)]
                    assert got == raised
