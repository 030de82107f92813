"""Queries for single operators, explanations under a declared model, and write-then-read of every sink."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.metrics import PR
from wardline.catalog.registry import r6, register, round_doubles
from wardline.functions import clinical
from wardline.operators import alerts as alerting
from wardline.operators import attribution, eda, impute, ml, series, tables
from wardline.operators import windows as win
from wardline.plans import preprocess
from wardline.session import scratch_path, write_scratch
from wardline.sources import files, standin
from wardline.sources.standin import CHANNELS as CH
from wardline.sources.tables import table
from wardline.streaming import jobs, once

KEY = "patient_id"
IDS = [KEY, "window_end_idx"]
CHQ = ", ".join(S.q(c) for c in CH)


def _prepared(spark, d):
    return preprocess.prepare(standin.readings_wide(spark, d), CH)


# --- column operators -------------------------------------------------------------------

@register("inverse_zscore", S.with_(*S.MED) + "SELECT patient_id, \"ICULOS\", "
          + ", ".join(f"{S.r6(S.q(c))} AS {S.q(c)}" for c in CH) + " FROM imp")
def inverse_zscore(spark, d):
    """Undoing the z-score gives the imputed values back."""
    p = _prepared(spark, d)
    return round_doubles(impute.invert_scaler(p.normalized, p.scaler, CH).select(KEY, "ICULOS", *CH))


@register("public_ids", "SELECT CAST(event_id AS VARCHAR) AS id, user_id AS patient_id, value FROM events")
def public_ids(spark, d):
    """C13."""
    ev = table(spark, d, "events").select(F.col("event_id").alias("_id"), F.col("user_id").alias(KEY), "value")
    return series.with_public_id(ev)


@register("contribution_direction", "SELECT event_id AS id, CASE WHEN value - 100 > 0 THEN 'Increases risk' ELSE 'Decreases risk' END "
                                    "AS direction FROM events")
def contribution_direction(spark, d):
    """C16."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), clinical.direction(F.col("value") - 100).alias("direction"))


@register("window_bounds", "SELECT event_id AS id, ts - INTERVAL 7 HOUR AS window_start, ts AS window_end FROM events")
def window_bounds(spark, d):
    """C24."""
    return table(spark, d, "events").select(F.col("event_id").alias("id"), clinical.window_start(F.col("ts"), 8).alias("window_start"),
                                            F.col("ts").alias("window_end"))


@register("dispatched_channels", S.with_(*S.PRED) + "SELECT id, CASE risk_level WHEN 'Critical' THEN 'email,mqtt,telegram' WHEN 'High' THEN 'mqtt' "
                                 "ELSE '' END AS channels FROM preds")
def dispatched_channels(spark, d):
    """C25 over a status that depends on the risk."""
    level = F.col("risk_level")
    sent = lambda c: F.when(c, "sent").otherwise("skipped")
    status = F.create_map(F.lit("telegram"), sent(level == "Critical"), F.lit("email"), sent(level == "Critical"),
                          F.lit("mqtt"), sent(level.isin("High", "Critical")))
    out = alerting.enrich_alerts(standin.predictions(spark, d), F.lit(""), status=status)
    return out.select("id", F.array_join(F.array_sort("channels_dispatched"), ",").alias("channels"))


_WX = S.with_(*S.SCALER, *S.windows_sql("z", 8, 1))


@register("masked_windows", _WX + "SELECT patient_id, window_end_idx, step, " + ", ".join(
    (S.q(c) if i % 2 == 0 else f"CAST({i}.5 AS DOUBLE)") + f" AS {S.q(c)}" for i, c in enumerate(CH)) + " FROM wx")
def masked_windows(spark, d):
    """C20: every second channel replaced by a background value."""
    keep = F.array(*[F.lit(i % 2 == 0) for i in range(len(CH))])
    fill = F.array(*[F.lit(i + 0.5) for i in range(len(CH))])
    w = _prepared(spark, d).windows.select(*IDS, win.mask_channels(F.col("X"), keep, fill).alias("X"))
    t = win.explode_steps(w, CH, IDS)
    return t.select(*IDS, "step", *[F.col(c).cast("double").alias(c) for c in CH])


@register("flat_windows", _WX + "SELECT patient_id, window_end_idx, CAST(step * " + str(len(CH)) + " + j AS INTEGER) AS position, v AS value FROM ("
          + " UNION ALL ".join(f"SELECT patient_id, window_end_idx, step, {j} AS j, {S.q(c)} AS v FROM wx" for j, c in enumerate(CH)) + ")")
def flat_windows(spark, d):
    """C21."""
    w = _prepared(spark, d).windows.select(*IDS, F.posexplode(win.flatten_window(F.col("X"))).alias("position", "v"))
    return w.select(*IDS, F.col("position").cast("int").alias("position"), F.col("v").cast("double").alias("value"))


@register("empty_channels", "SELECT user_id AS patient_id, array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN count(CASE WHEN event_type = '{c}' THEN value END) = 0 THEN '{c}' END" for c in CH) + "], lambda x: x IS NOT NULL), ',') AS channels "
    "FROM events GROUP BY 1")
def empty_channels(spark, d):
    """Per patient the channels that never have a value."""
    ev = table(spark, d, "events")
    wide = ev.select(F.col("user_id").alias(KEY), *[F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in CH])
    return eda.all_null_channels(wide, CH, KEY).select(KEY, F.array_join("empty_channels", ",").alias("channels"))


@register("table_rows", "SELECT count(*) AS n FROM lineitem")
def table_rows(spark, d):
    """F27."""
    return tables.row_count(table(spark, d, "lineitem"))


# --- keyed views ---------------------------------------------------------------------------

@register("latest_explanation", S.with_(*S.PRED) + "SELECT l.id, l.patient_id, round(l.sepsis_probability, 6) AS sepsis_probability, "
          "e.event_type AS explanation_top FROM (SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY patient_id "
          "ORDER BY created_at DESC, id DESC) = 1) l LEFT JOIN (SELECT * FROM events WHERE event_type <> 'signup') e ON e.event_id = l.id")
def latest_explanation(spark, d):
    """Latest prediction with its explanation, where there is one (events but sign-ups have one)."""
    history = table(spark, d, "events").filter("event_type <> 'signup'").select(F.col("event_id").alias("prediction_id"),
                                                                              F.col("event_type").alias("top"))
    out = tables.latest_with_explanation(standin.predictions(spark, d), history)
    return out.select("id", KEY, r6("sepsis_probability").alias("sepsis_probability"), "explanation_top")


@register("live_view", "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) "
                       "SELECT user_id AS patient_id, max(CASE WHEN k = 1 THEN event_id END) AS latest_id, count(*) AS n_recent, "
                       "round(sum(value * k), 4) AS weighted FROM r WHERE k <= 50 GROUP BY 1")
def live_view(spark, d):
    """The newest reading and the last 50, newest first."""
    ev = table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("timestamp"), F.col("event_id").alias("id"), "value")
    v = tables.live_view(ev, KEY, ["timestamp", "id"], 50)
    weighted = F.aggregate(F.transform("recent", lambda r, i: r["value"] * (i + 1)), F.lit(0.0), lambda a, b: a + b)
    return v.select(KEY, F.col("latest.id").alias("latest_id"), F.size("recent").cast("long").alias("n_recent"), F.round(weighted, 4).alias("weighted"))


@register("audit_trail", S.with_(*S.PRED) + "SELECT 'prediction_run:' || CAST(id AS VARCHAR) AS id, 'system' AS actor, 'prediction_run' AS action, "
          "CAST(id AS VARCHAR) AS target_id, risk_level, created_at AS timestamp FROM preds WHERE risk_level = 'Critical'")
def audit_trail(spark, d):
    """L5."""
    p = standin.predictions(spark, d).filter("risk_level = 'Critical'")
    rows = tables.audit_rows(p, "system", "prediction_run", "prediction", "id", {"risk_level": F.col("risk_level")}, "created_at")
    return rows.select("id", "actor", "action", "target_id", F.col("details")["risk_level"].alias("risk_level"), "timestamp")


@register("acknowledge_audit", S.with_(*S.PRED) + "SELECT 'alert_acknowledged:' || CAST(p.id AS VARCHAR) AS id, min_by(e.u, (e.at, e.u)) AS actor FROM "
          "(SELECT * FROM preds WHERE risk_level = 'Critical') p JOIN (SELECT event_id AS id, 'user_' || CAST(user_id % 7 AS VARCHAR) AS u, ts AS at "
          "FROM events WHERE event_type IN ('view', 'click')) e USING (id) GROUP BY 1")
def acknowledge_audit(spark, d):
    """L4: audit rows of the acknowledgements (views and clicks) that met an alert."""
    found = standin.predictions(spark, d).filter("risk_level = 'Critical'")
    acks = table(spark, d, "events").filter("event_type IN ('view', 'click')").select(
        F.col("event_id").alias("id"), F.concat(F.lit("user_"), (F.col("user_id") % 7).cast("string")).alias("acknowledged_by"),
        F.col("ts").alias("acknowledged_at"))
    return tables.acknowledge_audit(found, acks).select("id", "actor")


@register("window_sample", _WX + "SELECT patient_id, window_end_idx FROM (SELECT DISTINCT patient_id, window_end_idx FROM wx WHERE split = 'train') "
          "ORDER BY md5(CAST(patient_id AS VARCHAR) || ':' || CAST(window_end_idx AS VARCHAR) || ':42') LIMIT 100")
def window_sample(spark, d):
    """K6: a seeded sample of train windows (sampling is the feature)."""
    return ml.sample_windows(_prepared(spark, d).windows.filter(F.col("split") == "train"), 100, 42).select(*IDS)


# --- explanation under a declared logistic model -------------------------------------------------

WEIGHTS = [round(0.08 - 0.03 * i, 2) for i in range(len(CH))]
INTERCEPT = -0.4


def declared(x: np.ndarray) -> np.ndarray:
    """Logistic function of the weighted channel sums of each window."""
    return 1.0 / (1.0 + np.exp(-(x.sum(axis=1) @ np.array(WEIGHTS) + INTERCEPT)))


def _tall_sql() -> list[str]:
    parts = " UNION ALL ".join(
        f"SELECT patient_id, window_end_idx, y, {j} AS j, {w!r} * s{j} - {w!r} * 8 * f{j} AS d, {w!r} * 8 * f{j} AS b, l{j} AS seen FROM ws, bg"
        for j, w in enumerate(WEIGHTS))
    sums = ", ".join(f"sum({S.q(c)}) AS s{j}, max(CASE WHEN step = 7 THEN {S.q(c)} END) AS l{j}" for j, c in enumerate(CH))
    return [
        *S.SCALER, *S.windows_sql("z", 8, 1),
        f"ws AS (SELECT patient_id, window_end_idx, max(y) AS y, {sums} FROM wx WHERE split = 'test' GROUP BY 1, 2)",
        "bg AS (SELECT " + ", ".join(f"avg({S.q(c)}) AS f{j}" for j, c in enumerate(CH)) + " FROM wx WHERE split = 'train')",
        f"tall AS ({parts})",
        "pos AS (SELECT *, row_number() OVER (PARTITION BY patient_id, window_end_idx ORDER BY md5(CAST(patient_id AS VARCHAR) || ':' || "
        "CAST(window_end_idx AS VARCHAR) || ':0:' || CAST(j AS VARCHAR)), j) AS k FROM tall)",
        f"walk AS (SELECT *, {INTERCEPT!r} + sum(b) OVER w AS z0, sum(d) OVER w AS whole, sum(d) OVER (PARTITION BY patient_id, window_end_idx ORDER BY k) AS fwd, "
        "sum(d) OVER (PARTITION BY patient_id, window_end_idx ORDER BY k DESC) AS bwd FROM pos WINDOW w AS (PARTITION BY patient_id, window_end_idx))",
        "con AS (SELECT patient_id, window_end_idx, y, j, seen, 1 / (1 + exp(-z0)) AS base_value, 1 / (1 + exp(-(z0 + whole))) AS prediction, "
        "round(((1 / (1 + exp(-(z0 + fwd))) - 1 / (1 + exp(-(z0 + fwd - d)))) + (1 / (1 + exp(-(z0 + bwd))) - 1 / (1 + exp(-(z0 + bwd - d))))) / 2, 6) "
        "AS c FROM walk)",
    ]


def _names_sql(j: str) -> str:
    return f"CASE {j} " + " ".join(f"WHEN {k} THEN '{c}'" for k, c in enumerate(CH)) + " END"


def _explained(spark, d):
    p = _prepared(spark, d)
    windows = write_scratch(p.windows, "windows")
    fill = [float(v) for v in ml.background_fill(windows.filter(F.col("split") == "train"), len(CH)).first()["fill"]]
    test = windows.filter(F.col("split") == "test")
    expl = attribution.explain_windows(test, CH, F.array(*[F.lit(v) for v in fill]), IDS, declared)
    # ranks are taken on rounded values, which both engines agree on
    return test, expl.withColumn("shap_values", F.transform_values("shap_values", lambda _, v: F.round(v, 6)))


@register("declared_attribution", S.with_(*_tall_sql()) + "SELECT patient_id, window_end_idx, round(max(base_value), 6) AS base_value, "
          "round(max(prediction), 6) AS prediction, " + ", ".join(f"max(CASE WHEN j = {j} THEN c END) AS {S.q(c + '_contribution')}" for j, c in enumerate(CH))
          + f" FROM con GROUP BY 1, 2")
def declared_attribution(spark, d):
    """K5 + K7 under the declared model: base value, prediction and contribution of every channel."""
    _, expl = _explained(spark, d)
    return expl.select(*IDS, r6("base_value").alias("base_value"), r6("prediction").alias("prediction"),
                       *[F.col("shap_values")[c].alias(f"{c}_contribution") for c in CH])


@register("declared_top_contributions", S.with_(*_tall_sql()) + f"SELECT patient_id, window_end_idx, CAST(k AS INTEGER) AS place, feature, contribution, "
          "round(seen, 6) AS observed_value, direction FROM (SELECT *, row_number() OVER (PARTITION BY patient_id, window_end_idx ORDER BY abs(c) DESC, j) AS k, "
          f"{_names_sql('j')} AS feature, c AS contribution, CASE WHEN c > 0 THEN 'Increases risk' ELSE 'Decreases risk' END AS direction FROM con) WHERE k <= 3")
def declared_top_contributions(spark, d):
    """G12 + C16: the three strongest channels of each window, ties by channel position, with the observed value."""
    _, expl = _explained(spark, d)
    top = attribution.top_contributions(expl, 3, CH).select(*IDS, F.posexplode("top_contributing_features").alias("place", "e"))
    return top.select(*IDS, (F.col("place") + 1).cast("int").alias("place"), "e.feature", "e.contribution",
                      r6("e.observed_value").alias("observed_value"), "e.direction")


@register("declared_importance", S.with_(*_tall_sql()) + f"SELECT {_names_sql('j')} AS channel, round(avg(abs(c)), 6) AS mean_abs_contribution FROM con GROUP BY 1")
def declared_importance(spark, d):
    """F19 under the declared model."""
    _, expl = _explained(spark, d)
    return round_doubles(attribution.global_importance(expl))


def _example_sql() -> str:
    one = ("SELECT '{case}' AS \"case\", patient_id, window_end_idx, round(p, 6) AS probability FROM "
           "(SELECT * FROM pr WHERE y {sign} 1 ORDER BY round(p, 9) {way}, window_end_idx, patient_id LIMIT 1)")
    return (S.with_(*_tall_sql(), "pr AS (SELECT patient_id, window_end_idx, max(y) AS y, max(prediction) AS p FROM con GROUP BY 1, 2)")
            + " UNION ALL ".join(one.format(case=c, sign=s, way=w) for c, s, w in (
                ("max_prob_positive", "=", "DESC"), ("min_prob_positive", "=", ""), ("min_prob_negative", "<>", ""))))


@register("declared_examples", _example_sql())
def declared_examples(spark, d):
    """G10 under the declared model, through the pluggable scorer (K1); ties by index, then patient."""
    test = _prepared(spark, d).windows.filter(F.col("split") == "test").select(*IDS, "y", "X")
    scored = ml.score(test, declared).select(*IDS, "y", F.round("probability", 9).alias("probability"))
    ex = ml.example_windows(scored)
    return ex.select(F.inline(F.filter(F.array(*[
        F.struct(F.lit(k).alias("case"), F.col(f"{k}.{KEY}").alias(KEY), F.col(f"{k}.window_end_idx").alias("window_end_idx"),
                 F.round(F.col(f"{k}.probability"), 6).alias("probability"))
        for k in ("max_prob_positive", "min_prob_positive", "min_prob_negative")]), lambda e: e[KEY].isNotNull())))


@register("declared_evaluation", S.with_(*_tall_sql(), "pr AS (SELECT patient_id, window_end_idx, max(y) AS y, max(prediction) AS p FROM con GROUP BY 1, 2)")
          + "SELECT count(*) AS n_samples, round(avg(CAST(y = 1 AS INTEGER)), 6) AS positive_rate, count(*) FILTER (y <> 1 AND p < 0.5) AS tn, "
            "count(*) FILTER (y <> 1 AND p >= 0.5) AS fp, count(*) FILTER (y = 1 AND p < 0.5) AS fn, count(*) FILTER (y = 1 AND p >= 0.5) AS tp FROM pr")
def declared_evaluation(spark, d):
    """K4 under the declared model: the nested metrics row's counts at 0.5."""
    from wardline.plans import evaluate
    test = _prepared(spark, d).windows.filter(F.col("split") == "test").select("y", "X")
    scored = ml.score(test, declared).select(F.col("y").cast("int").alias("y"), F.col("probability").alias("score"))
    m = evaluate.metrics_row(write_scratch(scored, "declared-scores"))
    return m.select("n_samples", F.round("positive_rate", 6).alias("positive_rate"),
                    *[F.col("metrics_at_0_5")[k].alias(k) for k in ("tn", "fp", "fn", "tp")])


# --- sinks and sources: written, then read ---------------------------------------------------------

@register("windows_dataset", _WX + "SELECT patient_id, window_end_idx, y, " + CHQ + " FROM wx WHERE split = 'val' AND step = 7")
def windows_dataset(spark, d):
    """B1 + A6: windows written by split; reading one split prunes to its folder."""
    path = scratch_path(spark, "windows-dataset")
    preprocess.write_windows(_prepared(spark, d).windows, path)
    w = files.read_windows(spark, path, "val")
    return w.select(*IDS, "y", win.last_timestep(F.col("X")).alias("v")).select(
        *IDS, "y", *[F.col("v")[i].cast("double").alias(c) for i, c in enumerate(CH)])


@register("m1_written", _WX + "SELECT split, count(DISTINCT patient_id) AS n_patients, count(*) AS n_windows, (SELECT count(*) FROM sp WHERE sp.split = wx.split) "
                                 "AS n_ids, round(avg(y), 6) AS positive_rate FROM wx WHERE step = 0 GROUP BY split")
def m1_written(spark, d):
    """M1 from readings to written windows, ids and metadata (B1, B2), read back."""
    out = scratch_path(spark, "m1")
    meta = preprocess.run(standin.readings_wide(spark, d), CH, out)
    rows = meta.select(F.explode("counts").alias("split", "c"))
    ids = spark.read.parquet(os.path.join(out, "patient_ids")).groupBy("split").agg(F.count(F.lit(1)).alias("n_ids"))
    return rows.join(ids, "split").select("split", F.col("c")["n_patients"].cast("long").alias("n_patients"), F.col("c")["n_windows"].cast("long").alias("n_windows"),
                                          "n_ids", F.round(F.col("c")["window_positive_rate"], 6).alias("positive_rate"))


@register("metrics_sidecar", S.with_(*PR) + "SELECT round(threshold, 6) AS threshold, (SELECT count(*) FROM sc) AS n_samples FROM pr ORDER BY f1 DESC, threshold ASC LIMIT 1")
def metrics_sidecar(spark, d):
    """B5 + A8: the metrics file as evaluation writes it, and the threshold read from it."""
    from wardline.plans import evaluate
    path = scratch_path(spark, "metrics")
    files.write_json(evaluate.metrics_row(standin.scored_lineitem(spark, d)), path)
    threshold = files.load_threshold(spark, path)
    return spark.read.json(path).select(F.round(F.lit(threshold), 6).alias("threshold"), "n_samples")


@register("published_predictions", S.with_(*S.PRED) + "SELECT 'icu/' || CAST(patient_id AS VARCHAR) || '/prediction' AS topic, "
          "round(sepsis_probability, 6) AS sepsis_probability, risk_level, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM preds")
def published_predictions(spark, d):
    """The payload of every prediction, parsed again."""
    frames = jobs.publish_frames(standin.predictions(spark, d))
    v = frames.select("topic", F.from_json("value", "sepsis_probability double, risk_level string, timestamp string").alias("v"))
    return v.select("topic", r6("v.sepsis_probability").alias("sepsis_probability"), "v.risk_level", "v.timestamp")


@register("published_alerts", S.with_(*S.PRED) + "SELECT 'icu/' || CAST(patient_id AS VARCHAR) || '/alert' AS topic, risk_level, "
          + S.message_sql("risk_level", "patient_id", "sepsis_probability", "''")
          + " AS message, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS timestamp FROM preds WHERE risk_level = 'Critical'")
def published_alerts(spark, d):
    """The payload of every critical alert, parsed again."""
    raised = alerting.enrich_alerts(standin.predictions(spark, d).filter("risk_level = 'Critical'"), F.lit(""))
    v = jobs.alert_frames(raised).select("topic", F.from_json("value", "risk_level string, message string, timestamp string").alias("v"))
    return v.select("topic", "v.risk_level", "v.message", "v.timestamp")


@register("csv_table", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def csv_table(spark, d):
    """B4 + A4: a statistic written as CSV and read with its schema."""
    path = scratch_path(spark, "statistics")
    files.write_csv(table(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean")), path)
    return files.read_csv_table(spark, path, "event_type string, n long, mean double")


@register("sorted_table", "SELECT user_id AS patient_id, ts AS charttime, event_type AS channel, value FROM events")
def sorted_table(spark, d):
    """B3 + H1: the canonical table, range-partitioned and sorted within files."""
    path = scratch_path(spark, "vitals-long")
    ev = table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("charttime"), F.col("event_type").alias("channel"), "value")
    files.write_sorted(ev, path, [KEY, "charttime"])
    return spark.read.parquet(path)


@register("event_batches", "SELECT event_id AS id, CAST(event_id % 3 AS INTEGER) AS batch_id FROM events")
def event_batches(spark, d):
    """Append-only batches; writing one of them again changes nothing."""
    path = scratch_path(spark, "event-batches")
    ev = table(spark, d, "events").select(F.col("event_id").alias("id"))
    for k in (0, 1, 2, 1):
        files.append_batch(ev.filter(F.col("id") % 3 == k), path, k)
    return spark.read.parquet(path).select("id", F.col("batch_id").cast("int").alias("batch_id"))


@register("alert_ids_once", S.with_(*S.PRED) + "SELECT id, patient_id, risk_level FROM preds")
def alert_ids_once(spark, d):
    """A stream that delivers every alert twice lands each id once, late ones too."""
    return _twice(spark, d, standin.predictions(spark, d).select("id", KEY, "created_at", "risk_level"), ["id"]).select("id", KEY, "risk_level")


@register("readings_once", "SELECT DISTINCT user_id AS patient_id, ts AS timestamp FROM events")
def readings_once(spark, d):
    """At-least-once delivery of readings, once per (patient, timestamp)."""
    ev = table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("timestamp"))
    return _twice(spark, d, ev, [KEY, "timestamp"])


def _twice(spark, d, rows, keys):
    """Deliver ``rows`` twice, the second time in later micro-batches, where the state has forgotten the first."""
    base = scratch_path(spark, "twice")
    src = os.path.join(base, "src")
    for _ in range(2):
        rows.write.mode("append").parquet(src)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(src)
    return once.land_once(stream, keys, os.path.join(base, "out"), os.path.join(base, "checkpoint"), horizon="0 seconds")
