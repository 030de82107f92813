"""Registered streaming queries: each runs a Structured Streaming job over the
events file (availableNow), lands its output in the shared checkpoint folder
and returns the landed table."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.alerts import cooldown_sql
from wardline.catalog.registry import register
from wardline.catalog.tables import VALID
from wardline.session import scratch_path
from wardline.sources import files, standin
from wardline.sources.standin import CHANNELS as CH
from wardline.functions import clinical
from wardline.streaming import jobs, state

W = 8


def _events_stream(spark, d, files_per_batch: int = 1):
    schema = standin.table(spark, d, "events").schema
    path = os.path.join(d, "events.parquet")
    if not files.is_folder(spark, path):  # a stream reads folders: that of the file, and of its files this one
        return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "events.parquet")
                .parquet(d))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def _train_stats(spark, d):
    """M1 statistics (train split only): medians after fill, then mean/std after median fill.
    ``prepare`` materialises the filled frame once; its windows are never computed here."""
    from wardline.plans import preprocess
    p = preprocess.prepare(standin.readings_wide(spark, d), CH)
    return p.medians, {c: v[0] for c, v in p.scaler.items()}, {c: v[1] for c, v in p.scaler.items()}


def _land(spark, df, name):
    base = scratch_path(spark, name)
    out, ckpt = os.path.join(base, "out"), os.path.join(base, "checkpoint")
    jobs.run_available(df, out, ckpt)
    return spark.read.parquet(out)


_RUN = "OVER (PARTITION BY patient_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
STREAM_WIN_SQL = S.with_(*S.SCALER, (
    "sr AS (SELECT user_id AS patient_id, event_id AS message_id, ts, "
    + ", ".join(f"last_value(CASE WHEN event_type = '{c}' THEN value END IGNORE NULLS) {_RUN} AS {S.q(c)}" for c in CH)
    + ", row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"),
    "sz AS (SELECT sr.patient_id, sr.message_id, sr.ts, sr.rn, " + ", ".join(
        f"(coalesce(sr.{S.q(c)}, med.{S.q(c)}) - sc.{S.q(c + '__m')}) / sc.{S.q(c + '__s')} AS {S.q(c)}" for c in CH)
    + " FROM sr, med, sc)",
    f"se AS (SELECT patient_id, message_id, ts AS window_end, rn FROM sz WHERE rn >= {W})",
) + ("SELECT e.patient_id, e.message_id, e.window_end, CAST(s.step AS INTEGER) AS step, "
     + ", ".join(f"CAST(CAST(z.{S.q(c)} AS FLOAT) AS DOUBLE) AS {S.q(c)}" for c in CH)
     + f" FROM se e CROSS JOIN range({W}) s(step) JOIN sz z ON z.patient_id = e.patient_id AND z.rn = e.rn - {W - 1} + s.step")


@register("stream_windows", STREAM_WIN_SQL)
def stream_windows(spark, d):
    """J4 + J5 as a stateful stream: causal impute, z-score, full windows of 8 readings (no back-fill, no padding)."""
    med, mean, std = _train_stats(spark, d)
    readings = jobs.events_as_readings(_events_stream(spark, d), CH)
    landed = _land(spark, state.stream_windows(readings, CH, med, mean, std, W), "stream_windows")
    t = landed.select("patient_id", "message_id", F.col("window_end").cast("timestamp_ntz").alias("window_end"),
                      F.explode(F.sequence(F.lit(0), F.lit(W - 1))).alias("step"), "X")
    return t.select("patient_id", "message_id", "window_end", "step",
                    *[F.get("X", F.col("step") * len(CH) + i).cast("double").alias(c) for i, c in enumerate(CH)])


@register("stream_alerts", S.with_recursive(*S.PRED, *cooldown_sql(30)) + "SELECT patient_id, id, created_at, risk_level FROM fold WHERE raised")
def stream_alerts(spark, d):
    """J8 as a stateful stream: per-patient (last alert time, rank); equals the batch fold."""
    ev = _events_stream(spark, d)
    p = standin.prob_expr(F.col("value"))
    preds = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("ts").alias("created_at"),
                      p.alias("sepsis_probability"), clinical.risk_level(p).alias("risk_level"))
    landed = _land(spark, state.stream_alerts(preds, 30), "stream_alerts")
    return landed.select("patient_id", "id", F.col("created_at").cast("timestamp_ntz").alias("created_at"), "risk_level")


@register("stream_scored_alerts")
def stream_scored_alerts(spark, d):
    """M6 with the selected Spark ML model: messages → … → alerts (rows-only check)."""
    from wardline.catalog import ml as ml_catalog
    p, model = ml_catalog._fit(spark, d)
    paths = _realtime(spark, standin.messages_from(_events_stream(spark, d)), CH, p.medians, _part(p.scaler, 0), _part(p.scaler, 1),
                      jobs.model_probability(model), "selected_logistic_regression")
    return spark.read.parquet(paths["alerts"]).select("patient_id", "id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                                                       "risk_level", "message")


def _part(scaler, i):
    return {c: v[i] for c, v in scaler.items()}


# A declared linear scorer on the last step, so that SQL can repeat the whole chain. "error" readings
# are outside its vocabulary, so that their messages are rejected as unknown channels.
LINEAR_CHANNELS = [c for c in CH if c != "error"]
LINEAR_WEIGHTS = [round(0.9 - 0.35 * i, 2) for i in range(len(LINEAR_CHANNELS))]
LINEAR_INTERCEPT = -0.6
VITAL_CHANNELS = {v: c for v, c in standin.VITAL_STANDIN.items() if c in LINEAR_CHANNELS}


def _realtime(spark, messages, channels, medians, mean, std, score, version, base=None):
    return jobs.realtime(spark, messages, channels, medians, mean, std, score, base or scratch_path(spark, "realtime"), version,
                         cooldown_minutes=30, vital_names=standin.VITAL_STANDIN)


def _linear_alerts(spark, d, messages, base=None):
    med, mean, std = _train_stats(spark, d)
    return _realtime(spark, messages, LINEAR_CHANNELS, med, mean, std,
                     jobs.linear_probability(LINEAR_WEIGHTS, LINEAR_INTERCEPT), "declared_linear", base)


def _linear_sql() -> str:
    known = ", ".join(f"'{c}'" for c in LINEAR_CHANNELS)
    value = "CASE WHEN event_id % 20 = 8 THEN 1.0 ELSE value END"  # a JSON true counts as 1
    order = "OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    zs = [f"CAST(CAST((coalesce(lr.{S.q(c)}, med.{S.q(c)}) - sc.{S.q(c + '__m')}) / sc.{S.q(c + '__s')} AS FLOAT) AS DOUBLE)"
          for c in LINEAR_CHANNELS]
    score = " + ".join([repr(LINEAR_INTERCEPT), *(f"{w!r} * {z}" for w, z in zip(LINEAR_WEIGHTS, zs, strict=True))])
    ctes = [
        *VALID,
        f"le AS (SELECT e.user_id, e.event_id, e.ts, e.event_type, {value} AS val FROM events e JOIN vr ON vr.message_id = e.event_id "
        f"WHERE vr.reason IS NULL AND e.event_type IN ({known}))",
        "lr AS (SELECT user_id, event_id, ts, " + ", ".join(
            f"last_value(CASE WHEN event_type = '{c}' THEN val END IGNORE NULLS) {order} AS {S.q(c)}" for c in LINEAR_CHANNELS)
        + f", row_number() {order} AS rn FROM le)",
        f"pred AS (SELECT event_id AS id, CAST(user_id AS VARCHAR) AS patient_id, ts AS created_at, 1.0 / (1.0 + exp(-({score}))) AS p "
        f"FROM lr, med, sc WHERE rn >= {W})",
        S.PRED[1], *cooldown_sql(30),
        "vit AS (SELECT event_id, " + ", ".join(f"CASE WHEN event_type = '{c}' THEN val END AS {S.q(v)}" for v, c in standin.VITAL_STANDIN.items())
        + " FROM le)",
    ]
    return S.with_recursive(*S.SCALER, *ctes) + (
        "SELECT a.patient_id, a.id, a.created_at, a.risk_level, "
        + S.message_sql("a.risk_level", "a.patient_id", "a.sepsis_probability", S.reason_sql("v."))
        + " AS message FROM (SELECT * FROM fold WHERE raised) a JOIN vit v ON v.event_id = a.id")


def _alert_rows(spark, paths):
    return spark.read.parquet(paths["alerts"]).select("patient_id", "id", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                                                       "risk_level", "message")


@register("stream_messages_alerts", _linear_sql())
def stream_messages_alerts(spark, d):
    """M6 with the declared linear scorer: messages → validation → windows → score → cooldown → reason and message."""
    return _alert_rows(spark, _linear_alerts(spark, d, standin.messages_from(_events_stream(spark, d, 1000))))


@register("stream_messages_alerts_batches", _linear_sql())
def stream_messages_alerts_batches(spark, d):
    """The same over micro-batches: the messages arrive in five parts, one after the other, and each is landed before the next arrives."""
    msgs = standin.messages(spark, d)
    lo, hi = msgs.agg(F.min("arrival_ts").alias("lo"), F.max("arrival_ts").alias("hi")).first()
    src, base = scratch_path(spark, "arrivals"), scratch_path(spark, "realtime")
    cuts = [lo + (hi - lo) * k / 5 for k in range(1, 5)]
    for k in range(5):
        part = msgs
        if k:
            part = part.filter(F.col("arrival_ts") >= F.lit(cuts[k - 1]).cast("timestamp_ntz"))
        if k < 4:
            part = part.filter(F.col("arrival_ts") < F.lit(cuts[k]).cast("timestamp_ntz"))
        part.write.mode("append").parquet(src)
        stream = spark.readStream.schema(msgs.schema).parquet(src)
        # all files of a part are one micro-batch, so that they need not be a single one
        jobs.land_validated(stream, os.path.join(base, "ingest"), LINEAR_CHANNELS, LINEAR_CHANNELS)
    return _alert_rows(spark, _linear_alerts(spark, d, stream, base))


_AUDIT_SQL = _linear_sql().rsplit("SELECT a.patient_id", 1)[0] + (
    "SELECT 'alert_dispatched:' || CAST(id AS VARCHAR) AS id, 'system' AS actor, 'alert_dispatched' AS action, "
    "CAST(id AS VARCHAR) AS target_id, patient_id, risk_level FROM fold WHERE raised")


@register("stream_alert_audit", _AUDIT_SQL)
def stream_alert_audit(spark, d):
    """L5 in the stream: one audit row per dispatched alert."""
    paths = _linear_alerts(spark, d, standin.messages_from(_events_stream(spark, d, 1000)))
    return spark.read.parquet(paths["audit"]).select("id", "actor", "action", "target_id", F.col("details")["patient_id"].alias("patient_id"),
                                                     F.col("details")["risk_level"].alias("risk_level"))
