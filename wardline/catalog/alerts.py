"""Registered alert queries (C7-C11, E10, J8, J9) on the event-derived predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.registry import r6, register
from wardline.functions import clinical
from wardline.operators import alerts
from wardline.sources import standin

KEY = "patient_id"


def _cd_us(minutes: int) -> str:
    return f"CAST({minutes * 60 * 1_000_000} AS BIGINT)"


def cooldown_sql(minutes: int, name: str = "fold") -> list[str]:
    cond = f"(t.rnk > f.last_rank OR t.us - f.last_us >= {_cd_us(minutes)})"
    return [
        f"trig AS (SELECT patient_id, id, created_at, risk_level, sepsis_probability, {S.RANK_SQL} AS rnk, epoch_us(created_at) AS us, "
        "row_number() OVER (PARTITION BY patient_id ORDER BY created_at, id) AS rn FROM preds WHERE risk_level IN ('High', 'Critical'))",
        f"{name} AS (SELECT patient_id, rn, id, created_at, risk_level, sepsis_probability, TRUE AS raised, us AS last_us, rnk AS last_rank "
        "FROM trig WHERE rn = 1 UNION ALL "
        f"SELECT t.patient_id, t.rn, t.id, t.created_at, t.risk_level, t.sepsis_probability, {cond}, "
        f"CASE WHEN {cond} THEN t.us ELSE f.last_us END, CASE WHEN {cond} THEN t.rnk ELSE f.last_rank END "
        f"FROM {name} f JOIN trig t ON t.patient_id = f.patient_id AND t.rn = f.rn + 1)",
    ]


def _preds(spark, d):
    return standin.predictions(spark, d)


@register("risk_levels", S.with_(*S.PRED) + "SELECT id, patient_id, created_at, round(sepsis_probability, 6) AS sepsis_probability, "
          "predicted_label, risk_level FROM preds")
def risk_levels(spark, d):
    p = _preds(spark, d)
    return p.select("id", KEY, "created_at", r6("sepsis_probability").alias("sepsis_probability"), "predicted_label", "risk_level")


def _vital_cols(prefix_col):
    return {name: prefix_col[name] for name in standin.VITAL_STANDIN}


@register("abnormal_reason", S.with_(*S.VITALS) + f"SELECT id, patient_id, ts, {S.reason_sql()} AS reason FROM vit")
def abnormal_reason(spark, d):
    v = standin.vitals(spark, d)
    return v.select("id", KEY, F.col("timestamp").alias("ts"), clinical.abnormal_reason(_vital_cols(F.col("channels"))).alias("reason"))


@register("alerts_cooldown", S.with_recursive(*S.PRED, *cooldown_sql(30)) + "SELECT patient_id, id, created_at, risk_level FROM fold WHERE raised")
def alerts_cooldown(spark, d):
    return alerts.cooldown_alerts(_preds(spark, d), 30)


@register("alerts_cooldown_long", S.with_recursive(*S.PRED, *cooldown_sql(2880)) + "SELECT patient_id, id, created_at, risk_level FROM fold WHERE raised")
def alerts_cooldown_long(spark, d):
    return alerts.cooldown_alerts(_preds(spark, d), 2880)


@register("alerts_cooldown_pointers", S.with_recursive(*S.PRED, *cooldown_sql(720)) + "SELECT patient_id, id, created_at, risk_level FROM fold WHERE raised")
def alerts_cooldown_pointers(spark, d):
    """J8 with segments of one cooldown whose functions are composed in pairs: log2 rounds up and down."""
    return alerts.cooldown_alerts(_preds(spark, d), 720, segment=1, fan=2)


ASOF_SQL = ("SELECT p.id, p.patient_id, p.created_at, v.id AS v_id, v.ts AS v_timestamp FROM "
            "(SELECT * FROM preds WHERE risk_level IN ('High', 'Critical')) p "
            "ASOF LEFT JOIN vit v ON p.patient_id = v.patient_id AND p.created_at >= v.ts")


def _asof(spark, d, left):
    v = standin.vitals(spark, d)
    return alerts.asof_latest(left, v, KEY, "created_at", "timestamp", "id", ["channels"])


@register("alert_asof", S.with_(*S.PRED, *S.VITALS) + ASOF_SQL)
def alert_asof(spark, d):
    trig = alerts.triggered(_preds(spark, d)).select("id", KEY, "created_at")
    return _asof(spark, d, trig).select("id", KEY, "created_at", "v_id", "v_timestamp")


MSG_SQL = (S.with_recursive(*S.PRED, *S.VITALS, *cooldown_sql(30))
           + "SELECT a.id, a.patient_id, a.created_at, a.risk_level, "
           + S.message_sql("a.risk_level", "a.patient_id", "a.sepsis_probability", S.reason_sql("v."))
           + " AS message FROM (SELECT * FROM fold WHERE raised) a ASOF LEFT JOIN vit v "
             "ON a.patient_id = v.patient_id AND a.created_at >= v.ts")


@register("alert_message", MSG_SQL)
def alert_message(spark, d):
    """Raised alerts with the as-of reason and the message text."""
    raised = alerts.cooldown_alerts(_preds(spark, d), 30, carry=["sepsis_probability"])
    j = _asof(spark, d, raised)
    reason = clinical.abnormal_reason(_vital_cols(F.col("v_channels")))
    out = alerts.enrich_alerts(j, reason)
    return out.select("id", KEY, "created_at", "risk_level", "message")
