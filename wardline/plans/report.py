"""M7 patient report table and M8 unit overview.

Every side is first reduced to at most one row (or a bounded list) per
patient with partial aggregation, then left-joined on patient_id: no N+1
lookups and no per-patient driver loop.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators import series, tables

KEY = "patient_id"


def patient_report(patients: DataFrame, predictions: DataFrame, alerts: DataFrame, vitals: DataFrame,
                   vital_channels: Sequence[str], n_recent: int = 12) -> DataFrame:
    """One row per patient: latest prediction, prediction count and peak, recent risk trail,
    alert count and last alert time, latest vitals as display text (C14, C15)."""
    pr = predictions.select(KEY, "id", "created_at", "sepsis_probability", "risk_level")
    lp = pr.groupBy(KEY).agg(
        F.count(F.lit(1)).alias("n_predictions"), F.max("sepsis_probability").alias("max_probability"),
        F.max_by(F.struct("sepsis_probability", "risk_level", "created_at"), F.struct("created_at", "id")).alias("_l"))
    recent = tables.last_n_per_key(pr, KEY, ["created_at", "id"], n_recent).groupBy(KEY).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "risk_level"))), lambda x: x["risk_level"]), ",")
        .alias("recent_risk_levels"))
    la = alerts.groupBy(KEY).agg(F.count(F.lit(1)).alias("n_alerts"), F.max("created_at").alias("last_alert_at"))
    lv = tables.latest_per_key(vitals.select("id", KEY, "ts", *vital_channels), KEY, ["ts", "id"])
    j = patients.select(KEY, "current_status", "created_by").join(lp, KEY, "left").join(la, KEY, "left") \
        .join(recent, KEY, "left").join(lv, KEY, "left")
    show = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm 'UTC'"), F.lit("--"))
    return j.select(
        KEY, "current_status", "created_by", F.coalesce("n_predictions", F.lit(0)).alias("n_predictions"),
        F.round("_l.sepsis_probability", 6).alias("latest_probability"), F.col("_l.risk_level").alias("latest_risk_level"),
        show(F.col("_l.created_at")).alias("latest_at_text"), F.round("max_probability", 6).alias("max_probability"),
        F.coalesce("n_alerts", F.lit(0)).alias("n_alerts"), show(F.col("last_alert_at")).alias("last_alert_at_text"),
        "recent_risk_levels", *[clinical.one_decimal(F.col(c)).alias(f"{c}_text") for c in vital_channels])


def patient_document(patients: DataFrame, vitals: DataFrame, predictions: DataFrame, alerts: DataFrame,
                     explanations: DataFrame | None = None, n_vitals: int = 200, n_predictions: int = 200,
                     n_alerts: int = 100) -> DataFrame:
    """One nested row per patient: newest vitals, predictions and alerts (bounded lists, newest first)
    and the explanation of the latest prediction."""
    def newest_list(df: DataFrame, order: Sequence[str], n: int, name: str) -> DataFrame:
        rows = tables.last_n_per_key(df, KEY, order, n, "__rank")
        item = F.struct(*[F.col(c) for c in df.columns if c != KEY]).alias("r")
        return rows.groupBy(KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("__rank", item))), lambda x: x["r"]).alias(name))

    doc = patients.join(newest_list(vitals, ["ts", "id"], n_vitals, "vitals"), KEY, "left") \
        .join(newest_list(predictions, ["created_at", "id"], n_predictions, "predictions"), KEY, "left") \
        .join(newest_list(alerts, ["created_at", "id"], n_alerts, "alerts"), KEY, "left")
    if explanations is not None:
        e = explanations.select(F.col("prediction_id").alias("__pid"), F.struct(*[c for c in explanations.columns if c != KEY]).alias("explanation"))
        doc = doc.withColumn("__pid", F.get("predictions", F.lit(0))["id"]).join(e, "__pid", "left").drop("__pid")
    return doc


def unit_overview(patients: DataFrame, alerts: DataFrame, n_recent: int = 15) -> tuple[DataFrame, DataFrame]:
    """M8: KPI table (alert counts by risk, patient counts by status, zero-filled; F20)
    and the newest ``n_recent`` urgent unacknowledged alerts (D12 + H6)."""
    kpis = tables.count_by_domain(alerts, "risk_level", vocab.RISK_LEVELS, "risk") \
        .unionByName(tables.count_by_domain(patients, "current_status", vocab.PATIENT_STATUSES, "status"))
    urgent = series.newest(series.urgent_unacknowledged(alerts), n_recent)
    return kpis, urgent
