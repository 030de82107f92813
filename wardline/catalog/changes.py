"""Registered queries that write keyed tables, change them and read them back (L1-L4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import registry
from wardline.catalog import sql as S
from wardline.catalog import tables as T
from wardline.catalog.registry import register
from wardline.operators import alerts as alerting
from wardline.session import scratch_path
from wardline.sources import standin
from wardline.sources.keyed import KeyedTable

KEY = "patient_id"


def _patients(spark, d, name, *columns):
    base = standin.patients(spark, d).select(KEY, *columns)
    return KeyedTable.create(base, scratch_path(spark, name), KEY, 16)


@register("keyed_patch", registry.ORACLE["patch"])
def keyed_patch(spark, d):
    """L2: patients patched in place by bucket, read back."""
    kept = _patients(spark, d, "keyed-patch", "current_status", F.col("created_at").alias("updated_at"))
    kept.patch(T.status_changes(spark, d), ["current_status"], updated_at=F.col("updated_at"))
    return kept.read()


@register("keyed_delete", registry.ORACLE["delete_by_key"])
def keyed_delete(spark, d):
    """L3: patients deleted by a key table, read back."""
    kept = _patients(spark, d, "keyed-delete", "current_status")
    kept.delete(T.discharged_keys(spark, d))
    return kept.read()


@register("keyed_acknowledge", registry.ORACLE["acknowledge"])
def keyed_acknowledge(spark, d):
    """L4: alerts acknowledged in place, read back."""
    al = alerting.enrich_alerts(T._alerts(spark, d), F.lit(""))
    al = al.select("id", KEY, "risk_level", "acknowledged", F.lit(None).cast("string").alias("acknowledged_by"),
                   F.lit(None).cast(al.schema["created_at"].dataType).alias("acknowledged_at"))
    kept = KeyedTable.create(al, scratch_path(spark, "keyed-alerts"), "id", 16)
    kept.acknowledge(T.owner_acks(spark, d))
    return kept.read()


@register("keyed_insert", S.with_(*S.PATIENTS) + (
    "SELECT patient_id, created_at, current_status FROM pat WHERE current_status = 'active' UNION ALL "
    "SELECT f.patient_id, f.created_at, 'active' FROM (SELECT user_id AS patient_id, min(ts) AS created_at FROM events GROUP BY 1) f "
    "WHERE f.patient_id NOT IN (SELECT patient_id FROM pat WHERE current_status = 'active')"))
def keyed_insert(spark, d):
    """L1: active patients and those that messages bring, once each, read back."""
    active = standin.patients(spark, d).filter("current_status = 'active'").select(KEY, "created_at", "current_status")
    kept = KeyedTable.create(active, scratch_path(spark, "keyed-insert"), KEY, 16)
    ev = standin.table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("created_at"), "event_id",
                                                 F.lit("active").alias("current_status"))
    kept.insert(ev, ["created_at", "event_id"])
    return kept.read()
