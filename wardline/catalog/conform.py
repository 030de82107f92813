"""Registered conform queries (M2) on the lineitem/part/orders stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import vocab
from wardline.catalog import sql as S
from wardline.catalog.registry import register, round_doubles
from wardline.operators import conform
from wardline.sources import standin


def _values(cands, source):
    return ", ".join(f"('{ch}', '{source}', '{c.lower()}')" for ch, labels in cands.items() for c in labels)


MAP_SQL = [
    "cand AS (SELECT * FROM (VALUES " + _values(standin.CHART_CANDIDATES, "chart") + ", "
    + _values(standin.LAB_CANDIDATES, "lab") + ") t(channel, source, cand))",
    "dict AS (SELECT p_partkey AS itemid, p_type AS label, CASE WHEN p_size < 25 THEN 'chart' ELSE 'lab' END AS kind FROM part)",
    "cnt AS (SELECT l_partkey AS itemid, count(*) AS n FROM lineitem GROUP BY 1)",
    "m0 AS (SELECT c.channel, c.source, d.itemid, d.label, coalesce(cnt.n, 0) AS n FROM cand c "
    "JOIN dict d ON d.kind = c.source AND lower(d.label) = c.cand LEFT JOIN cnt USING (itemid))",
    "b2 AS (SELECT * FROM m0 QUALIFY row_number() OVER (PARTITION BY source, channel ORDER BY n DESC, itemid ASC) = 1 AND n > 0)",
    "map AS (SELECT *, source = 'chart' AND label = '" + standin.FAHRENHEIT_STANDIN + "' AS is_fahrenheit FROM b2 WHERE source = 'chart' "
    "UNION ALL SELECT *, false FROM b2 WHERE source = 'lab' AND channel NOT IN (SELECT channel FROM b2 WHERE source = 'chart'))",
]
CONF_SQL = MAP_SQL + [
    "ev AS (SELECT o_custkey AS subject_id, l_shipdate AS charttime, l_partkey AS itemid, l_quantity AS valuenum "
    "FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "cr AS (SELECT CAST(subject_id AS VARCHAR) AS patient_id, charttime, m.channel, "
    "CASE WHEN m.is_fahrenheit THEN (valuenum - 32) * 5 / 9 ELSE valuenum END AS value, 'mimic_iv_demo' AS source FROM ev JOIN map m USING (itemid) "
    "WHERE valuenum IS NOT NULL)",
]


def _mapping(spark, d):
    dic = standin.dictionary(spark, d)
    counts = conform.item_counts(standin.table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid")))
    cands = conform.candidates_frame(spark, standin.CHART_CANDIDATES, "chart").unionByName(
        conform.candidates_frame(spark, standin.LAB_CANDIDATES, "lab"))
    return conform.resolve_mapping(dic, counts, cands, ["chart", "lab"], {"chart": [standin.FAHRENHEIT_STANDIN]})


def _conformed(spark, d):
    return conform.conform_events(standin.coded_events(spark, d), _mapping(spark, d))


@register("item_counts", "SELECT l_partkey AS itemid, count(*) AS n FROM lineitem GROUP BY 1")
def item_counts(spark, d):
    return conform.item_counts(standin.table(spark, d, "lineitem").select(F.col("l_partkey").alias("itemid")))


@register("item_mapping", S.with_(*MAP_SQL) + "SELECT channel, source, itemid, label, n AS n_events, is_fahrenheit FROM map")
def item_mapping(spark, d):
    return _mapping(spark, d).select("channel", "source", "itemid", "label", "n_events", "is_fahrenheit")


@register("conformed_readings", S.with_(*CONF_SQL) + "SELECT patient_id, charttime, channel, round(value, 6) AS value, source FROM cr")
def conformed_readings(spark, d):
    return round_doubles(_conformed(spark, d))


@register("stays_joined", "SELECT o_orderkey AS stay_id, o_custkey AS patient_id, o_orderdate AS admission_time, o_orderpriority AS unit_admitted, "
                          "c_acctbal AS age, c_mktsegment AS sex, n_name AS nation, 'mimic_iv_demo' AS source_dataset "
                          "FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey")
def stays_joined(spark, d):
    return standin.stays(spark, d)


@register("stays_two_key", "SELECT CAST(o.o_custkey AS VARCHAR) AS patient_id, o.o_orderkey AS stay_id, c_acctbal AS age, c_mktsegment AS sex, "
                           "o.o_orderpriority AS unit_admitted, o.o_orderdate AS admission_time, o.o_orderdate + INTERVAL 3 DAY AS outtime, "
                           "CAST(3 AS DOUBLE) AS los, 'mimic_iv_demo' AS source_dataset FROM orders o "
                           "LEFT JOIN (SELECT o_custkey AS s, o_orderkey AS h FROM orders WHERE o_orderstatus <> 'P') a ON a.s = o.o_custkey AND a.h = o.o_orderkey "
                           "LEFT JOIN customer ON o.o_custkey = c_custkey")
def stays_two_key(spark, d):
    """Orders as stays, those not pending as admissions, customers as patients."""
    o = standin.table(spark, d, "orders")
    stays = o.select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"), F.col("o_orderkey").alias("stay_id"),
                     F.col("o_orderpriority").alias("first_careunit"), F.col("o_orderdate").alias("intime"),
                     (F.col("o_orderdate") + F.expr("INTERVAL 3 DAY")).alias("outtime"), F.lit(3.0).alias("los"))
    admissions = o.filter("o_orderstatus <> 'P'").select(F.col("o_custkey").alias("subject_id"), F.col("o_orderkey").alias("hadm_id"))
    patients = standin.table(spark, d, "customer").select(
        F.col("c_custkey").alias("subject_id"), F.col("c_mktsegment").alias("gender"), F.col("c_acctbal").alias("anchor_age"))
    return conform.join_stays(stays, admissions, patients)


@register("mapping_lists", S.with_(*MAP_SQL) + "SELECT v.channel, itemid, label, is_fahrenheit, itemid IS NOT NULL AS resolved FROM (VALUES "
          + ", ".join(f"('{c}')" for c in vocab.CLINICAL_CHANNELS) + ") v(channel) LEFT JOIN map USING (channel)")
def mapping_lists(spark, d):
    """resolved and unresolved channels."""
    return conform.mapping_lists(_mapping(spark, d))


@register("unresolved_channels", S.with_(*MAP_SQL, "voc AS (SELECT * FROM (VALUES "
                                         + ", ".join(f"('{c}', {i})" for i, c in enumerate(vocab.CLINICAL_CHANNELS))
                                         + ") t(channel, position))")
          + "SELECT channel, CAST(position AS INTEGER) AS position FROM voc WHERE channel NOT IN (SELECT channel FROM map)")
def unresolved_channels(spark, d):
    return conform.unresolved(_mapping(spark, d))


@register("conform_report", S.with_(*CONF_SQL) + (
    "SELECT 'n_patients' AS metric, count(DISTINCT patient_id) AS value FROM cr UNION ALL SELECT 'n_rows', count(*) FROM cr "
    "UNION ALL SELECT 'n_resolved', count(*) FROM map UNION ALL SELECT 'n_unresolved', " + str(len(vocab.CLINICAL_CHANNELS))
    + " - (SELECT count(*) FROM map WHERE channel IN (" + ", ".join(f"'{c}'" for c in vocab.CLINICAL_CHANNELS) + "))"))
def conform_report(spark, d):
    """mapping report."""
    m = _mapping(spark, d)
    return conform.mapping_report(conform.conform_events(standin.coded_events(spark, d), m), m)
