"""Stand-in views over the provided tables (the clinical data itself is not available).

Each view maps a provided table onto the canonical shape an operator expects:

* wide hourly readings: ``events`` pivoted per (user, hour), one channel per event type
* tall readings: ``events`` as (patient, charttime, channel, value)
* predictions: one per event, probability ``least(value/500, 1)``
* patients: ``customer`` (owner = nation, status from the market segment)
* coded-event source: ``lineitem`` ⋈ ``orders`` as events, ``part`` as item dictionary
* stays: ``orders`` ⟕ ``customer`` ⟕ ``nation``

The same definitions are written in SQL in ``wardline.catalog.sql`` for the oracle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators.fill import nan_to_null
from wardline.sources.tables import table

# Stand-in vocabularies (fixed by the provided data): the five event types are
# the channels; a positive hour is one whose largest reading reaches 150.
CHANNELS = ("view", "click", "purchase", "signup", "error")
LABEL_THRESHOLD = 150.0
PROB_SCALE = 500.0
# stand-in vital names used by the abnormal-reading rules
VITAL_STANDIN = {"HR": "view", "O2Sat": "click", "Temp": "purchase", "SBP": "signup", "MAP": "error"}
# market segment → patient status (MACHINERY maps outside the enum on purpose)
STATUS_BY_SEGMENT = {"AUTOMOBILE": "active", "BUILDING": "active", "FURNITURE": "discharged",
                     "HOUSEHOLD": "deceased", "MACHINERY": "transferred"}
# order status → patient status used as a patch
STATUS_BY_ORDER = {"O": "active", "F": "discharged", "P": "deceased"}
PATIENT_CREATED_AT = "2024-01-01 00:00:00"


def readings_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, hr, ICULOS (1-based hour index), one column per channel, SepsisLabel."""
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_type", nan_to_null(F.col("value")).alias("value"))
    hr = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    g = ev.groupBy(F.col("user_id").alias("patient_id"), hr.alias("hr")).agg(
        *[F.max(F.when(F.col("event_type") == c, F.col("value"))).alias(c) for c in CHANNELS],
        (F.max("value") >= LABEL_THRESHOLD).cast("int").alias("SepsisLabel"),
    )
    w = Window.partitionBy("patient_id").orderBy("hr")
    return g.select("patient_id", "hr", F.row_number().over(w).alias("ICULOS"), *CHANNELS, "SepsisLabel")


def readings_tall(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("patient_id"), F.col("ts").alias("charttime"),
                     F.col("event_type").alias("channel"), nan_to_null(F.col("value")).alias("value"),
                     F.lit("events").alias("source")).filter(F.col("value").isNotNull())


def prob_expr(value: Column) -> Column:
    return F.least(value / F.lit(PROB_SCALE), F.lit(1.0))


def predictions(spark: SparkSession, sf_dir: str, threshold: float = vocab.FALLBACK_THRESHOLD) -> DataFrame:
    """id, patient_id, created_at, sepsis_probability, predicted_label, risk_level, model_version."""
    ev = table(spark, sf_dir, "events")
    p = prob_expr(F.col("value"))
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("patient_id"), F.col("ts").alias("created_at"),
        p.alias("sepsis_probability"),
        clinical.predicted_label(p, threshold).alias("predicted_label"),
        clinical.risk_level(p, threshold).alias("risk_level"),
        F.lit(vocab.MODEL_VERSION).alias("model_version"),
    )


def vitals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored readings: id, patient_id, timestamp, channels struct (vital names)."""
    rw = readings_wide(spark, sf_dir)
    return rw.select(
        (F.col("patient_id") * F.lit(1000000) + F.col("ICULOS")).alias("id"), "patient_id",
        F.col("hr").alias("timestamp"), F.lit("iot_sensor").alias("source"),
        F.struct(*[F.col(src).alias(name) for name, src in VITAL_STANDIN.items()]).alias("channels"),
        (F.col("ICULOS") - 1).cast("long").alias("ingest_seq"),
    )


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    status = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in STATUS_BY_SEGMENT.items()])
    return c.select(
        F.col("c_custkey").alias("patient_id"), F.lit("live").alias("source_dataset"),
        F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sex"),
        status.alias("current_status"),
        F.concat(F.lit("owner_"), F.col("c_nationkey").cast("string")).alias("created_by"),
        F.lit(PATIENT_CREATED_AT).cast("timestamp_ntz").alias("created_at"),
    )


def dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item dictionary: itemid, label, kind ('chart' when p_size < 25 else 'lab')."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("itemid"), F.col("p_type").alias("label"),
                    F.when(F.col("p_size") < 25, "chart").otherwise("lab").alias("kind"))


def coded_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coded events: subject_id, charttime, itemid, valuenum."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").alias("charttime"),
        F.col("l_partkey").alias("itemid"), nan_to_null(F.col("l_quantity")).alias("valuenum"))


def stays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stays ⟕ admissions ⟕ patients → orders ⟕ customer ⟕ nation."""
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    j = o.join(c, o.o_custkey == c.c_custkey, "left").join(n, F.col("c_nationkey") == n.n_nationkey, "left")
    return j.select(
        F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("admission_time"), F.col("o_orderpriority").alias("unit_admitted"),
        F.col("c_acctbal").alias("age"), F.col("c_mktsegment").alias("sex"), F.col("n_name").alias("nation"),
        F.lit("mimic_iv_demo").alias("source_dataset"))


def scored_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, score) for ranking metrics: y = returned line, score = discount (heavy ties)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.col("l_discount").alias("score"))


def _json_str(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One raw vitals message per event (message_id, topic, value, arrival_ts).

    Messages are corrupted deterministically by ``event_id % 20`` so that every
    validation rule fires; every event still yields exactly one message.
    """
    return messages_from(table(spark, sf_dir, "events"))


def messages_from(ev: DataFrame) -> DataFrame:
    """``messages`` over any events frame, batch or streaming."""
    pid = F.col("user_id").cast("string")
    ts = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z"))
    val = F.col("value").cast("string")
    ch = F.col("event_type")

    def msg(pid_part, ts_part, src, channels, extra=F.lit("")):
        return F.concat(F.lit("{"), pid_part, F.lit('"timestamp": '), _json_str(ts_part), F.lit(', "source": '), _json_str(F.lit(src)),
                        F.lit(', "channels": '), channels, extra, F.lit("}"))

    pid_part = F.concat(F.lit('"patient_id": '), _json_str(pid), F.lit(", "))
    obj = F.concat(F.lit("{"), _json_str(ch), F.lit(": "), val, F.lit("}"))
    valid = msg(pid_part, ts, "iot_sensor", obj)
    k = F.col("event_id") % 20
    raw = (F.when(k == 0, F.expr("substring(_valid, 1, length(_valid) - 1)"))
           .when(k == 1, msg(F.lit(""), ts, "iot_sensor", obj))
           .when(k == 2, msg(pid_part, ts, "bogus", obj))
           .when(k == 3, msg(pid_part, ts, "iot_sensor", F.concat(F.lit("{"), _json_str(ch), F.lit(": "), _json_str(val), F.lit("}"))))
           .when(k == 4, msg(pid_part, ts, "iot_sensor", obj, F.concat(F.lit(', "note": '), _json_str(F.repeat(F.lit("x"), 5000)))))
           .when(k == 5, msg(pid_part, ts, "iot_sensor", F.concat(F.lit("["), val, F.lit("]"))))
           .when(k == 6, msg(pid_part, F.lit(""), "iot_sensor", obj))
           .when(k == 7, F.concat(F.lit("["), F.col("_valid"), F.lit("]")))
           .when(k == 8, msg(pid_part, ts, "iot_sensor", F.concat(F.lit("{"), _json_str(ch), F.lit(": true}"))))
           .when(k == 9, msg(F.concat(F.lit('"patient_id": "", ')), ts, "iot_sensor", obj))
           .otherwise(F.col("_valid")))
    return ev.withColumn("_valid", valid).select(
        F.col("event_id").alias("message_id"), F.concat(F.lit("icu/"), pid, F.lit("/vitals")).alias("topic"),
        raw.alias("value"), F.col("ts").alias("arrival_ts"))


def audit_logs(spark: SparkSession, sf_dir: str, alerts: DataFrame) -> DataFrame:
    """Audit rows derived from predictions, raised alerts and acknowledgements.

    Acknowledgements of Critical alerts are made by the owner named after the
    patient's region, so some rows are visible through the actor match only.
    """
    preds = predictions(spark, sf_dir)
    pr = preds.select(F.concat(F.lit("prediction:"), F.col("id").cast("string")).alias("id"), F.lit("system").alias("actor"),
                      F.lit("prediction_run").alias("action"), F.col("patient_id").alias("details_patient_id"),
                      F.col("created_at").alias("timestamp"))
    al = alerts.select(F.concat(F.lit("alert:"), F.col("id").cast("string")).alias("id"), F.lit("system").alias("actor"),
                       F.lit("alert_dispatched").alias("action"), F.col("patient_id").alias("details_patient_id"),
                       F.col("created_at").alias("timestamp"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("patient_id"), "n_regionkey")
    ack = alerts.filter(F.col("risk_level") == "Critical").join(region, "patient_id").select(
        F.concat(F.lit("ack:"), F.col("id").cast("string")).alias("id"),
        F.concat(F.lit("owner_"), F.col("n_regionkey").cast("string")).alias("actor"),
        F.lit("alert_acknowledged").alias("action"), F.col("patient_id").alias("details_patient_id"),
        (F.col("created_at") + F.expr("INTERVAL 10 MINUTES")).alias("timestamp"))
    return pr.unionByName(al).unionByName(ack)


# Stand-in candidate labels for the coded-event source (item labels are part
# types). Lower/upper case differ on purpose (case-insensitive match); the
# exact label "STANDARD" plays the Fahrenheit item.
CHART_CANDIDATES = {"HR": ["economy"], "Temp": ["standard", "large"], "SBP": ["promo"], "MAP": ["no such label"]}
LAB_CANDIDATES = {"Glucose": ["medium"], "Lactate": ["small"], "HR": ["large"], "WBC": ["no such label"]}
FAHRENHEIT_STANDIN = "STANDARD"
