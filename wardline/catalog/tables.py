"""Registered keyed-table queries (D, E, G5/G6, L, J1/J2, B9, M7, M8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline import vocab
from wardline.catalog import sql as S
from wardline.catalog.alerts import cooldown_sql
from wardline.catalog.registry import r6, register, round_doubles
from wardline.operators import alerts as alerting, messages, series, tables
from wardline.plans import report
from wardline.session import reliable_checkpoint
from wardline.sources import standin
from wardline.sources.standin import CHANNELS as CH

KEY = "patient_id"
VIT = list(standin.VITAL_STANDIN)
ALERTS30 = [*S.PRED, *cooldown_sql(30), "al AS (SELECT patient_id, id, created_at, risk_level, sepsis_probability FROM fold WHERE raised)"]


def _vitals_flat(spark, d):
    v = standin.vitals(spark, d)
    return v.select("id", KEY, F.col("timestamp").alias("ts"), *[F.col(f"channels.{c}").alias(c) for c in VIT])


def _alerts(spark, d):
    # raised alerts are small and read by several branches (audit rows, acknowledgements, counts)
    return reliable_checkpoint(alerting.cooldown_alerts(standin.predictions(spark, d), 30, carry=["sepsis_probability"]))


@register("latest_vitals", S.with_(*S.VITALS) + "SELECT patient_id, id, ts, " + ", ".join(S.q(c) for c in VIT)
          + " FROM vit QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC) = 1")
def latest_vitals(spark, d):
    return tables.latest_per_key(_vitals_flat(spark, d), KEY, ["ts", "id"])


@register("latest_prediction", S.with_(*S.PRED) + "SELECT patient_id, id, created_at, round(sepsis_probability, 6) AS sepsis_probability, "
          "risk_level FROM preds QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) = 1")
def latest_prediction(spark, d):
    p = standin.predictions(spark, d).select(KEY, "id", "created_at", "sepsis_probability", "risk_level")
    return round_doubles(tables.latest_per_key(p, KEY, ["created_at", "id"]))


HIST_START, HIST_END, HIST_N = "2024-01-05 00:00:00", "2024-01-25 00:00:00", 50


@register("vitals_history", S.with_(*S.VITALS) + (
    "SELECT patient_id, id, ts, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC) AS INTEGER) AS rank "
    f"FROM vit WHERE ts >= TIMESTAMP '{HIST_START}' AND ts <= TIMESTAMP '{HIST_END}' QUALIFY rank <= {HIST_N}"))
def vitals_history(spark, d):
    """D1 + G6: newest 50 readings per patient inside an inclusive time range."""
    v = tables.in_range(_vitals_flat(spark, d).select("id", KEY, "ts"), "ts", HIST_START, HIST_END)
    return tables.last_n_per_key(v, KEY, ["ts", "id"], HIST_N)


@register("patient_overview", S.with_(*S.PRED, *S.PATIENTS) + (
    "SELECT p.patient_id, p.current_status, p.created_by, l.id AS latest_prediction_id, round(l.sepsis_probability, 6) AS latest_probability, "
    "l.risk_level AS latest_risk_level, l.created_at AS latest_created_at FROM pat p LEFT JOIN "
    "(SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) = 1) l USING (patient_id)"))
def patient_overview(spark, d):
    """Every patient with its latest prediction (one aggregate + one join instead of N+1 lookups)."""
    p = standin.patients(spark, d).select(KEY, "current_status", "created_by")
    pr = standin.predictions(spark, d).select(KEY, "id", "created_at", "sepsis_probability", "risk_level")
    latest = tables.latest_per_key(pr, KEY, ["created_at", "id"]).select(
        KEY, F.col("id").alias("latest_prediction_id"), r6("sepsis_probability").alias("latest_probability"),
        F.col("risk_level").alias("latest_risk_level"), F.col("created_at").alias("latest_created_at"))
    return p.join(latest, KEY, "left")


@register("alert_counts", S.with_recursive(*ALERTS30, *S.PATIENTS) + " UNION ALL ".join(
    [f"SELECT 'risk' AS kind, '{lv}' AS key, count(*) FILTER (WHERE risk_level = '{lv}') AS n FROM al" for lv in vocab.RISK_LEVELS]
    + [f"SELECT 'status', '{st}', count(*) FILTER (WHERE current_status = '{st}') FROM pat" for st in vocab.PATIENT_STATUSES]))
def alert_counts(spark, d):
    """alert counts by risk and patient counts by status, zero-filled, unknown values ignored."""
    a = tables.count_by_domain(_alerts(spark, d), "risk_level", vocab.RISK_LEVELS, "risk")
    p = tables.count_by_domain(standin.patients(spark, d), "current_status", vocab.PATIENT_STATUSES, "status")
    return a.unionByName(p)


@register("owned_alerts", S.with_recursive(*ALERTS30, *S.PATIENTS) + (
    "SELECT p.created_by AS owner, a.id, a.patient_id, a.created_at, a.risk_level FROM al a JOIN pat p USING (patient_id) "
    "WHERE a.risk_level = 'Critical'"))
def owned_alerts(spark, d):
    """E6 + D2 for every caller: Critical, unacknowledged alerts of each owner's patients."""
    al = alerting.enrich_alerts(_alerts(spark, d), F.lit(""))
    listed = tables.list_alerts(al, acknowledged=False, risk_level="Critical")
    return tables.with_owner(listed, standin.patients(spark, d)).select("owner", "id", KEY, "created_at", "risk_level")


AUDIT = [
    "reg AS (SELECT c_custkey AS patient_id, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)",
    "audit AS (SELECT 'prediction:' || CAST(id AS VARCHAR) AS id, 'system' AS actor, 'prediction_run' AS action, patient_id AS details_patient_id FROM preds "
    "UNION ALL SELECT 'alert:' || CAST(id AS VARCHAR), 'system', 'alert_dispatched', patient_id FROM al "
    "UNION ALL SELECT 'ack:' || CAST(id AS VARCHAR), 'owner_' || CAST(n_regionkey AS VARCHAR), 'alert_acknowledged', patient_id "
    "FROM al JOIN reg USING (patient_id) WHERE risk_level = 'Critical')",
]


@register("audit_scope", S.with_recursive(*ALERTS30, *S.PATIENTS, *AUDIT) + (
    "SELECT owner, action, count(*) AS n FROM (SELECT p.created_by AS owner, a.id, a.action FROM audit a JOIN pat p ON a.details_patient_id = p.patient_id "
    "UNION SELECT o.owner, a.id, a.action FROM audit a JOIN (SELECT DISTINCT created_by AS owner FROM pat) o ON a.actor = o.owner) GROUP BY 1, 2"))
def audit_scope(spark, d):
    """D3 for every caller: audit rows visible by actor or by owned patient, counted per action."""
    audit = standin.audit_logs(spark, d, _alerts(spark, d))
    vis = tables.audit_visible(audit, standin.patients(spark, d))
    return vis.groupBy("owner", "action").agg(F.count(F.lit(1)).alias("n"))


def patient_rules():
    return [tables.required("patient_id"), tables.required("created_by"),
            tables.enum("current_status", vocab.PATIENT_STATUSES), tables.enum("source_dataset", vocab.PATIENT_SOURCE_DATASETS),
            tables.in_range_rule("age", 0.0, 150.0), tables.max_length("created_by", 64)]


RULE_NAMES = ["required:patient_id", "required:created_by", "enum:current_status", "enum:source_dataset", "range:age",
              "length:created_by", "unique:patient_id"]
RULE_SQL = {
    "required:patient_id": "patient_id IS NULL", "required:created_by": "created_by IS NULL",
    "enum:current_status": "current_status IS NULL OR current_status NOT IN (" + ", ".join(f"'{s}'" for s in vocab.PATIENT_STATUSES) + ")",
    "enum:source_dataset": "source_dataset IS NULL OR source_dataset NOT IN (" + ", ".join(f"'{s}'" for s in vocab.PATIENT_SOURCE_DATASETS) + ")",
    "range:age": "coalesce(age < 0.0 OR age > 150.0, false)", "length:created_by": "coalesce(length(created_by) > 64, false)",
    "unique:patient_id": "dup > 1",
}


@register("table_rules", S.with_(*S.PATIENTS, "pv AS (SELECT *, count(*) OVER (PARTITION BY patient_id) AS dup FROM pat)") + " UNION ALL ".join(
    [f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {RULE_SQL[n]}) AS n_violations FROM pv" for n in RULE_NAMES]
    + ["SELECT 'accepted', count(*) FILTER (WHERE NOT (" + " OR ".join(f"({RULE_SQL[n]})" for n in RULE_NAMES) + ")) FROM pv"]))
def table_rules(spark, d):
    """Write-time rules on the patients table; violations counted per rule."""
    v = tables.validate(standin.patients(spark, d), patient_rules(), unique_key=KEY)
    row = v.agg(*[F.count_if(F.array_contains("violations", n)).alias(f"_{i}") for i, n in enumerate(RULE_NAMES)],
                F.count_if(F.size("violations") == 0).alias("_acc"))
    return row.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("n_violations"))
                                         for i, n in enumerate(RULE_NAMES)],
                                       F.struct(F.lit("accepted").alias("rule"), F.col("_acc").alias("n_violations")))))


@register("insert_if_absent", S.with_(*S.PATIENTS) + (
    "SELECT f.patient_id, f.created_at, 'live' AS source_dataset, 'active' AS current_status, 'ingestion_service' AS created_by "
    "FROM (SELECT user_id AS patient_id, min(ts) AS created_at FROM events GROUP BY 1) f "
    "WHERE f.patient_id NOT IN (SELECT patient_id FROM pat WHERE current_status = 'active')"))
def insert_if_absent(spark, d):
    """Provision a patient on its first message unless it already exists (existing = active patients)."""
    ev = standin.table(spark, d, "events").select(F.col("user_id").alias(KEY), F.col("ts").alias("created_at"), "event_id")
    existing = standin.patients(spark, d).filter(F.col("current_status") == "active")
    res = tables.insert_if_absent(ev, existing, KEY, ["created_at", "event_id"])
    return res.inserted.select(KEY, "created_at", F.lit("live").alias("source_dataset"), F.lit("active").alias("current_status"),
                               F.lit(vocab.INGEST_ACTOR).alias("created_by"))


@register("patch", S.with_(*S.PATIENTS, f"lo AS (SELECT o_custkey AS patient_id, {S.ORDER_STATUS_SQL} AS status, o_orderdate FROM orders "
                                                "QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)") +
          "SELECT p.patient_id, CASE WHEN lo.patient_id IS NOT NULL THEN lo.status ELSE p.current_status END AS current_status, "
          "CASE WHEN lo.patient_id IS NOT NULL THEN lo.o_orderdate ELSE p.created_at END AS updated_at FROM pat p LEFT JOIN lo USING (patient_id)")
def patch(spark, d):
    """L2: status patched from each patient's latest order; updated_at bumped on matched rows only."""
    base = standin.patients(spark, d).select(KEY, "current_status", F.col("created_at").alias("updated_at"))
    return tables.apply_patch(base, status_changes(spark, d), KEY, ["current_status"], updated_at=F.col("updated_at"))


def status_changes(spark, d):
    """Patches of a patient's status by the latest order."""
    o = standin.table(spark, d, "orders").select(F.col("o_custkey").alias(KEY), "o_orderstatus", "o_orderdate", "o_orderkey")
    last = tables.latest_per_key(o, KEY, ["o_orderdate", "o_orderkey"])
    status = F.coalesce(*[F.when(F.col("o_orderstatus") == k, F.lit(v)) for k, v in standin.STATUS_BY_ORDER.items()])
    return last.select(KEY, status.alias("current_status"), F.col("o_orderdate").alias("updated_at"),
                       F.array(F.lit("current_status")).alias("set_fields"))


@register("delete_by_key", S.with_(*S.PATIENTS) + (
    "SELECT patient_id, current_status FROM pat WHERE patient_id NOT IN "
    "(SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F')"))
def delete_by_key(spark, d):
    """L3: delete patients named by a key table (customers with a finished urgent order)."""
    return tables.delete_by_key(standin.patients(spark, d).select(KEY, "current_status"), discharged_keys(spark, d), KEY)


def discharged_keys(spark, d):
    """Patients with a finished urgent order."""
    return standin.table(spark, d, "orders").filter((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "F")) \
        .select(F.col("o_custkey").alias(KEY))


@register("acknowledge", S.with_recursive(*ALERTS30, *S.PATIENTS) + (
    "SELECT a.id, a.patient_id, a.risk_level, k.id IS NOT NULL AS acknowledged, k.by AS acknowledged_by, k.at AS acknowledged_at "
    "FROM al a LEFT JOIN (SELECT pr.id, p.created_by AS by, pr.created_at + INTERVAL 10 MINUTE AS at FROM preds pr JOIN pat p USING (patient_id) "
    "WHERE pr.risk_level = 'Critical') k ON a.id = k.id"))
def acknowledge(spark, d):
    """L4: owners acknowledge every Critical prediction 10 minutes later; only ids that are alerts match."""
    al = alerting.enrich_alerts(_alerts(spark, d), F.lit(""))
    out = tables.acknowledge(al, owner_acks(spark, d))
    return out.select("id", KEY, "risk_level", "acknowledged", "acknowledged_by", "acknowledged_at")


def owner_acks(spark, d):
    """Acknowledgements of Critical predictions by the patients' owners."""
    pr = standin.predictions(spark, d).filter(F.col("risk_level") == "Critical")
    return tables.with_owner(pr, standin.patients(spark, d)).select(
        "id", F.col("owner").alias("acknowledged_by"), (F.col("created_at") + F.expr("INTERVAL 10 MINUTES")).alias("acknowledged_at"))


_JS = lambda c: f"'\"' || {c} || '\"'"


def _msg_sql(pid_part, ts_part, src, channels, extra="''"):
    return (f"'{{' || {pid_part} || '\"timestamp\": ' || {_JS(ts_part)} || ', \"source\": ' || {_JS(repr(src))} || "
            f"', \"channels\": ' || {channels} || {extra} || '}}'")


_PID = "'\"patient_id\": ' || " + _JS("CAST(user_id AS VARCHAR)") + " || ', '"
_TS = "strftime(ts, '%Y-%m-%dT%H:%M:%S') || 'Z'"
_OBJ = "'{' || " + _JS("event_type") + " || ': ' || CAST(value AS VARCHAR) || '}'"
MSGS = [
    f"mv AS (SELECT *, {_msg_sql(_PID, _TS, 'iot_sensor', _OBJ)} AS valid FROM events)",
    "msgs AS (SELECT event_id AS message_id, 'icu/' || CAST(user_id AS VARCHAR) || '/vitals' AS topic, CASE event_id % 20 "
    "WHEN 0 THEN substring(valid, 1, length(valid) - 1) "
    f"WHEN 1 THEN {_msg_sql(repr(''), _TS, 'iot_sensor', _OBJ)} "
    f"WHEN 2 THEN {_msg_sql(_PID, _TS, 'bogus', _OBJ)} "
    f"WHEN 3 THEN {_msg_sql(_PID, _TS, 'iot_sensor', chr(39) + '{' + chr(39) + ' || ' + _JS('event_type') + ' || ' + chr(39) + ': ' + chr(39) + ' || ' + _JS('CAST(value AS VARCHAR)') + ' || ' + chr(39) + '}' + chr(39))} "
    f"WHEN 4 THEN {_msg_sql(_PID, _TS, 'iot_sensor', _OBJ, chr(39) + ', \"note\": ' + chr(39) + ' || ' + _JS('repeat(' + chr(39) + 'x' + chr(39) + ', 5000)'))} "
    f"WHEN 5 THEN {_msg_sql(_PID, _TS, 'iot_sensor', chr(39) + '[' + chr(39) + ' || CAST(value AS VARCHAR) || ' + chr(39) + ']' + chr(39))} "
    f"WHEN 6 THEN {_msg_sql(_PID, repr(''), 'iot_sensor', _OBJ)} "
    "WHEN 7 THEN '[' || valid || ']' "
    f"WHEN 8 THEN {_msg_sql(_PID, _TS, 'iot_sensor', chr(39) + '{' + chr(39) + ' || ' + _JS('event_type') + ' || ' + chr(39) + ': true}' + chr(39))} "
    f"WHEN 9 THEN {_msg_sql(chr(39) + '\"patient_id\": \"\", ' + chr(39), _TS, 'iot_sensor', _OBJ)} "
    "ELSE valid END AS raw FROM mv)",
]


def _truthy_sql(path):
    t = f"json_type(raw, '{path}')"
    return (f"(CASE WHEN {t} IS NULL OR {t} = 'NULL' THEN false WHEN {t} = 'VARCHAR' THEN json_extract_string(raw, '{path}') <> '' "
            f"WHEN {t} = 'BOOLEAN' THEN json_extract_string(raw, '{path}') = 'true' WHEN {t} = 'ARRAY' THEN json_array_length(raw, '{path}') > 0 "
            f"WHEN {t} = 'OBJECT' THEN len(json_keys(raw, '{path}')) > 0 ELSE CAST(json_extract_string(raw, '{path}') AS DOUBLE) <> 0 END)")


_SRC_LIST = ", ".join(f"'{s}'" for s in vocab.VITALS_SOURCES)
_BADKEYS = ("list_filter(json_keys(raw, '$.channels'), lambda k: json_type(raw, '$.channels.' || k) NOT IN "
            "('BIGINT', 'UBIGINT', 'DOUBLE', 'BOOLEAN', 'NULL', 'HUGEINT'))")
VALID = MSGS + [
    "jv AS (SELECT message_id, topic, raw, json_valid(raw) AS ok FROM msgs)",
    "vr AS (SELECT message_id, topic, CASE "
    f"WHEN strlen(raw) > {vocab.MAX_PAYLOAD_BYTES} THEN '{vocab.REJECT_TOO_LARGE}' "
    f"WHEN NOT ok OR json_type(raw) <> 'OBJECT' THEN '{vocab.REJECT_NOT_JSON}' "
    f"WHEN NOT {_truthy_sql('$.patient_id')} THEN '{vocab.REJECT_NO_PATIENT}' "
    f"WHEN NOT {_truthy_sql('$.timestamp')} THEN '{vocab.REJECT_NO_TIMESTAMP}' "
    f"WHEN coalesce(json_type(raw, '$.source'), '') <> 'VARCHAR' OR json_extract_string(raw, '$.source') NOT IN ({_SRC_LIST}) "
    f"THEN '{vocab.REJECT_BAD_SOURCE.replace(chr(39), chr(39) * 2)}' "
    f"WHEN coalesce(json_type(raw, '$.channels'), '') <> 'OBJECT' THEN '{vocab.REJECT_CHANNELS_NOT_OBJECT}' "
    f"WHEN len({_BADKEYS}) > 0 THEN 'channel ''' || {_BADKEYS}[1] || ''' must be a number or null, got ' || "
    f"CASE json_type(raw, '$.channels.' || {_BADKEYS}[1]) WHEN 'VARCHAR' THEN 'str' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'dict' "
    f"ELSE lower(json_type(raw, '$.channels.' || {_BADKEYS}[1])) END "
    "END AS reason FROM jv)",
]


def _validated(spark, d):
    return messages.validate_messages(standin.messages(spark, d), "value", "topic")


@register("message_validation", S.with_(*VALID) + "SELECT message_id, topic, reason IS NULL AS accepted, reason FROM vr")
def message_validation(spark, d):
    return _validated(spark, d).select("message_id", "topic", "accepted", "reason")


@register("dead_letters", S.with_(*VALID) + (
    f"SELECT message_id, '{vocab.INGEST_ACTOR}' AS actor, 'vitals_rejected' AS action, 'mqtt_message' AS target_type, topic, reason "
    "FROM vr WHERE reason IS NOT NULL"))
def dead_letters(spark, d):
    return messages.dead_letters(_validated(spark, d))


@register("topic_payload", S.with_(*S.RW) + (
    "SELECT patient_id, \"ICULOS\", 'icu/' || CAST(patient_id AS VARCHAR) || '/vitals' AS topic, to_json(struct_pack("
    "patient_id := CAST(patient_id AS VARCHAR), "
    "timestamp := strftime(first(hr) OVER (PARTITION BY patient_id ORDER BY \"ICULOS\" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) "
    "+ to_hours(CAST(row_number() OVER (PARTITION BY patient_id ORDER BY \"ICULOS\") - 1 AS BIGINT)), '%Y-%m-%dT%H:%M:%S') || '+00:00', "
    "source := 'physionet_sim', channels := struct_pack(" + ", ".join(f"{S.q(c)} := CAST({S.q(c)} AS DOUBLE)" for c in CH)
    + "))) AS value FROM rw"))
def topic_payload(spark, d):
    """B9 + C12: reading rows encoded as per-patient vitals messages."""
    return messages.encode_payloads(standin.readings_wide(spark, d), CH)


def _report_sql():
    ctes = [*ALERTS30, *S.PATIENTS, *S.VITALS,
            "lp AS (SELECT patient_id, count(*) AS n_predictions, max(sepsis_probability) AS max_probability, "
            "arg_max(sepsis_probability, (created_at, id)) AS latest_probability, arg_max(risk_level, (created_at, id)) AS latest_risk_level, "
            "max(created_at) AS latest_at FROM preds GROUP BY 1)",
            "rr AS (SELECT patient_id, string_agg(risk_level, ',' ORDER BY created_at DESC, id DESC) AS recent_risk_levels FROM "
            "(SELECT * FROM preds QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY created_at DESC, id DESC) <= 12) GROUP BY 1)",
            "la AS (SELECT patient_id, count(*) AS n_alerts, max(created_at) AS last_alert_at FROM al GROUP BY 1)",
            "lv AS (SELECT * FROM vit QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY ts DESC, id DESC) = 1)"]
    vit_txt = ", ".join(f"coalesce(printf('%.1f', lv.{S.q(c)}), '--') AS {S.q(c + '_text')}" for c in VIT)
    return S.with_recursive(*ctes) + (
        "SELECT p.patient_id, p.current_status, p.created_by, coalesce(lp.n_predictions, 0) AS n_predictions, "
        "round(lp.latest_probability, 6) AS latest_probability, lp.latest_risk_level, "
        "coalesce(strftime(lp.latest_at, '%Y-%m-%d %H:%M UTC'), '--') AS latest_at_text, round(lp.max_probability, 6) AS max_probability, "
        "coalesce(la.n_alerts, 0) AS n_alerts, coalesce(strftime(la.last_alert_at, '%Y-%m-%d %H:%M UTC'), '--') AS last_alert_at_text, "
        f"rr.recent_risk_levels, {vit_txt} "
        "FROM pat p LEFT JOIN lp USING (patient_id) LEFT JOIN la USING (patient_id) LEFT JOIN rr USING (patient_id) LEFT JOIN lv USING (patient_id)")


def _ids(src, ts, n, name):
    return (f"{name} AS (SELECT patient_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY {ts} DESC, id DESC) AS ids FROM (SELECT * FROM {src} "
            f"QUALIFY row_number() OVER (PARTITION BY patient_id ORDER BY {ts} DESC, id DESC) <= {n}) GROUP BY 1)")


@register("patient_document", S.with_recursive(*ALERTS30, *S.PATIENTS, *S.VITALS, _ids("vit", "ts", 12, "dv"), _ids("preds", "created_at", 12, "dp"),
                                               _ids("al", "created_at", 12, "da"),
                                               "lp AS (SELECT patient_id, arg_max(id, (created_at, id)) AS id FROM preds GROUP BY 1)")
          + "SELECT p.patient_id, p.current_status, dv.ids AS vitals, dp.ids AS predictions, da.ids AS alerts, e.event_type AS explanation FROM pat p "
            "LEFT JOIN dv USING (patient_id) LEFT JOIN dp USING (patient_id) LEFT JOIN da USING (patient_id) LEFT JOIN lp USING (patient_id) "
            "LEFT JOIN (SELECT * FROM events WHERE event_type <> 'signup') e ON e.event_id = lp.id")
def patient_document(spark, d):
    """Nested document per patient with lists of 12 and the latest explanation (ids shown)."""
    expl = standin.table(spark, d, "events").filter("event_type <> 'signup'").select(F.col("event_id").alias("prediction_id"), F.col("event_type").alias("top"))
    doc = report.patient_document(standin.patients(spark, d).select("patient_id", "current_status"), _vitals_flat(spark, d),
                                  standin.predictions(spark, d), _alerts(spark, d), expl, 12, 12, 12)
    ids = lambda c: F.array_join(F.transform(c, lambda r: r["id"].cast("string")), ",").alias(c)
    return doc.select("patient_id", "current_status", ids("vitals"), ids("predictions"), ids("alerts"), F.col("explanation.top").alias("explanation"))


@register("patient_report", _report_sql())
def patient_report(spark, d):
    """One row per patient; every side pre-aggregated to one row per patient, then left-joined."""
    return report.patient_report(standin.patients(spark, d), standin.predictions(spark, d), _alerts(spark, d),
                                 _vitals_flat(spark, d), VIT, 12)


@register("urgent_alerts", S.with_recursive(*ALERTS30) + (
    "SELECT id, patient_id, created_at, risk_level FROM al WHERE risk_level IN ('High', 'Critical') "
    "ORDER BY created_at DESC, id DESC LIMIT 15"))
def urgent_alerts(spark, d):
    """D12 + H6: the 15 newest urgent, unacknowledged alerts (a bounded list is the feature)."""
    al = alerting.enrich_alerts(_alerts(spark, d), F.lit(""))
    _, urgent = report.unit_overview(standin.patients(spark, d), al, 15)
    return urgent.select("id", KEY, "created_at", "risk_level")


@register("probability_trend", S.with_(*S.PRED) + (
    "SELECT patient_id, id, created_at, round(sepsis_probability, 6) AS sepsis_probability, risk_level, "
    "round(sepsis_probability - lag(sepsis_probability) OVER (PARTITION BY patient_id ORDER BY created_at, id), 6) AS delta FROM preds"))
def probability_trend(spark, d):
    """Ascending probability trend per patient with the step change."""
    p = standin.predictions(spark, d).select(KEY, "id", "created_at", "sepsis_probability", "risk_level")
    return round_doubles(series.probability_trend(p))


@register("patient_timeseries", S.with_(*S.RW, "prof AS (SELECT patient_id, count(*) AS n_rows, max(\"SepsisLabel\") AS ever_positive FROM rw GROUP BY 1)",
                                        "ex AS (SELECT patient_id FROM (SELECT *, row_number() OVER (PARTITION BY ever_positive ORDER BY patient_id) AS rk "
                                        "FROM prof WHERE n_rows >= 20) WHERE rk <= 2)") + (
    "SELECT patient_id, \"ICULOS\", channel, value FROM (UNPIVOT (SELECT patient_id, \"ICULOS\", " + ", ".join(S.q(c) for c in CH)
    + " FROM rw WHERE patient_id IN (SELECT patient_id FROM ex)) ON " + ", ".join(S.q(c) for c in CH) + " INTO NAME channel VALUE value)"))
def patient_timeseries(spark, d):
    """G14 (+ G8 selection): tall, time-ordered series of the example patients."""
    from wardline.operators import eda
    rw = standin.readings_wide(spark, d)
    ex = eda.example_entities(rw, KEY, "SepsisLabel", 2, 20)
    return series.timeseries(rw, ex, KEY, "ICULOS", CH)


@register("unit_overview", S.with_recursive(*ALERTS30, *S.PATIENTS) + (
    "SELECT 'n_patients' AS metric, count(*) AS value FROM pat "
    "UNION ALL SELECT 'n_active', count(*) FILTER (WHERE current_status = 'active') FROM pat "
    "UNION ALL SELECT 'n_alerts', count(*) FROM al "
    "UNION ALL SELECT 'n_urgent_unacknowledged', count(*) FILTER (WHERE risk_level IN ('High', 'Critical')) FROM al "
    "UNION ALL SELECT 'n_patients_with_alerts', count(DISTINCT patient_id) FROM al "
    "UNION ALL SELECT 'n_owners', count(DISTINCT created_by) FROM pat"))
def unit_overview(spark, d):
    """M8 KPI row set."""
    pat = standin.patients(spark, d)
    al = alerting.enrich_alerts(_alerts(spark, d), F.lit(""))
    p = pat.agg(F.count(F.lit(1)).alias("n_patients"), F.count_if(F.col("current_status") == "active").alias("n_active"),
                F.countDistinct("created_by").alias("n_owners"))
    urgent = F.col("risk_level").isin("High", "Critical") & ~F.col("acknowledged")
    a = al.agg(F.count(F.lit(1)).alias("n_alerts"), F.count_if(urgent).alias("n_urgent_unacknowledged"),
               F.countDistinct(KEY).alias("n_patients_with_alerts"))
    stack = lambda df, names: df.select(F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("long").alias("value")) for n in names])))
    return stack(p, ["n_patients", "n_active", "n_owners"]).unionByName(stack(a, ["n_alerts", "n_urgent_unacknowledged", "n_patients_with_alerts"]))


USERS_SQL = [*S.PATIENTS, "usr AS (SELECT DISTINCT created_by AS username FROM pat)"]


@register("users_listing", S.with_(*USERS_SQL) + "SELECT username FROM usr ORDER BY username LIMIT 10")
def users_listing(spark, d):
    """H5: users by username ascending, limited (users = patient owners)."""
    u = standin.patients(spark, d).select(F.col("created_by").alias("username")).distinct()
    return u.orderBy("username").limit(10)


@register("user_last_login", S.with_(*USERS_SQL, *S.PRED[0:2]) + (
    "SELECT u.username, max(pr.created_at) AS last_login FROM usr u LEFT JOIN pat p ON p.created_by = u.username "
    "LEFT JOIN preds pr ON pr.patient_id = p.patient_id GROUP BY 1"))
def user_last_login(spark, d):
    """Last activity per user (latest prediction on an owned patient) patched onto the users table."""
    pat = standin.patients(spark, d)
    users = pat.select(F.col("created_by").alias("username")).distinct()
    act = standin.predictions(spark, d).join(pat.select(KEY, F.col("created_by").alias("username")), KEY) \
        .select("username", F.col("created_at").alias("ts"))
    return series.touch_last_login(users, act)


@register("ingest_sequence", S.with_(*S.VITALS) + "SELECT id, patient_id, "
          "CAST(row_number() OVER (PARTITION BY patient_id ORDER BY ts, id) - 1 AS BIGINT) AS ingest_seq FROM vit")
def ingest_sequence(spark, d):
    """0-based monotone sequence per patient over the stored readings."""
    v = _vitals_flat(spark, d).select("id", KEY, "ts")
    return series.sequence_index(v, KEY, ["ts", "id"]).select("id", KEY, "ingest_seq")


_VOCAB_SQL = ", ".join(f"'{c}'" for c in vocab.CLINICAL_CHANNELS)


@register("unknown_channels", S.with_(*MSGS) + (
    "SELECT channel, count(*) AS n_messages FROM (SELECT unnest(json_keys(raw, '$.channels')) AS channel FROM msgs "
    "WHERE json_valid(raw) AND json_type(raw) = 'OBJECT' AND json_type(raw, '$.channels') = 'OBJECT') "
    f"WHERE channel NOT IN ({_VOCAB_SQL}) GROUP BY 1"))
def unknown_channels(spark, d):
    """Channel names outside the canonical vocabulary, counted over all messages."""
    m = standin.messages(spark, d)
    keys = F.map_keys(F.try_variant_get(F.try_parse_json(F.col("value")), "$.channels", "map<string,variant>"))
    unk = tables.unknown_channels(F.map_from_arrays(keys, keys), vocab.CLINICAL_CHANNELS)
    return m.select(F.explode(unk).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("n_messages"))


@register("patients_listing", S.with_(*S.PATIENTS) + (
    "SELECT patient_id, created_by FROM pat WHERE current_status = 'active' ORDER BY patient_id LIMIT 20"))
def patients_listing(spark, d):
    """Patients by status (ordered for determinism), limited — the bounded list is the feature."""
    return tables.list_patients(standin.patients(spark, d), status="active", limit=20).select(KEY, "created_by")
