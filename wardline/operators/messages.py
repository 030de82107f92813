"""Message validation and encoding.

Validation works on the raw text with Spark's VARIANT functions: one
projection computes the first failing rule as a ``reason`` column; a
message never fails the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical

_NUMERIC = ("BIGINT", "INT", "SMALLINT", "TINYINT", "DOUBLE", "FLOAT", "DECIMAL", "BOOLEAN")


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def _is_accepted_value(v: Column) -> Column:
    """number, boolean (a Python bool is an int, Q5) or JSON null."""
    k = _kind(v)
    return F.is_variant_null(v) | F.greatest(*[k.startswith(t) for t in _NUMERIC])


def _truthy(v: Column) -> Column:
    """Python truthiness of a JSON value; missing counts as false."""
    k = _kind(v)
    return (F.when(v.isNull() | F.is_variant_null(v), F.lit(False))
            .when(k == "STRING", F.try_variant_get(v, "$", "string") != "")
            .when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean"))
            .when(k.startswith("ARRAY"), F.size(F.try_variant_get(v, "$", "array<variant>")) > 0)
            .when(k.startswith("OBJECT"), k != "OBJECT<>")
            .otherwise(F.coalesce(F.try_variant_get(v, "$", "double") != 0, F.lit(True))))


def _python_type(v: Column) -> Column:
    k = _kind(v)
    return F.when(k == "STRING", "str").when(k.startswith("ARRAY"), "list").when(k.startswith("OBJECT"), "dict").otherwise(F.lower(k))


def _reason_from(v: Column, raw_len: Column, max_bytes: int, sources: Sequence[str]) -> Column:
    is_obj = _kind(v).startswith("OBJECT")
    pid = F.try_variant_get(v, "$.patient_id", "variant")
    ts = F.try_variant_get(v, "$.timestamp", "variant")
    src = F.try_variant_get(v, "$.source", "string")
    src_kind = _kind(F.try_variant_get(v, "$.source", "variant"))
    ch = F.try_variant_get(v, "$.channels", "variant")
    entries = F.map_entries(F.try_variant_get(v, "$.channels", "map<string,variant>"))
    bad = F.filter(entries, lambda e: ~_is_accepted_value(e["value"]))
    first_bad = F.element_at(bad, 1)
    bad_text = F.concat(F.lit("channel '"), first_bad["key"], F.lit("' must be a number or null, got "),
                        _python_type(first_bad["value"]))
    return (F.when(raw_len > max_bytes, F.lit(vocab.REJECT_TOO_LARGE))
            .when(v.isNull() | ~is_obj, F.lit(vocab.REJECT_NOT_JSON))
            .when(~_truthy(pid), F.lit(vocab.REJECT_NO_PATIENT))
            .when(~_truthy(ts), F.lit(vocab.REJECT_NO_TIMESTAMP))
            .when(src.isNull() | (src_kind != "STRING") | ~src.isin(list(sources)), F.lit(vocab.REJECT_BAD_SOURCE))
            .when(ch.isNull() | ~_kind(ch).startswith("OBJECT"), F.lit(vocab.REJECT_CHANNELS_NOT_OBJECT))
            .when(F.size(bad) > 0, bad_text))


def rejection_reason(raw: Column, max_bytes: int = vocab.MAX_PAYLOAD_BYTES,
                     sources: Sequence[str] = vocab.VITALS_SOURCES) -> Column:
    """Ordered rules; the first failure is the reason, null when accepted.

    Object keys inside a VARIANT are stored sorted, so with several bad
    channels the one reported is the first in key order.
    """
    return _reason_from(F.try_parse_json(raw), F.octet_length(raw), max_bytes, sources)


def validate_messages(msgs: DataFrame, raw: str = "value", topic: str | None = "topic",
                      max_bytes: int = vocab.MAX_PAYLOAD_BYTES, sources: Sequence[str] = vocab.VITALS_SOURCES,
                      vocabulary: Sequence[str] | None = None, decode: Sequence[str] | None = None) -> DataFrame:
    """Adds ``reason`` and ``accepted``; topics outside ``icu/+/vitals`` are not subscribed.
    With ``vocabulary`` a message with an unknown channel is rejected as well (D9).
    With ``decode``, names of channels, the values of the message are added from the same parse.

    The payload is parsed once into a staged column that every rule reads
    (rules inside CASE branches would otherwise parse it again).
    """
    df = msgs
    if topic is not None:
        df = df.filter(F.col(topic).rlike(vocab.VITALS_TOPIC_FILTER_REGEX))
    staged = df.withColumn("_v", F.try_parse_json(F.col(raw)))
    reason = _reason_from(F.col("_v"), F.octet_length(F.col(raw)), max_bytes, sources)
    if vocabulary is not None:
        names = F.map_keys(F.try_variant_get(F.col("_v"), "$.channels", "map<string,variant>"))
        unknown = F.array_sort(F.array_except(names, F.array(*[F.lit(c) for c in vocabulary])))
        reason = F.coalesce(reason, F.when(F.size(unknown) > 0, F.concat(
            F.lit("unknown channel '"), F.get(unknown, F.lit(0)), F.lit("'"))))
    out = staged.withColumn("reason", reason)
    if decode is not None:
        out = out.select("*", *_values(F.col("_v"), decode), _topic_patient(out, topic))
    return out.drop("_v").withColumn("accepted", F.col("reason").isNull())


def _values(v: Column, channels: Sequence[str]) -> list[Column]:
    """Patient, time, source and channels (as doubles; booleans as 1/0) of a parsed message."""
    return [F.try_variant_get(v, "$.patient_id", "string").alias("patient_id"),
            F.try_to_timestamp(F.try_variant_get(v, "$.timestamp", "string")).alias("timestamp"),
            F.try_variant_get(v, "$.source", "string").alias("source"),
            F.struct(*[F.try_variant_get(v, f"$.channels.{c}", "double").alias(c) for c in channels]).alias("channels")]


def _topic_patient(df: DataFrame, topic: str | None) -> Column:
    return (clinical.topic_patient(F.col(topic)) if topic in df.columns else F.lit(None).cast("string")).alias("topic_patient")


def payload_patient(raw: Column) -> Column:
    """The patient id inside a message, null when the message can't be read."""
    return F.try_variant_get(F.try_parse_json(raw), "$.patient_id", "string")


def decode_accepted(validated: DataFrame, channels: Sequence[str], raw: str = "value") -> DataFrame:
    """Typed reading rows from accepted messages (channels as doubles; booleans as 1/0)."""
    base = validated.drop("patient_id", "timestamp", "source", "channels", "topic_patient").filter("accepted")
    return base.select("*", *_values(F.parse_json(F.col(raw)), channels), _topic_patient(base, "topic"))


def dead_letters(validated: DataFrame, id_col: str = "message_id", topic: str = "topic", ts: Column | None = None) -> DataFrame:
    """Rejected messages as audit rows."""
    return validated.filter(~F.col("accepted")).select(
        F.col(id_col), F.lit(vocab.INGEST_ACTOR).alias("actor"), F.lit("vitals_rejected").alias("action"),
        F.lit("mqtt_message").alias("target_type"), F.col(topic).alias("topic"), F.col("reason"),
        *( [ts.alias("timestamp")] if ts is not None else []))


def encode_payloads(readings: DataFrame, channels: Sequence[str], key: str = "patient_id", order: str = "ICULOS",
                    admission: Column | None = None, source: str = "physionet_sim", time_col: str = "hr") -> DataFrame:
    """One JSON payload per reading row; timestamp = admission + row index hours; missing → explicit null.

    ``admission`` defaults to the entity's first reading time (``time_col``).
    """
    w = Window.partitionBy(key).orderBy(order)
    adm = admission if admission is not None else F.first(time_col).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    idx = F.row_number().over(w) - 1
    staged = readings.select(key, order, adm.alias("_adm"), idx.alias("_idx"), *channels)
    ts = F.col("_adm") + F.make_interval(hours=F.col("_idx").cast("int"))
    payload = F.struct(F.col(key).cast("string").alias("patient_id"),
                       F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")).alias("timestamp"),
                       F.lit(source).alias("source"),
                       F.struct(*[F.col(c).cast("double").alias(c) for c in channels]).alias("channels"))
    return staged.select(key, order, clinical.vitals_topic(F.col(key)).alias("topic"),
                         F.to_json(payload, {"ignoreNullFields": "false"}).alias("value"))
