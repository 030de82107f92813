"""Streaming jobs (M6): source → validate → state → score → alert → sinks.

Sinks use ``foreachBatch`` with the batch id in the output path, so a
re-executed micro-batch overwrites its own output instead of duplicating it.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators import messages, tables
from wardline.session import checkpoint_dir
from wardline.sources import files
from wardline.sources.tables import table_or_empty
from wardline.streaming.state import typed_state


def run_available(query_df: DataFrame, out_path: str, ckpt: str, fmt: str = "parquet", mode: str = "append",
                  partition_by: Sequence[str] = ()) -> None:
    """Run a streaming DataFrame over everything currently available, then stop."""
    with typed_state(query_df.sparkSession):
        writer = query_df.writeStream.partitionBy(*partition_by) if partition_by else query_df.writeStream
        q = (writer.format(fmt).option("path", out_path).option("checkpointLocation", ckpt)
             .outputMode(mode).trigger(availableNow=True).start())
        q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def stream_dirs(spark: SparkSession, name: str) -> tuple[str, str]:
    base = os.path.join(checkpoint_dir(spark), "streams", name)
    return os.path.join(base, "out"), os.path.join(base, "checkpoint")


def events_as_readings(events: DataFrame, channels: Sequence[str]) -> DataFrame:
    """One event = one reading message with a single channel set (stand-in stream)."""
    return events.select(F.col("user_id").alias("patient_id"), F.col("event_id").alias("message_id"),
                         F.col("ts").cast("timestamp").alias("timestamp"),
                         *[F.when(F.col("event_type") == c, F.col("value")).alias(c) for c in channels])


def rejected_sink(rejected_path: str, patients_path: str | None = None) -> Callable:
    """J2 + J3 foreachBatch sink: dead letters and auto-provisioned patients (payload ids)."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        files.append_batch(messages.dead_letters(batch, "message_id"), rejected_path, batch_id)
        if patients_path is None:
            return
        spark = batch.sparkSession
        ids = batch.filter("accepted").select("patient_id", F.col("arrival_ts").alias("created_at"), "message_id")
        # only earlier batches count: a replayed batch must reproduce its own output
        existing = table_or_empty(spark, patients_path, "patient_id string, batch_id long").filter(F.col("batch_id") < batch_id).select("patient_id")
        res = tables.insert_if_absent(ids, existing, "patient_id", ["created_at", "message_id"])
        new = res.inserted.select("patient_id", "created_at", F.lit("live").alias("source_dataset"),
                                  F.lit("active").alias("current_status"), F.lit(vocab.INGEST_ACTOR).alias("created_by"))
        files.append_batch(new, patients_path, batch_id)

    return sink


def run_batches(stream: DataFrame, sink: Callable[[DataFrame, int], None], ckpt: str) -> None:
    """Hand every micro-batch of what is available to ``sink``, then stop."""
    with typed_state(stream.sparkSession):
        q = stream.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()


def ingest(spark: SparkSession, messages_df: DataFrame, name: str = "ingest", base: str | None = None,
           vocabulary: Sequence[str] | None = None, channels: Sequence[str] = vocab.CLINICAL_CHANNELS) -> dict:
    """Validate a message stream once and derive accepted rows, dead letters and new patients.

    The patient is the payload's, as in the reference; the topic only
    subscribes. One query reads and parses the messages and lands all of them, validated and decoded
    (``channels``), by verdict; the rest is derived from that table. It goes through Spark's file sink, whose
    log makes a replayed batch invisible to the stages that read it as a stream.
    """
    base = base or os.path.join(checkpoint_dir(spark), "streams", name)
    land_validated(messages_df, base, vocabulary, channels)
    paths = {k: os.path.join(base, k) for k in ("validated", "rejected", "patients")}
    run_batches(validated_stream(spark, paths["validated"]), rejected_sink(paths["rejected"], paths["patients"]), os.path.join(base, "checkpoint"))
    return {**paths, "accepted": os.path.join(paths["validated"], "accepted=true")}


def land_validated(messages_df: DataFrame, base: str, vocabulary: Sequence[str] | None = None,
                   channels: Sequence[str] = vocab.CLINICAL_CHANNELS) -> None:
    """The first step of ``ingest``: validate and land what is available."""
    v = messages.validate_messages(messages_df, "value", "topic", vocabulary=vocabulary, decode=channels)
    run_available(v, os.path.join(base, "validated"), os.path.join(base, "checkpoint_validated"), partition_by=["accepted"])


def validated_stream(spark: SparkSession, path: str) -> DataFrame:
    """The landed table of validated messages as a stream."""
    # a folder's name gives text
    schema = spark.read.parquet(path).withColumn("accepted", F.col("accepted").cast("boolean")).schema
    return spark.readStream.schema(schema).parquet(path)


def publish_frames(scored: DataFrame) -> DataFrame:
    """(topic, value) rows for a prediction topic (Kafka or file sink); the time is that of the prediction."""
    payload = F.struct("sepsis_probability", "risk_level",
                       F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    return scored.select(clinical.prediction_topic(F.col("patient_id")).alias("topic"), F.to_json(payload).alias("value"))


def alert_frames(alerts: DataFrame) -> DataFrame:
    """Alert payload {risk_level, message, timestamp} on icu/{id}/alert."""
    payload = F.struct("risk_level", "message", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"))
    return alerts.select(clinical.alert_topic(F.col("patient_id")).alias("topic"), F.to_json(payload).alias("value"))


def dedup_alert_ids(alerts: DataFrame, watermark: str | None = None) -> DataFrame:
    """Seen-id de-duplication. Late rows are accepted, so every id is remembered; a caller that
    may lose rows later than ``watermark`` gets bounded state instead."""
    if watermark is None:
        return alerts.dropDuplicates(["id"])
    return alerts.withWatermark("created_at", watermark).dropDuplicatesWithinWatermark(["id"])


def dedup_readings(readings: DataFrame, watermark: str | None = None) -> DataFrame:
    """Optional at-least-once duplicate removal on (patient_id, timestamp); ``watermark`` as in J10."""
    if watermark is None:
        return readings.dropDuplicates(["patient_id", "timestamp"])
    return readings.withWatermark("timestamp", watermark).dropDuplicatesWithinWatermark(["patient_id", "timestamp"])


def linear_probability(weights: Sequence[float], intercept: float) -> Callable[[DataFrame], DataFrame]:
    """A declared scorer: logistic function of a weighted sum of the last step's channels (flat ``X``)."""
    n = len(weights)

    def score(windows: DataFrame) -> DataFrame:
        last = F.slice("X", F.size("X") - n + 1, n)
        z = sum((F.get(last, F.lit(i)).cast("double") * F.lit(float(w)) for i, w in enumerate(weights)), F.lit(float(intercept)))
        return windows.withColumn("sepsis_probability", F.lit(1.0) / (F.lit(1.0) + F.exp(-z)))

    return score


def model_probability(model) -> Callable[[DataFrame], DataFrame]:
    """A fitted Spark ML classifier as a scorer of flat windows."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def score(windows: DataFrame) -> DataFrame:
        scored = model.transform(windows.withColumn("features", array_to_vector(F.transform("X", lambda v: v.cast("double")))))
        return scored.withColumn("sepsis_probability", vector_to_array(F.col("probability"))[1]).drop(
            "features", "rawPrediction", "probability", "prediction")

    return score


def realtime(spark: SparkSession, messages_df: DataFrame, channels: Sequence[str], medians, mean, std,
             score: Callable[[DataFrame], DataFrame], base: str, model_version: str,
             window_size: int = vocab.STREAM_WINDOW_SIZE, threshold: float = vocab.FALLBACK_THRESHOLD,
             cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES, vital_names: Mapping[str, str] | None = None,
             idle_ms: int | None = None) -> dict:
    """M6 end to end as checkpointed streams chained through landed tables.

    1. messages → validation (unknown channels too, D9), landed once → dead letters / provisioned patients (J1-J3)
    2. accepted readings → keyed causal impute + count windows (J4, J5) → ``score`` (J6) → label and
       risk (J7) → keyed cooldown state (J8). Each micro-batch is landed once and gives predictions (B6), their published
       frames (B7), alerts with the reason of the reading, message and dispatch (J9), alert frames (B8) and audit rows (L5)

    The clock is arrival: within a patient readings and predictions are taken
    in the order (arrival_ts, message_id), and a source must deliver micro-batches
    in that order (a partitioned log does); results then don't depend on how the
    messages are dealt to files. ``vital_names`` maps the names of the reason
    rules to channels (by default their own names).
    """
    from wardline.streaming import state

    paths = ingest(spark, messages_df, base=os.path.join(base, "ingest"), vocabulary=channels, channels=channels)
    readings = validated_stream(spark, paths["validated"]).filter("accepted").select(
        "patient_id", "message_id", "timestamp", "arrival_ts", *[F.col(f"channels.{c}").alias(c) for c in channels])
    windows = state.stream_windows(readings, channels, medians, mean, std, window_size, order=("arrival_ts", "message_id"),
                                   idle_ms=idle_ms)
    p = F.col("sepsis_probability")
    preds = score(windows).select(
        "patient_id", F.col("message_id").alias("id"), "created_at", "window_end",
        clinical.window_start(F.col("window_end"), window_size).alias("window_start"), "sepsis_probability", "reading",
        clinical.predicted_label(p, threshold).alias("predicted_label"), clinical.risk_level(p, threshold).alias("risk_level"),
        F.lit(model_version).alias("model_version"))
    carry = ["window_end", "window_start", "reading", "predicted_label", "model_version"]
    flagged = state.flag_alerts(preds, cooldown_minutes, carry=carry, idle_ms=idle_ms)
    named = vital_names or {c: c for c in channels}
    reason = clinical.abnormal_reason({v: F.col("reading")[channels.index(c)] for v, c in named.items() if c in channels})
    out = {k: os.path.join(base, k) for k in ("predictions", "published", "alerts", "alert_frames", "audit")}
    run_batches(flagged, results_sink(out, reason), os.path.join(base, "ckpt_results"))
    return {**paths, **out}


def results_sink(out: Mapping[str, str], reason) -> Callable[[DataFrame, int], None]:
    """One micro-batch of flagged predictions, landed once, to all tables that follow from it."""
    from wardline.operators import alerts as alerting

    def sink(batch: DataFrame, batch_id: int) -> None:
        files.append_batch(batch, out["predictions"], batch_id)
        landed = batch.sparkSession.read.schema(batch.schema).parquet(os.path.join(out["predictions"], f"batch_id={batch_id}"))
        files.append_batch(publish_frames(landed), out["published"], batch_id)
        raised = alerting.enrich_alerts(landed.filter("raised").select("patient_id", "id", "created_at", "risk_level", "sepsis_probability", "reading"), reason)
        files.append_batch(raised, out["alerts"], batch_id)
        alerts = batch.sparkSession.read.schema(raised.schema).parquet(os.path.join(out["alerts"], f"batch_id={batch_id}"))
        files.append_batch(alert_frames(alerts), out["alert_frames"], batch_id)
        files.append_batch(tables.audit_rows(alerts, "system", "alert_dispatched", "alert", "id",
                                             {"patient_id": F.col("patient_id"), "risk_level": F.col("risk_level"),
                                              "dispatch_status": F.to_json("dispatch_status")}, "created_at"), out["audit"], batch_id)

    return sink
