"""Alert engine in batch.

Cooldown (J8) is a fold: whether a prediction raises an alert depends on the
alerts raised before it; ``wardline.operators.cooldown`` evaluates it exactly
without grouping an entity's history in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators import cooldown
from wardline.session import reliable_checkpoint


def triggered(preds: DataFrame, levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, risk: str = "risk_level") -> DataFrame:
    """Predictions whose risk level is in the trigger set."""
    return preds.filter(F.col(risk).isin(list(levels)))


def cooldown_alerts(preds: DataFrame, cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES,
                    levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, key: str = "patient_id",
                    ts: str = "created_at", id_col: str = "id", risk: str = "risk_level",
                    existing: DataFrame | None = None, carry: Sequence[str] = (),
                    segment: int = cooldown.SEGMENT, fan: int = cooldown.FAN) -> DataFrame:
    """Raised alerts: (key, id, ts, risk, *carry) for each triggered prediction that is not suppressed.

    A prediction is raised if the entity has no earlier alert, if its rank is
    strictly above the last alert's rank, or if the last alert is at least
    ``cooldown_minutes`` old. Suppressed predictions do not change the state.
    ``existing`` alerts (key, ts, risk; e.g. manual ones) take part in the
    state but are not emitted (Q17). See ``wardline.operators.cooldown``.
    """
    return cooldown.cooldown_alerts(preds, cooldown_minutes, levels, key, ts, id_col, risk, existing, carry, segment, fan)


def asof_latest(left: DataFrame, right: DataFrame, key: str, left_ts: str, right_ts: str, right_id: str,
                payload: Sequence[str], bucket: str = "hour", prefix: str = "v_") -> DataFrame:
    """Attach to each left row the latest right row with right_ts <= left_ts (tie → highest id).

    Rows are grouped by (key, time bucket) so that no task has to hold an
    entity's whole history: inside a bucket a running ``last`` over the union
    of both sides finds the match; the latest right row of earlier buckets
    comes from a running ``last`` over the per-bucket table (one row per
    entity and bucket), joined back on (key, bucket).
    """
    fields = [right_ts, right_id, *payload]
    # a right row with a null key never matches; a left row with a null key finds no right row
    right = right.filter(F.col(key).isNotNull())
    rt = right.select(F.col(key).alias("_k"), F.date_trunc(bucket, F.col(right_ts).cast("timestamp")).alias("_b"),
                      F.col(right_ts).cast("timestamp").alias("_t"), F.lit(0).alias("_side"), F.col(right_id).alias("_rid"),
                      F.struct(*[F.col(c).alias(c) for c in fields]).alias("_r"))
    lt_cols = left.columns
    lt = left.select(F.col(key).alias("_k"), F.date_trunc(bucket, F.col(left_ts).cast("timestamp")).alias("_b"),
                     F.col(left_ts).cast("timestamp").alias("_t"), F.lit(1).alias("_side"),
                     F.lit(None).cast(rt.schema["_rid"].dataType).alias("_rid"),
                     F.lit(None).cast(rt.schema["_r"].dataType).alias("_r"),
                     F.struct(*[F.col(c) for c in lt_cols]).alias("_l"))
    rt = rt.withColumn("_l", F.lit(None).cast(lt.schema["_l"].dataType))
    # the union feeds two consumers (in-bucket match, per-bucket carry): write it once rather than
    # computing both inputs twice
    both = reliable_checkpoint(rt.unionByName(lt))
    inner = Window.partitionBy("_k", "_b").orderBy("_t", "_side", "_rid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ran = both.withColumn("_m", F.last("_r", ignorenulls=True).over(inner))
    within = ran.filter(F.col("_side") == 1)
    # per-bucket table from the same windowed rows (one shuffle of each side): the running value
    # at a bucket's last row is the bucket's latest right row; buckets holding only left rows stay null
    per_bucket = ran.groupBy("_k", "_b").agg(F.max_by("_m", F.struct("_t", "_side", "_rid")).alias("_br"))
    prev = Window.partitionBy("_k").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_bucket.select("_k", "_b", F.last("_br", ignorenulls=True).over(prev).alias("_carry"))
    j = within.join(carried, ["_k", "_b"], "left")
    m = F.coalesce(F.col("_m"), F.col("_carry"))
    return j.select(*[F.col(f"_l.{c}").alias(c) for c in lt_cols], *[m[c].alias(prefix + c) for c in fields])


def enrich_alerts(alerts: DataFrame, reason: Column, key: str = "patient_id", prob: str = "sepsis_probability",
                  risk: str = "risk_level", status: Column | None = None) -> DataFrame:
    """Message (C11) + dispatch status map + dispatched channels."""
    status = status if status is not None else F.create_map(
        F.lit("telegram"), F.lit("skipped"), F.lit("email"), F.lit("skipped"), F.lit("mqtt"), F.lit("sent"))
    return alerts.withColumn("reason", reason) \
        .withColumn("message", clinical.alert_message(F.col(risk), F.col(key), F.col(prob), F.col("reason"))) \
        .withColumn("dispatch_status", status) \
        .withColumn("channels_dispatched", clinical.dispatched_channels(F.col("dispatch_status"))) \
        .withColumn("acknowledged", F.lit(False))
