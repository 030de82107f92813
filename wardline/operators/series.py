"""Per-entity series views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def sequence_index(df: DataFrame, key: str, order: Sequence[str], name: str = "ingest_seq") -> DataFrame:
    """0-based monotone index per entity."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1).cast("long"))


def wide_to_tall(df: DataFrame, ids: Sequence[str], channels: Sequence[str]) -> DataFrame:
    """Channel columns → (channel, value) rows, missing values dropped."""
    return df.unpivot(list(ids), list(channels), "channel", "value").filter(F.col("value").isNotNull())


def channels_map(channels: Sequence[str]) -> Column:
    """Channel columns → map (null entries dropped)."""
    m = F.map_from_arrays(F.array(*[F.lit(c) for c in channels]), F.array(*[F.col(c).cast("double") for c in channels]))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def timeseries(df: DataFrame, entities: DataFrame, key: str, order: str, channels: Sequence[str]) -> DataFrame:
    """Time-sorted tall series of selected channels for selected entities (semi join)."""
    sel = df.join(entities.select(key).distinct(), key, "left_semi")
    return wide_to_tall(sel.select(key, order, *channels), [key, order], channels)


def probability_trend(preds: DataFrame, key: str = "patient_id", ts: str = "created_at", id_col: str = "id",
                      prob: str = "sepsis_probability", bucket: str = "day") -> DataFrame:
    """Per-entity ascending trend with the change from the previous prediction.

    A prediction's predecessor is in its own (entity, day) or is the last one of
    the entity's day before, which comes from the table of days; no task holds an
    entity's whole history.
    """
    days = preds.withColumn("_day", F.date_trunc(bucket, F.col(ts).cast("timestamp")))
    within = Window.partitionBy(key, "_day").orderBy(ts, id_col)
    rows = days.withColumn("_prev", F.lag(prob).over(within)).withColumn("_nth", F.row_number().over(within))
    last = days.groupBy(F.col(key).alias("_k"), F.col("_day").alias("_d")).agg(F.max_by(prob, F.struct(ts, id_col)).alias("_last"))
    carry = last.select("_k", "_d", F.lag("_last").over(Window.partitionBy("_k").orderBy("_d")).alias("_carry"))
    joined = rows.join(carry, F.col(key).eqNullSafe(F.col("_k")) & F.col("_day").eqNullSafe(F.col("_d")), "left")
    before = F.when(F.col("_nth") == 1, F.col("_carry")).otherwise(F.col("_prev"))
    return joined.withColumn("delta", F.col(prob) - before).select(*preds.columns, "delta")


def urgent_unacknowledged(alerts: DataFrame, levels: Sequence[str] = ("High", "Critical")) -> DataFrame:
    """D12."""
    return alerts.filter(F.col("risk_level").isin(list(levels)) & ~F.coalesce(F.col("acknowledged"), F.lit(False)))


def newest(df: DataFrame, n: int, ts: str = "created_at", id_col: str = "id") -> DataFrame:
    """H4 / H6: newest-first bounded list (TakeOrderedAndProject: each task keeps n rows)."""
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


def with_public_id(df: DataFrame, id_cols: Sequence[str] = ("_id",)) -> DataFrame:
    """``_id`` → ``id`` and id-like fields as strings."""
    out = df
    if "_id" in out.columns:
        out = out.withColumnRenamed("_id", "id")
    for c in id_cols:
        c2 = "id" if c == "_id" else c
        if c2 in out.columns:
            out = out.withColumn(c2, F.col(c2).cast("string"))
    return out


def touch_last_login(users: DataFrame, events: DataFrame, user: str = "username", ts: str = "ts") -> DataFrame:
    """last_login = latest event per user (partial aggregation, then one join)."""
    last = events.groupBy(user).agg(F.max(ts).alias("_last"))
    j = users.join(last, user, "left")
    return j.withColumn("last_login", F.coalesce(F.col("_last"), F.col("last_login")) if "last_login" in users.columns
                        else F.col("_last")).drop("_last")
