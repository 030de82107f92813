"""Per-entity gap filling (G1, G2) and NaN normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nan_to_null(c: Column) -> Column:
    """A NaN never survives ingest; Spark's avg/max/median treat it as a value."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c)


def ffill_bfill(df: DataFrame, channels: Sequence[str], key: str = "patient_id",
                order: str | Sequence[str] = "ICULOS", bucket_width: int | None = None) -> DataFrame:
    """Forward fill each channel within an entity, then back-fill the leading gap.

    After the forward pass the only remaining gap is the leading one, so the
    backward pass equals the entity's first non-null value: one sort on
    (key, order) serves both frames, and both frames are evaluated in O(n)
    per entity (running frame + whole-partition frame). The table is one
    row per (entity, hour), so an entity's group is bounded by its span in
    hours; Spark's window buffer spills beyond memory.
    """
    if bucket_width is not None:
        return ffill_bfill_bucketed(df, channels, key, order if isinstance(order, str) else order[0], bucket_width)
    orders = [order] if isinstance(order, str) else list(order)
    base = Window.partitionBy(key).orderBy(*orders)
    running = base.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = base.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    chans = set(channels)
    out = []
    for c in df.columns:
        if c in chans:
            out.append(F.coalesce(F.last(c, ignorenulls=True).over(running),
                                  F.first(c, ignorenulls=True).over(whole)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def ffill_bfill_bucketed(df: DataFrame, channels: Sequence[str], key: str, order: str, bucket_width: int) -> DataFrame:
    """Same result as ``ffill_bfill`` for unbounded per-entity groups (event-level data).

    Rows are grouped by (entity, order // bucket_width): the running ``last``
    runs inside a bucket; the last value of earlier buckets comes from a
    running ``last`` over the per-bucket table (one row per entity and
    bucket); the back-fill value is each entity's first observed value from a
    partial ``min_by`` aggregate. No task holds a whole entity. ``order`` must
    be numeric (use epoch seconds for times) and unique within an entity.
    """
    b = F.floor(F.col(order) / F.lit(bucket_width)).cast("long")
    d = df.withColumn("_b", b)
    run = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = d.select(*d.columns, *[F.last(c, ignorenulls=True).over(run).alias(f"_w_{c}") for c in channels])
    per_bucket = d.groupBy(key, "_b").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_l_{c}") for c in channels])
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(key, "_b", *[F.last(f"_l_{c}", ignorenulls=True).over(earlier).alias(f"_c_{c}") for c in channels])
    first = d.groupBy(key).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_f_{c}") for c in channels])
    j = within.join(carry, [key, "_b"], "left").join(first, key, "left")
    chans = set(channels)
    return j.select(*[F.coalesce(f"_w_{c}", f"_c_{c}", f"_f_{c}").alias(c) if c in chans else F.col(c) for c in df.columns])
