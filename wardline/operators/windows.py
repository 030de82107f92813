"""Sliding window tensors (G3, G4), the imputation guard (D10) and tensor helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MISSING_MSG = "build_windows requires fully-imputed channels; run cleaning first"


def _row_vector(channels: Sequence[str], cell_type: str) -> Column:
    vec = F.array(*[F.col(c).cast(cell_type) for c in channels])
    any_null = F.greatest(*[F.col(c).isNull() for c in channels]) if len(channels) > 1 else F.col(channels[0]).isNull()
    # D10 evaluated lazily inside the same projection: no extra job.
    return F.when(any_null, F.raise_error(F.lit(MISSING_MSG))).otherwise(vec)


def unimputed(df: DataFrame, channels: Sequence[str], key: str = "patient_id", order: str = "ICULOS") -> DataFrame:
    """D10 as rows: the readings that ``build_windows`` refuses, with their missing channels and its message."""
    missing = F.filter(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in channels]), lambda c: c.isNotNull())
    return df.select(key, order, missing.alias("missing")).filter(F.size("missing") > 0).withColumn("error", F.lit(MISSING_MSG))


def build_windows(df: DataFrame, channels: Sequence[str], window_size: int = 8, stride: int = 1,
                  key: str = "patient_id", order: str = "ICULOS", label: str = "SepsisLabel",
                  cell_type: str = "float", extra: Sequence[str] = (), bucket_width: int | None = None) -> DataFrame:
    """One row per window: X (window_size x channels), label at the window's end row.

    Windows count rows, not hours. Entities with fewer rows than the window
    yield one window left-padded with their first row. ``window_end_idx`` is
    the 0-based end row in the (padded) sequence; ``window_end_time`` is the
    ``order`` value of the end row. One shuffle on ``key`` and one sort serve
    the row number, the entity size and the sliding frame; on the hourly grid
    an entity is bounded by its stay in hours. ``bucket_width`` switches to
    ``build_windows_bucketed`` for unbounded entities.
    """
    if bucket_width is not None:
        return build_windows_bucketed(df, channels, window_size, stride, key, order, label, cell_type, extra, bucket_width)
    w = int(window_size)
    ordered = Window.partitionBy(key).orderBy(order)
    frame = ordered.rowsBetween(-(w - 1), Window.currentRow)
    whole = Window.partitionBy(key)
    staged = df.select(
        F.col(key), F.col(order), F.col(label).alias("_label"), *[F.col(c) for c in extra],
        _row_vector(channels, cell_type).alias("_row"),
        F.row_number().over(ordered).alias("_rn"),
        F.count(F.lit(1)).over(whole).alias("_n"),
    )
    staged = staged.withColumn("_X", F.collect_list("_row").over(frame))
    keep = ((F.col("_rn") >= w) & (((F.col("_rn") - w) % stride) == 0)) | \
           ((F.col("_n") < w) & (F.col("_rn") == F.col("_n")))
    pad = F.greatest(F.lit(w) - F.col("_n"), F.lit(0))
    X = F.when(F.col("_n") < w,
               F.concat(F.array_repeat(F.element_at("_X", 1), (F.lit(w) - F.col("_n")).cast("int")), F.col("_X"))
               ).otherwise(F.col("_X"))
    return staged.filter(keep).select(
        F.col(key), *[F.col(c) for c in extra],
        (F.col("_rn") - 1 + pad).cast("long").alias("window_end_idx"),
        F.col(order).alias("window_end_time"),
        X.alias("X"),
        F.col("_label").cast("long").alias("y"),
    )


def explode_steps(windows: DataFrame, channels: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Tall view of a window tensor: one row per (window, step) with channel columns."""
    s = windows.select(*keep, F.posexplode("X").alias("step", "_v"))
    return s.select(*keep, F.col("step").cast("int").alias("step"),
                    *[F.col("_v")[i].alias(c) for i, c in enumerate(channels)])


def last_timestep(X: Column) -> Column:
    """X[:, -1, :]."""
    return F.element_at(X, -1)


def channel_means(X: Column, n_channels: int) -> Column:
    """Per-channel mean over a window's timesteps."""
    return F.transform(
        F.sequence(F.lit(0), F.lit(n_channels - 1)),
        lambda j: F.aggregate(F.transform(X, lambda r: r[j].cast("double")), F.lit(0.0), lambda a, b: a + b) / F.size(X),
    )


def mask_channels(X: Column, keep_mask: Column, fill: Column) -> Column:
    """C20: replace masked channels of every timestep by a background value."""
    return F.transform(X, lambda r: F.transform(r, lambda v, j: F.when(keep_mask[j], v).otherwise(fill[j].cast("float"))))


def flatten_window(X: Column) -> Column:
    """Window → flat feature array (row-major, timestep then channel)."""
    return F.flatten(X)


def row_index_bucketed(df: DataFrame, key: str, order: str, bucket_width: int) -> DataFrame:
    """Exact 1-based row index per entity and the entity size, without an entity-wide window.

    Rows are grouped by (entity, order // bucket_width); a running sum over the
    per-bucket counts (one row per entity and bucket) gives each bucket's
    offset; row_number runs inside a bucket.
    """
    d = df.withColumn("_b", F.floor(F.col(order) / F.lit(bucket_width)).cast("long"))
    counts = d.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(key, "_b", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    sizes = counts.groupBy(key).agg(F.sum("_cnt").alias("_n"))
    inner = Window.partitionBy(key, "_b").orderBy(order)
    return d.withColumn("_rn", F.row_number().over(inner)).join(offs, [key, "_b"]).join(sizes, key) \
        .withColumn("_rn", (F.col("_off") + F.col("_rn")).cast("long")).drop("_b", "_off")


def build_windows_bucketed(df: DataFrame, channels: Sequence[str], window_size: int = 8, stride: int = 1,
                           key: str = "patient_id", order: str = "ICULOS", label: str = "SepsisLabel",
                           cell_type: str = "float", extra: Sequence[str] = (), bucket_width: int = 24 * 7) -> DataFrame:
    """Same output as ``build_windows`` for entities of any size.

    Each row is sent to every window it belongs to (at most ``window_size``
    end positions), then one group-by on (entity, end position) assembles the
    window from exactly ``window_size`` rows; no task holds an entity.
    """
    w = int(window_size)
    idx = row_index_bucketed(df, key, order, bucket_width)
    staged = idx.select(key, order, "_rn", "_n", F.col(label).alias("_label"), *[F.col(c) for c in extra],
                        _row_vector(channels, cell_type).alias("_row"))
    full = F.filter(F.sequence(F.col("_rn"), F.col("_rn") + (w - 1)),
                    lambda e: (e >= w) & (e <= F.col("_n")) & (((e - w) % stride) == 0))
    ends = F.when(F.col("_n") < w, F.array(F.col("_n"))).otherwise(full)
    exploded = staged.select("*", F.explode(ends).alias("_end"))
    g = exploded.groupBy(key, "_end").agg(
        F.array_sort(F.collect_list(F.struct("_rn", "_row"))).alias("_items"),
        F.max_by(F.struct(F.col(order).alias("t"), F.col("_label").alias("y"), *[F.col(c).alias(c) for c in extra]), F.col("_rn")).alias("_last"),
        F.first("_n").alias("_n"))
    rows = F.transform("_items", lambda x: x["_row"])
    X = F.when(F.col("_n") < w, F.concat(F.array_repeat(F.element_at(rows, 1), (F.lit(w) - F.col("_n")).cast("int")), rows)).otherwise(rows)
    pad = F.greatest(F.lit(w) - F.col("_n"), F.lit(0))
    return g.select(F.col(key), *[F.col(f"_last.{c}").alias(c) for c in extra],
                    (F.col("_end") - 1 + pad).cast("long").alias("window_end_idx"),
                    F.col("_last.t").alias("window_end_time"), X.alias("X"), F.col("_last.y").cast("long").alias("y"))
