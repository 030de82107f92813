"""Registered preprocessing queries (M1 parts) on the stand-in readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.registry import r6, register, round_doubles
from wardline.operators import fill, impute, split as splitting, windows as win
from wardline.plans import preprocess
from wardline.sources import standin
from wardline.sources.standin import CHANNELS as CH

KEY, ORDER, LABEL = "patient_id", "ICULOS", "SepsisLabel"
CHQ = ", ".join(S.q(c) for c in CH)


def _rw(spark, d):
    return standin.readings_wide(spark, d)


@register("readings_wide", S.with_(*S.RW) + f"SELECT patient_id, hr, \"ICULOS\", {CHQ}, \"SepsisLabel\" FROM rw")
def readings_wide(spark, d):
    return _rw(spark, d)


@register("readings_tall", "SELECT user_id AS patient_id, ts AS charttime, event_type AS channel, value, "
                           "'events' AS source FROM events WHERE value IS NOT NULL")
def readings_tall(spark, d):
    return standin.readings_tall(spark, d)


@register("ffill_bfill", S.with_(*S.FF) + f"SELECT patient_id, hr, \"ICULOS\", {CHQ}, \"SepsisLabel\" FROM ff")
def ffill_bfill(spark, d):
    return fill.ffill_bfill(_rw(spark, d), CH, KEY, ORDER)


def _filled_split(spark, d):
    rw = _rw(spark, d)
    sp = splitting.split_entities(rw, KEY, LABEL)
    return fill.ffill_bfill(splitting.attach_split(rw, sp, KEY), CH, KEY, ORDER)


@register("train_medians", S.with_(*S.MED) + "SELECT channel, round(median, 6) AS median FROM (UNPIVOT med ON "
                                             + CHQ + " INTO NAME channel VALUE median)")
def train_medians(spark, d):
    return round_doubles(impute.median_frame(_filled_split(spark, d), CH))


@register("scaler_stats", S.with_(*S.SCALER) + "SELECT channel, " + "round(mean, 6) AS mean, round(std, 6) AS std FROM ("
          + " UNION ALL ".join(f"SELECT '{c}' AS channel, {S.q(c + '__m')} AS mean, {S.q(c + '__s')} AS std FROM sc" for c in CH) + ")")
def scaler_stats(spark, d):
    fs = _filled_split(spark, d)
    med = impute.fit_medians(fs, CH)
    return round_doubles(impute.scaler_frame(impute.fill_with(fs, med, CH), CH))


@register("impute", S.with_(*S.MED) + "SELECT patient_id, \"ICULOS\", split, "
          + ", ".join(f"{S.r6(S.q(c))} AS {S.q(c)}" for c in CH) + ", \"SepsisLabel\" FROM imp")
def impute_q(spark, d):
    fs = _filled_split(spark, d)
    med = impute.fit_medians(fs, CH)
    return round_doubles(impute.fill_with(fs, med, CH).select(KEY, ORDER, "split", *CH, LABEL))


@register("zscore", S.with_(*S.SCALER) + "SELECT patient_id, \"ICULOS\", split, "
          + ", ".join(f"{S.r6(S.q(c))} AS {S.q(c)}" for c in CH) + ", \"SepsisLabel\" FROM z")
def zscore(spark, d):
    p = preprocess.prepare(_rw(spark, d), CH)
    return round_doubles(p.normalized.select(KEY, ORDER, "split", *CH, LABEL))


def _windows(spark, d, w, s):
    p = preprocess.prepare(_rw(spark, d), CH, window_size=w, stride=s)
    t = win.explode_steps(p.windows, CH, [KEY, "split", "window_end_idx", "window_end_time", "y"])
    # cells are float32: their double value is exact on both engines, no rounding needed
    return t.select(KEY, "split", "window_end_idx", "window_end_time", "y", "step", *[F.col(c).cast("double").alias(c) for c in CH])


def _windows_sql(w, s):
    return S.with_(*S.SCALER, *S.windows_sql("z", w, s)) + "SELECT * FROM wx"


@register("windows", _windows_sql(8, 1))
def windows(spark, d):
    return _windows(spark, d, 8, 1)


@register("windows_padded", _windows_sql(64, 1))
def windows_padded(spark, d):
    """Window of 64 rows: entities with fewer rows are left-padded."""
    return _windows(spark, d, 64, 1)


@register("windows_stride", _windows_sql(8, 4))
def windows_stride(spark, d):
    return _windows(spark, d, 8, 4)


@register("last_timestep", S.with_(*S.SCALER, *S.windows_sql("z", 8, 1))
          + "SELECT patient_id, window_end_idx, y, " + CHQ + " FROM wx WHERE step = 7")
def last_timestep(spark, d):
    p = preprocess.prepare(_rw(spark, d), CH)
    lt = p.windows.select(KEY, "window_end_idx", "y", win.last_timestep(F.col("X")).alias("_v"))
    return lt.select(KEY, "window_end_idx", "y", *[F.col("_v")[i].cast("double").alias(c) for i, c in enumerate(CH)])


@register("patient_split", S.with_(*S.SPLIT) + "SELECT patient_id, ever_positive, split FROM sp")
def patient_split(spark, d):
    return splitting.split_entities(_rw(spark, d), KEY, LABEL)


@register("split_counts", S.with_(*S.SCALER, *S.windows_sql("z", 8, 1))
          + "SELECT split, count(DISTINCT patient_id) AS n_patients, count(*) AS n_windows, "
            "round(coalesce(avg(y), 0.0), 6) AS window_positive_rate FROM wx WHERE step = 0 GROUP BY split")
def split_counts(spark, d):
    p = preprocess.prepare(_rw(spark, d), CH)
    return round_doubles(preprocess.split_summary(p.windows))


@register("split_disjoint", S.with_(*S.SPLIT)
          + "SELECT count(*) AS n_patients, count(*) FILTER (WHERE n_splits > 1) AS n_overlapping, "
            "count(*) FILTER (WHERE n_splits = 0) AS n_unassigned FROM "
            "(SELECT pp.patient_id, count(DISTINCT sp.split) AS n_splits FROM pp LEFT JOIN sp USING (patient_id) GROUP BY 1)")
def split_disjoint(spark, d):
    """I4: every entity in exactly one split."""
    rw = _rw(spark, d)
    sp = splitting.split_entities(rw, KEY, LABEL)
    per = splitting.ever_positive(rw, KEY, LABEL).join(sp.select(KEY, "split"), KEY, "left") \
        .groupBy(KEY).agg(F.countDistinct("split").alias("n_splits"))
    return per.agg(F.count(F.lit(1)).alias("n_patients"),
                   F.count(F.when(F.col("n_splits") > 1, 1)).alias("n_overlapping"),
                   F.count(F.when(F.col("n_splits") == 0, 1)).alias("n_unassigned"))


@register("ever_positive", S.with_(*S.RW) + "SELECT patient_id, CAST(max(\"SepsisLabel\") AS INTEGER) AS ever_positive FROM rw GROUP BY 1")
def ever_positive(spark, d):
    return splitting.ever_positive(_rw(spark, d), KEY, LABEL)


@register("prevalence", S.with_(*S.RW) + "SELECT count(*) AS n_patients, sum(e) AS n_positive, round(avg(e), 6) AS prevalence "
          "FROM (SELECT patient_id, max(\"SepsisLabel\") AS e FROM rw GROUP BY 1)")
def prevalence(spark, d):
    e = splitting.ever_positive(_rw(spark, d), KEY, LABEL)
    return e.agg(F.count(F.lit(1)).alias("n_patients"), F.sum("ever_positive").cast("long").alias("n_positive"),
                 r6(F.avg("ever_positive")).alias("prevalence"))


@register("background_fill", S.with_(*S.SCALER, *S.windows_sql("z", 8, 1)) + "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS channel, round(avg({S.q(c)}), 6) AS fill FROM wx WHERE split = 'train'" for c in CH) + ")")
def background_fill(spark, d):
    """mean over train windows and timesteps per channel (the attribution background)."""
    from wardline.operators import ml
    p = preprocess.prepare(_rw(spark, d), CH)
    row = ml.background_fill(p.windows.filter(F.col("split") == "train"), len(CH))
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.round(F.col("fill")[i], 6).alias("fill"))
                                         for i, c in enumerate(CH)])))


@register("channel_means", S.with_(*S.SCALER, *S.windows_sql("z", 8, 1)) + "SELECT patient_id, window_end_idx, "
          + ", ".join(f"round(avg({S.q(c)}), 6) AS {S.q(c)}" for c in CH) + " FROM wx GROUP BY 1, 2")
def channel_means(spark, d):
    """Per-window mean of each channel over the window's timesteps (in-row, no shuffle)."""
    p = preprocess.prepare(_rw(spark, d), CH)
    m = p.windows.select(KEY, "window_end_idx", win.channel_means(F.col("X"), len(CH)).alias("_m"))
    return m.select(KEY, "window_end_idx", *[r6(F.col("_m")[i]).alias(c) for i, c in enumerate(CH)])
