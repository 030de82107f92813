"""Exploratory statistics.

Wide tables are aggregated wide in one pass and only the single result row is
stacked to one row per channel: never unpivot 34x before aggregating.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wardline.operators.quantiles import exact_quantiles
from wardline.session import reliable_checkpoint


def _stack(row: DataFrame, channels: Sequence[str], fields: dict) -> DataFrame:
    """Turn a one-row wide aggregate into one row per channel."""
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), *[fn(c).alias(name) for name, fn in fields.items()]) for c in channels])))


def descriptive_stats(df: DataFrame, channels: Sequence[str], exact: bool = True) -> DataFrame:
    """count, mean, std (ddof 1), min, 25/50/75 % (linear), max, pct_missing per channel.

    Exact quartiles use the two-pass bracketed method (no column is ever held
    in one task); the result is one small row per channel.
    """
    if exact:
        extra = [F.count(F.lit(1)).alias("_n")]
        for c in channels:
            extra += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                      F.min(c).cast("double").alias(f"{c}__min"), F.max(c).cast("double").alias(f"{c}__max")]
        qv, r = exact_quantiles(df, channels, [0.25, 0.5, 0.75], extra=extra)
        rows = []
        for c in channels:
            k = r[f"{c}__count"]
            rows.append((c, k, r[f"{c}__mean"], r[f"{c}__std"], r[f"{c}__min"], qv[(c, 0.25)], qv[(c, 0.5)], qv[(c, 0.75)],
                         r[f"{c}__max"], 100.0 * (1.0 - k / r["_n"]) if r["_n"] else None))
        return df.sparkSession.createDataFrame(rows, "channel string, count long, mean double, std double, min double, "
                                                     "p25 double, p50 double, p75 double, max double, pct_missing double")
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in channels:
        q = (F.percentile(c, [0.25, 0.5, 0.75]) if exact else F.percentile_approx(c, [0.25, 0.5, 0.75], 100000))
        aggs += [F.count(c).alias(f"{c}__count"), F.avg(c).alias(f"{c}__mean"), F.stddev_samp(c).alias(f"{c}__std"),
                 F.min(c).cast("double").alias(f"{c}__min"), q.alias(f"{c}__q"), F.max(c).cast("double").alias(f"{c}__max")]
    row = df.agg(*aggs)
    return _stack(row, channels, {
        "count": lambda c: F.col(f"{c}__count"),
        "mean": lambda c: F.col(f"{c}__mean"),
        "std": lambda c: F.col(f"{c}__std"),
        "min": lambda c: F.col(f"{c}__min"),
        "p25": lambda c: F.col(f"{c}__q")[0].cast("double"),
        "p50": lambda c: F.col(f"{c}__q")[1].cast("double"),
        "p75": lambda c: F.col(f"{c}__q")[2].cast("double"),
        "max": lambda c: F.col(f"{c}__max"),
        "pct_missing": lambda c: F.lit(100.0) * (F.lit(1.0) - F.col(f"{c}__count") / F.col("_n")),
    })


def label_group_stats(df: DataFrame, channels: Sequence[str], label: str) -> DataFrame:
    """mean/std per channel by label, columns ``{channel}_mean`` / ``{channel}_std``."""
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std")]
    return df.groupBy(label).agg(*aggs)


def missingness(df: DataFrame, channels: Sequence[str]) -> DataFrame:
    """n_missing, n_total, pct_missing per channel (sort worst-first when presenting)."""
    row = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in channels])
    return _stack(row, channels, {
        "n_missing": lambda c: F.col(c),
        "n_total": lambda c: F.col("_n"),
        "pct_missing": lambda c: F.lit(100.0) * F.col(c) / F.col("_n"),
    })


def missingness_by_entity(df: DataFrame, channels: Sequence[str], key: str) -> DataFrame:
    """unweighted mean over entities of each entity's missing rate (two-level, partial aggregation)."""
    per = df.groupBy(key).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in channels])
    row = per.agg(*[F.avg(c).alias(c) for c in channels])
    return _stack(row, channels, {"avg_per_patient_missing_rate": lambda c: F.col(c)})


def correlation_matrix(df: DataFrame, channels: Sequence[str], min_periods: int = 30) -> DataFrame:
    """pairwise-complete Pearson, null when fewer than ``min_periods`` joint observations.

    Sufficient statistics of all pairs are matrix products within an Arrow batch
    (values less their column's mean, so that squares do not cancel); a task adds up its
    batches before it emits a row for each pair. The columns are written once for both passes. Output is tall (channel_a, channel_b, corr)
    for every ordered pair.
    """
    channels = list(channels)
    values = reliable_checkpoint(df.select(*[F.col(c).cast("double").alias(c) for c in channels]))
    means = values.agg(*[F.coalesce(F.avg(F.nanvl(c, F.lit(None).cast("double"))), F.lit(0.0)).alias(c) for c in channels]).first()
    centre = np.array([means[c] for c in channels])
    upper = np.triu_indices(len(channels))

    def products(batches):
        total = np.zeros((6, len(channels), len(channels)))
        for pdf in batches:
            x = pdf.to_numpy(float) - centre
            m = np.isfinite(x)
            x = np.where(m, x, 0.0)
            m, xx = m.astype(float), x * x
            total += [m.T @ m, x.T @ m, m.T @ x, xx.T @ m, m.T @ xx, x.T @ x]
        yield pd.DataFrame({"a": upper[0], "b": upper[1], **{k: v[upper] for k, v in zip(names, total, strict=True)}})

    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    part = values.mapInPandas(products, "a int, b int, " + ", ".join(f"{k} double" for k in names))
    s = part.groupBy("a", "b").agg(*[F.sum(k).alias(k) for k in names])
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy, cov = F.col("sxx") - sx * sx / n, F.col("syy") - sy * sy / n, F.col("sxy") - sx * sy / n
    # a variance that is rounding error of its own sum of squares is none
    varies = (n > 0) & (vx > F.col("sxx") * 1e-14) & (vy > F.col("syy") * 1e-14)
    r = F.when((n >= min_periods) & varies, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cov / F.sqrt(vx * vy))))
    label = F.array(*[F.lit(c) for c in channels])
    pairs = s.select(label[F.col("a")].alias("x"), label[F.col("b")].alias("y"), r.alias("corr"))
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct("x", "y"))).otherwise(
        F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return pairs.select(F.explode(both).alias("p"), "corr").select(
        F.col("p.x").alias("channel_a"), F.col("p.y").alias("channel_b"), "corr")


def top_pairs(corr: DataFrame, channels: Sequence[str], top_n: int = 15) -> DataFrame:
    """H2: strongest pairs by |corr|, upper triangle only, nulls dropped."""
    pos = F.create_map(*[x for i, c in enumerate(channels) for x in (F.lit(c), F.lit(i))])
    upper = corr.filter((pos[F.col("channel_a")] < pos[F.col("channel_b")]) & F.col("corr").isNotNull())
    return upper.orderBy(F.abs("corr").desc(), pos[F.col("channel_a")], pos[F.col("channel_b")]).limit(top_n) \
        .select(F.col("channel_a").alias("feature_a"), F.col("channel_b").alias("feature_b"), F.col("corr").alias("correlation"))


def summary(df: DataFrame, channels: Sequence[str], key: str, label: str, missing: DataFrame, pairs: DataFrame,
            importance: DataFrame | None = None) -> DataFrame:
    """F25 as a tall table (metric, num, text): rows, patients, prevalence, most missing channel, strongest pair and,
    given a ranking of channels, the most important one."""
    null = F.lit(None).cast("string")
    base = entity_profile(df, key, label).agg(
        F.sum("n_rows").cast("double").alias("n_rows"), F.count(F.lit(1)).cast("double").alias("n_patients"),
        F.avg("ever_positive").alias("positive_rate"))
    out = base.select(F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("num"), null.alias("text"))
                                         for m in ("n_rows", "n_patients", "positive_rate")])))
    place = F.create_map(*[x for i, c in enumerate(channels) for x in (F.lit(c), F.lit(i))])
    tops = [missing.orderBy(F.col("pct_missing").desc(), place[F.col("channel")]).limit(1)
            .select(F.lit("top_missing_channel").alias("metric"), F.col("pct_missing").alias("num"), F.col("channel").alias("text")),
            pairs.orderBy(F.abs("correlation").desc(), place[F.col("feature_a")], place[F.col("feature_b")]).limit(1)
            .select(F.lit("top_correlated_pair").alias("metric"), F.col("correlation").alias("num"),
                    F.concat_ws(" / ", "feature_a", "feature_b").alias("text"))]
    if importance is not None:
        tops.append(importance.orderBy(F.col("importance").desc(), place[F.col("channel")]).limit(1)
                    .select(F.lit("top_important_channel").alias("metric"), F.col("importance").alias("num"), F.col("channel").alias("text")))
    for t in tops:
        out = out.unionByName(t)
    return out


def channel_coverage(tall: DataFrame, key: str = "patient_id", exact: bool = True) -> DataFrame:
    """readings and distinct entities per channel."""
    distinct = F.countDistinct(key) if exact else F.approx_count_distinct(key)
    return tall.groupBy("channel").agg(F.count("value").alias("n_readings"), distinct.alias("n_patients"))


def demographics(stays: DataFrame, key: str = "patient_id") -> DataFrame:
    """F8 as a tall table (metric, category, value).

    Age mean/std and unit counts weigh entities by stays; sex counts use one
    row per entity (the first stay by stay order, deterministic).
    """
    # three statistics read the stays: write the narrow projection once instead of re-joining three times
    stays = reliable_checkpoint(stays.select(key, "stay_id", "age", "sex", "unit_admitted"))
    scalars = stays.agg(F.countDistinct(key).alias("n_patients"), F.avg("age").alias("age_mean"),
                        F.stddev_samp("age").alias("age_std"))
    scal = scalars.select(F.inline(F.array(
        F.struct(F.lit("n_patients").alias("metric"), F.lit(None).cast("string").alias("category"), F.col("n_patients").cast("double").alias("value")),
        F.struct(F.lit("age_mean").alias("metric"), F.lit(None).cast("string").alias("category"), F.col("age_mean").alias("value")),
        F.struct(F.lit("age_std").alias("metric"), F.lit(None).cast("string").alias("category"), F.col("age_std").alias("value")))))
    first_stay = stays.groupBy(key).agg(F.min_by("sex", "stay_id").alias("sex"))
    sex = first_stay.groupBy("sex").agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("sex_count").alias("metric"), F.col("sex").alias("category"), "value")
    unit = stays.groupBy("unit_admitted").agg(F.count(F.lit(1)).cast("double").alias("value")) \
        .select(F.lit("unit_count").alias("metric"), F.col("unit_admitted").alias("category"), "value")
    return scal.unionByName(sex).unionByName(unit)


def label_histogram(tall: DataFrame, label: str, bins: int = 20) -> DataFrame:
    """F24 data part: per (channel, label) equal-width histogram over the channel's range."""
    rng = tall.groupBy("channel").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
    # one row per channel: a proven bound for the broadcast
    j = tall.join(F.broadcast(rng), "channel")
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.floor((F.col("value") - F.col("_lo")) / width * bins), F.lit(bins - 1))).cast("int")
    h = j.groupBy("channel", label, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.first("_lo").alias("_lo"), F.first("_hi").alias("_hi"))
    return h.select("channel", label, "bin",
                    (F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins).alias("bin_start"), "n")


def entity_profile(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"), F.max(label).cast("int").alias("ever_positive"))


def example_entities(df: DataFrame, key: str, label: str, n_per_group: int = 2, min_timesteps: int = 20) -> DataFrame:
    """G8 + D11: first ``n_per_group`` entities of each class in id order with at least ``min_timesteps`` rows."""
    prof = entity_profile(df, key, label).filter(F.col("n_rows") >= min_timesteps)
    w = Window.partitionBy("ever_positive").orderBy(key)
    # the per-class window only sees entities (one row each); Spark's
    # window-group-limit keeps just the first n rows per class before the sort.
    return prof.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n_per_group)


def cohort_pick(df: DataFrame, key: str, label: str, n_positive: int, n_negative: int, scan_limit: int) -> DataFrame:
    """Among the first ``scan_limit`` entities (id order) take n positives and n all-negatives."""
    prof = entity_profile(df, key, label)
    scanned = prof.orderBy(key).limit(scan_limit)
    w = Window.partitionBy("ever_positive").orderBy(key)
    ranked = scanned.withColumn("rank", F.row_number().over(w))
    return ranked.filter(((F.col("ever_positive") == 1) & (F.col("rank") <= n_positive)) |
                         ((F.col("ever_positive") == 0) & (F.col("rank") <= n_negative)))


def all_null_channels(df: DataFrame, channels: Sequence[str], key: str) -> DataFrame:
    """Per entity, the channels that never have a value."""
    per = df.groupBy(key).agg(*[F.count(c).alias(c) for c in channels])
    return per.select(key, F.filter(F.array(*[F.when(F.col(c) == 0, F.lit(c)) for c in channels]),
                                    lambda x: x.isNotNull()).alias("empty_channels"))
