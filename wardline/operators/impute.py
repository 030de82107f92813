"""Train-only statistics (F11, F12) and their application."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators.quantiles import exact_quantiles


def _median(c: str, exact: bool):
    return F.median(c) if exact else F.percentile_approx(c, 0.5, 100000)


def median_frame(df: DataFrame, channels: Sequence[str], split_col: str = "split",
                 fit_split: str = "train", exact: bool = True) -> DataFrame:
    """F11 as a table: (channel, median), train rows only, all-missing → 0.0."""
    train = df.filter(F.col(split_col) == fit_split)
    if exact:
        med, _ = exact_quantiles(train, channels, [0.5])
        rows = [(c, float(med[(c, 0.5)]) if med[(c, 0.5)] is not None else 0.0) for c in channels]
        return df.sparkSession.createDataFrame(rows, "channel string, median double")
    row = train.agg(*[_median(c, exact).alias(c) for c in channels])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias("median"))
        for c in channels])))


def scaler_frame(df: DataFrame, channels: Sequence[str], split_col: str = "split",
                 fit_split: str = "train") -> DataFrame:
    """F12 as a table: (channel, mean, std); std of 0 or undefined → 1.0."""
    aggs = []
    for c in channels:
        aggs += [F.avg(c).alias(f"{c}__m"), F.stddev_samp(c).alias(f"{c}__s")]
    row = df.filter(F.col(split_col) == fit_split).agg(*aggs)

    def std(c):
        s = F.col(f"{c}__s")
        return F.when(s.isNull() | F.isnan(s) | (s == 0), F.lit(1.0)).otherwise(s)

    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("channel"), F.col(f"{c}__m").cast("double").alias("mean"), std(c).alias("std"))
        for c in channels])))


def fit_medians(df: DataFrame, channels: Sequence[str], split_col: str = "split", exact: bool = True) -> dict[str, float]:
    """Driver copy of the medians: one row of len(channels) numbers."""
    return {r["channel"]: r["median"] for r in median_frame(df, channels, split_col, exact=exact).collect()}


def fit_scaler(df: DataFrame, channels: Sequence[str], split_col: str = "split") -> dict[str, tuple[float, float]]:
    return {r["channel"]: (r["mean"], r["std"]) for r in scaler_frame(df, channels, split_col).collect()}


def fit_medians_and_scaler(df: DataFrame, channels: Sequence[str], split_col: str = "split", fit_split: str = "train",
                           exact: bool = True) -> tuple[dict[str, float], dict[str, tuple[float, float]]]:
    """F11 + F12 in one pass over the train rows.

    The scaler is fitted on the median-filled values, which are the observed
    values plus (n_total - n_observed) copies of the median; their mean and
    variance follow exactly from the observed count, mean and sum of squared
    deviations with the pairwise (Chan et al.) combination, so no second pass
    over the filled data is needed.
    """
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in channels:
        aggs += [F.count(c).alias(f"{c}__k"), F.avg(c).alias(f"{c}__m"), F.var_pop(c).alias(f"{c}__vp")]
    train = df.filter(F.col(split_col) == fit_split)
    if exact:
        # two distributed passes; the moments ride along in the first one
        med, row = exact_quantiles(train, channels, [0.5], extra=aggs)
        med = {c: med[(c, 0.5)] for c in channels}
    else:
        row = train.agg(*aggs, *[_median(c, False).alias(f"{c}__med") for c in channels]).collect()[0]
        med = {c: row[f"{c}__med"] for c in channels}
    n = row["_n"]
    medians, scaler = {}, {}
    for c in channels:
        fillv = float(med[c]) if med[c] is not None else 0.0
        medians[c] = fillv
        k = row[f"{c}__k"] or 0
        if n == 0:
            scaler[c] = (None, 1.0)
            continue
        if k == 0:
            mean, m2 = fillv, 0.0
        else:
            m_obs, m2_obs = float(row[f"{c}__m"]), float(row[f"{c}__vp"]) * k
            delta = fillv - m_obs
            mean = m_obs + delta * (n - k) / n
            m2 = m2_obs + delta * delta * k * (n - k) / n
        std = (m2 / (n - 1)) ** 0.5 if n > 1 else None
        scaler[c] = (mean, 1.0 if (std is None or std == 0 or std != std) else std)
    return medians, scaler


def fill_with(df: DataFrame, values: Mapping[str, float], channels: Sequence[str]) -> DataFrame:
    """Remaining gaps take the fitted value (0.0 when a channel has none)."""
    chans = set(channels)
    return df.select(*[F.coalesce(F.col(c), F.lit(float(values.get(c, 0.0) or 0.0))).alias(c) if c in chans else F.col(c)
                       for c in df.columns])


def apply_scaler(df: DataFrame, scaler: Mapping[str, tuple[float, float]], channels: Sequence[str]) -> DataFrame:
    """C4: (x - mean) / std with literals, inside whole-stage codegen."""
    chans = set(channels)
    out = []
    for c in df.columns:
        if c in chans:
            m, s = scaler[c]
            out.append(((F.col(c) - F.lit(m if m is not None else 0.0)) / F.lit(s)).alias(c))
        else:
            out.append(F.col(c))
    return df.select(*out)


def invert_scaler(df: DataFrame, scaler: Mapping[str, tuple[float, float]], channels: Sequence[str]) -> DataFrame:
    """X * std + mean."""
    chans = set(channels)
    return df.select(*[(F.col(c) * F.lit(scaler[c][1]) + F.lit(scaler[c][0] or 0.0)).alias(c) if c in chans else F.col(c)
                       for c in df.columns])
