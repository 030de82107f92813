"""Statistics that are kept up to date (F2-F6): mergeable moments by day.

A row holds, for a pair of channels and a day, the rows of the day, the number of joint
observations, both means and the sums of squared and mixed deviations from them.
Days are merged exactly by the deviations of their means, so new days are
added without reading old ones, and a day that is written again replaces itself.
Counts, means, standard deviations, missing shares and correlations follow from
as many rows as there are pairs and days.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARTS = ("n", "mx", "my", "sxx", "syy", "sxy")


def _of_batch(x: np.ndarray, upper: tuple[np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """Moments of all pairs of columns over the rows in which both are numbers."""
    m = np.isfinite(x)
    centre = np.where(m, x, 0.0).sum(axis=0) / np.maximum(m.sum(axis=0), 1)
    x = np.where(m, x - centre, 0.0)
    m = m.astype(float)
    n, sx, sy = m.T @ m, x.T @ m, m.T @ x
    some = np.maximum(n, 1)
    out = {"n": n, "mx": sx / some + centre[:, None], "my": sy / some + centre[None, :], "sxx": (x * x).T @ m - sx * sx / some,
           "syy": m.T @ (x * x) - sy * sy / some, "sxy": x.T @ x - sx * sy / some}
    return {k: v[upper] for k, v in out.items()}


def moments(df: DataFrame, channels: Sequence[str], day: str) -> DataFrame:
    """(day, channel_a, channel_b, rows, n, mx, my, sxx, syy, sxy) of every pair a <= b."""
    channels = list(channels)
    upper = np.triu_indices(len(channels))
    names = np.array(channels)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for value, part in pdf.groupby(day, dropna=False):
                yield pd.DataFrame({day: value, "channel_a": names[upper[0]], "channel_b": names[upper[1]], "rows": float(len(part)),
                                    **_of_batch(part[channels].to_numpy(float), upper)})

    schema = f"{day} {df.schema[day].dataType.simpleString()}, channel_a string, channel_b string, rows double, " + ", ".join(f"{p} double" for p in PARTS)
    values = df.select(day, *[F.col(c).cast("double").alias(c) for c in channels])
    return merge(values.mapInPandas(run, schema), [day])


def merge(parts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Moments of the union of all parts with the same ``by``."""
    key = [*by, "channel_a", "channel_b"]
    n = F.sum("n")
    mean = parts.groupBy(*key).agg(F.when(n > 0, F.sum(F.col("n") * F.col("mx")) / n).alias("_x"), F.when(n > 0, F.sum(F.col("n") * F.col("my")) / n).alias("_y"))
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"m.{k}")) for k in key]
    on = same[0]
    for s in same[1:]:
        on &= s
    both = parts.alias("p").join(mean.alias("m"), on).select("p.*", (F.col("mx") - F.col("_x")).alias("dx"), (F.col("my") - F.col("_y")).alias("dy"))
    some = F.col("n") > 0
    out = both.groupBy(*key).agg(
        F.sum("rows").alias("rows"), F.sum("n").alias("n"),
        F.when(F.sum("n") > 0, F.sum(F.when(some, F.col("n") * F.col("mx"))) / F.sum("n")).otherwise(0.0).alias("mx"),
        F.when(F.sum("n") > 0, F.sum(F.when(some, F.col("n") * F.col("my"))) / F.sum("n")).otherwise(0.0).alias("my"),
        *[F.coalesce(F.sum(F.when(some, F.col(s) + F.col("n") * F.col(a) * F.col(b))), F.lit(0.0)).alias(s)
          for s, a, b in (("sxx", "dx", "dx"), ("syy", "dy", "dy"), ("sxy", "dx", "dy"))])
    return out


def add_days(df: DataFrame, channels: Sequence[str], day: str, path: str) -> None:
    """Add the days of ``df`` to the table at ``path``; days that it holds already are replaced."""
    (moments(df, channels, day).repartition(day).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(day).parquet(path))


def channel_statistics(parts: DataFrame) -> DataFrame:
    """count, mean, std (ddof 1) and percentage missing of every channel."""
    m = merge(parts).filter("channel_a = channel_b")
    return m.select(F.col("channel_a").alias("channel"), F.col("n").cast("long").alias("count"), F.when(F.col("n") > 0, F.col("mx")).alias("mean"),
                    F.when(F.col("n") > 1, F.sqrt(F.col("sxx") / (F.col("n") - 1))).alias("std"),
                    (100.0 * (1.0 - F.col("n") / F.col("rows"))).alias("pct_missing"))


def correlation(parts: DataFrame, min_periods: int = 30) -> DataFrame:
    """pairwise-complete Pearson of every ordered pair, null when fewer than ``min_periods`` joint observations."""
    m = merge(parts)
    varies = (F.col("sxx") > 0) & (F.col("syy") > 0)
    r = F.when((F.col("n") >= min_periods) & varies,
               F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))))
    pairs = m.select("channel_a", "channel_b", r.alias("corr"))
    return pairs.unionByName(pairs.filter("channel_a <> channel_b").select(
        F.col("channel_b").alias("channel_a"), F.col("channel_a").alias("channel_b"), "corr"))
