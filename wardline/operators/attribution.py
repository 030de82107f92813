"""Channel-group permutation attribution.

For each window a seeded permutation of the channels is walked forward and
backward: coalition k keeps the first k channels of the order and replaces
the others' whole traces by the background value. Every coalition row is
scored by the same model, and a channel's contribution is the score
difference when it joins, averaged over the two walks. The walks start from
the all-background window and end at the real window, so
base + sum(contributions) = prediction exactly.

Work per window is 2 x (C + 1) scored variants; the windows of an Arrow batch are
stacked into blocks of bounded size, one call of the model each. Nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.functions import clinical

BLOCK_VALUES = 1 << 22  # of the variants that are scored in one call


def explain_windows(windows: DataFrame, channels: Sequence[str], fill, id_cols: Sequence[str],
                    predict: Callable[[np.ndarray], np.ndarray], seed: int = 0) -> DataFrame:
    """K5 and K7: one row per window with base value, prediction, contributions and observed values by channel.

    All coalitions of a block of windows are one array, scored in the Arrow batch that
    holds the windows; contributions are differences inside the row. Nothing is
    shuffled. ``predict`` maps (n, steps, channels) to n probabilities.
    """
    C = len(channels)
    order = channel_order(F.concat_ws(":", *[F.col(c).cast("string") for c in id_cols], F.lit(str(seed))), C)
    rows = windows.select(*id_cols, "X", order.alias("_order"), fill.alias("_fill"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in windows.select(*id_cols).schema.fields)

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            steps = batch.column("X").flatten()
            x = steps.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(steps) // n, C)
            walk, background = (batch.column(k).flatten().to_numpy(zero_copy_only=False).reshape(n, C) for k in ("_order", "_fill"))
            at_once = max(1, BLOCK_VALUES // (2 * (C + 1) * x[0].size))
            parts = [score_windows(x[i:i + at_once], walk[i:i + at_once], background[i:i + at_once].astype(float), predict)
                     for i in range(0, n, at_once)]
            base, prediction, contribution = (np.concatenate(p) for p in zip(*parts, strict=True))
            lists = [pa.ListArray.from_arrays(np.arange(0, n * C + 1, C, dtype=np.int32), pa.array(v.reshape(-1))) for v in (contribution, x[:, -1])]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in id_cols], pa.array(base), pa.array(prediction), *lists],
                                             [*id_cols, "base_value", "prediction", "_c", "observed"])

    scored = rows.mapInArrow(run, f"{schema}, base_value double, prediction double, _c array<double>, observed array<double>")
    names = F.array(*[F.lit(c) for c in channels])
    return scored.select(*id_cols, "base_value", "prediction", F.map_from_arrays(names, "_c").alias("shap_values"),
                         F.map_from_arrays(names, "observed").alias("observed_values"))


def channel_order(wid: Column, n_channels: int) -> Column:
    """Seeded permutation of the channels of a window: channels in the order of the md5 of window, seed and position."""
    hashed = F.transform(F.sequence(F.lit(0), F.lit(n_channels - 1)),
                         lambda j: F.struct(F.md5(F.concat_ws(":", wid, j.cast("string"))).alias("h"), j.alias("j")))
    return F.transform(F.array_sort(hashed), lambda s: s["j"])


def score_windows(x: np.ndarray, order: np.ndarray, fill: np.ndarray, predict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, prediction, contributions) of windows (n, steps, channels) with their orders and backgrounds (n, channels)."""
    n, C = order.shape
    ahead = np.argsort(order, axis=1)  # place of each channel in the walk
    place = np.stack([ahead, C - 1 - ahead], axis=1)
    keep = place[:, :, None, :] < np.arange(C + 1)[None, None, :, None]
    variants = np.where(keep[:, :, :, None, :], x[:, None, None], fill[:, None, None, None])
    p = np.asarray(predict(variants.reshape(-1, *x.shape[1:])), float).reshape(n, 2, C + 1)
    contribution = np.take_along_axis(np.diff(p, axis=2), place, axis=2).mean(axis=1)
    return p[:, :, 0].mean(axis=1), p[:, :, -1].mean(axis=1), contribution


def score_walks(x: np.ndarray, order: np.ndarray, fill: np.ndarray, predict) -> tuple[float, float, list[float]]:
    """(base, prediction, contribution by channel) of one window (steps, channels)."""
    base, prediction, contribution = score_windows(x[None], order[None], fill[None], predict)
    return float(base[0]), float(prediction[0]), contribution[0].tolist()


def additivity_gap(expl: DataFrame) -> DataFrame:
    """K7 check column: prediction − (base + Σ contributions)."""
    total = F.aggregate(F.map_values("shap_values"), F.lit(0.0), lambda a, b: a + b)
    return expl.withColumn("additivity_gap", F.col("prediction") - (F.col("base_value") + total))


def top_contributions(expl: DataFrame, top_n: int = 10, channels: Sequence[str] | None = None) -> DataFrame:
    """G12 + C16 + K7: top-N entries by |contribution| with the observed value, all inside the row (no shuffle).

    Ties go by channel position (``channels``; by name without it).
    """
    place = (lambda e: F.array_position(F.array(*[F.lit(c) for c in channels]), e["key"])) if channels else (lambda e: e["key"])
    keyed = F.transform(F.map_entries("shap_values"), lambda e: F.struct(
        (-F.abs(e["value"])).alias("size"), place(e).alias("place"), e["key"].alias("key"), e["value"].alias("value")))
    top = F.slice(F.array_sort(keyed), 1, top_n)
    observed = (lambda e: F.col("observed_values")[e["key"]]) if "observed_values" in expl.columns else (lambda e: F.lit(None).cast("double"))
    return expl.withColumn("top_contributing_features", F.transform(top, lambda e: F.struct(
        e["key"].alias("feature"), e["value"].alias("contribution"), observed(e).alias("observed_value"),
        clinical.direction(e["value"]).alias("direction"))))


def global_importance(expl: DataFrame, top_n: int | None = None) -> DataFrame:
    """mean |contribution| per channel, ranked."""
    g = expl.select(F.explode("shap_values").alias("channel", "v")).groupBy("channel") \
        .agg(F.avg(F.abs("v")).alias("mean_abs_contribution"))
    g = g.orderBy(F.col("mean_abs_contribution").desc(), "channel")
    return g.limit(top_n) if top_n else g
