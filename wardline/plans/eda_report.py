"""M3 EDA report: every statistic as a DataFrame, optionally written as CSV."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import eda, ml, windows as win
from wardline.session import reliable_checkpoint
from wardline.sources import files


def run_eda(readings: DataFrame, channels: Sequence[str], key: str = "patient_id", label: str = "SepsisLabel",
            windows: DataFrame | None = None, tall_readings: DataFrame | None = None, stays: DataFrame | None = None, out_dir: str | None = None, exact: bool = True) -> dict[str, DataFrame]:
    # every statistic below reads the same readings: materialise them once
    readings = reliable_checkpoint(readings)
    res = {
        "descriptive_statistics": eda.descriptive_stats(readings, channels, exact),
        "label_group_statistics": eda.label_group_stats(readings, channels, label),
        "missingness_report": eda.missingness(readings, channels).orderBy(F.col("pct_missing").desc()),
        "missingness_by_patient": eda.missingness_by_entity(readings, channels, key),
        "correlation_matrix": eda.correlation_matrix(readings, channels),
        "example_patients": eda.example_entities(readings, key, label),
    }
    res["top_correlated_pairs"] = eda.top_pairs(res["correlation_matrix"], channels, 15)
    tall = readings.unpivot([key, label], list(channels), "channel", "value").filter(F.col("value").isNotNull())
    res["distributions_by_label"] = eda.label_histogram(tall, label)
    if tall_readings is not None:
        res["channel_coverage"] = eda.channel_coverage(tall_readings, key)
    if stays is not None:
        res["demographics"] = eda.demographics(stays)
    if windows is not None:
        train = windows.filter(F.col("split") == "train")
        if train.limit(1).count():  # K2 is skipped when no train windows exist (as in the reference)
            lt = train.select(win.last_timestep(F.col("X")).alias("_v"), "y")
            res["feature_importance"] = ml.rf_importance(lt.select(*[F.col("_v")[i].alias(c) for i, c in enumerate(channels)], "y"),
                                                         channels, "y")
    res["summary"] = eda.summary(readings, channels, key, label, res["missingness_report"], res["top_correlated_pairs"],
                                 res.get("feature_importance"))
    if out_dir:
        for name, df in res.items():
            files.write_csv(df, os.path.join(out_dir, "stats", name))
    return res
