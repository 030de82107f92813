"""M1 batch preprocessing: split → fill → train medians → fill → train scaler → windows.

Two small driver round trips (medians, scaler: len(channels) x 3 numbers) are
the only collects. The split happens before any statistic (no leakage).
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import fill, impute, split as splitting, windows as win
from wardline.session import reliable_checkpoint
from wardline.sources import files


@dataclass
class Prepared:
    split: DataFrame
    filled: DataFrame
    medians: dict
    imputed: DataFrame
    scaler: dict
    normalized: DataFrame
    windows: DataFrame


def prepare(readings: DataFrame, channels: Sequence[str], key: str = "patient_id", order: str = "ICULOS",
            label: str = "SepsisLabel", val_size: float = 0.15, test_size: float = 0.15, seed: int = 42,
            window_size: int = 8, stride: int = 1, cell_type: str = "float", exact_median: bool = True,
            materialize: bool = True, bucket_width: int | None = None) -> Prepared:
    """``bucket_width`` (in ``order`` units) switches fill and windows to their
    bucketed forms for tables where one entity can hold unbounded rows."""
    sp = splitting.split_entities(readings, key, label, val_size, test_size, seed)
    with_split = splitting.attach_split(readings, sp, key)
    filled = fill.ffill_bfill(with_split, channels, key, order, bucket_width=bucket_width)
    if materialize:
        # H-4: the filled frame feeds two statistics and the windows; cut lineage once.
        filled = reliable_checkpoint(filled)
    medians, scaler = impute.fit_medians_and_scaler(filled, channels, exact=exact_median)
    imputed = impute.fill_with(filled, medians, channels)
    normalized = impute.apply_scaler(imputed, scaler, channels)
    windows = win.build_windows(normalized, channels, window_size, stride, key, order, label,
                                cell_type=cell_type, extra=["split"], bucket_width=bucket_width)
    return Prepared(sp, filled, medians, imputed, scaler, normalized, windows)


def split_summary(windows: DataFrame, key: str = "patient_id") -> DataFrame:
    """per split n_patients, n_windows, window_positive_rate (0.0 when empty)."""
    return windows.groupBy("split").agg(
        F.countDistinct(key).alias("n_patients"), F.count(F.lit(1)).alias("n_windows"),
        F.coalesce(F.avg("y"), F.lit(0.0)).alias("window_positive_rate"))


def write_windows(windows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """B1: windows partitioned by split (a later reader prunes to one split)."""
    windows.write.mode(mode).partitionBy("split").parquet(path)


def run(readings: DataFrame, channels: Sequence[str], out_dir: str, source: str = "physionet_2019", **params) -> DataFrame:
    """M1 from readings to written windows (B1), the split's patient ids and the metadata (B2).

    Patient ids are a table of their own, by split, because their number grows
    with the input; the metadata row has the counts of each split.
    """
    prep = prepare(readings, channels, **params)
    write_windows(prep.windows, os.path.join(out_dir, "windows"))
    prep.split.select("patient_id", "split").write.mode("overwrite").partitionBy("split").parquet(os.path.join(out_dir, "patient_ids"))
    # one row per split
    counts = split_summary(readings.sparkSession.read.parquet(os.path.join(out_dir, "windows")))
    counts = {r["split"]: {k: float(r[k]) for k in ("n_patients", "n_windows", "window_positive_rate")} for r in counts.collect()}
    meta = metadata_row(prep, {"source": source, "channels": ",".join(channels), "n_channels": len(channels), **params}, counts)
    files.write_json(meta, os.path.join(out_dir, "metadata"))
    return meta


def metadata_row(prep: Prepared, params: dict, counts: dict | None = None) -> DataFrame:
    """B2: one-row metadata table (params, medians, scaler, counts by split); ids stay in ``prep.split``."""
    spark = prep.windows.sparkSession
    row = {"params": {k: str(v) for k, v in params.items()},
           "medians": {k: float(v) for k, v in prep.medians.items()},
           "scaler_mean": {k: float(v[0] or 0.0) for k, v in prep.scaler.items()},
           "scaler_std": {k: float(v[1]) for k, v in prep.scaler.items()}, "counts": counts or {}}
    return spark.createDataFrame([row], "params map<string,string>, medians map<string,double>, scaler_mean map<string,double>, "
                                        "scaler_std map<string,double>, counts map<string,map<string,double>>")
