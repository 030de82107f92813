"""M2: conform a coded-event source (dictionaries + events + stays) and write it."""

from __future__ import annotations

import os
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.operators import conform
from wardline.sources import files


def run_conform(spark: SparkSession, chart_items: DataFrame, lab_items: DataFrame, chart_events: DataFrame,
                lab_events: DataFrame, stays: DataFrame | None = None,
                chart_candidates: Mapping[str, Sequence[str]] = vocab.CHART_LABEL_CANDIDATES,
                lab_candidates: Mapping[str, Sequence[str]] = vocab.LAB_LABEL_CANDIDATES,
                out_dir: str | None = None, fahrenheit: Sequence[str] = (vocab.FAHRENHEIT_LABEL,)) -> dict[str, DataFrame]:
    """Dictionaries: (itemid, label, linksto | fluid); events: (subject_id, charttime, itemid, valuenum)."""
    chart, lab = F.lit("chartevents").alias("kind"), F.lit("labevents").alias("kind")
    dictionary = chart_items.filter(F.col("linksto") == vocab.CHART_SOURCE_KIND).select("itemid", "label", chart).unionByName(  # D6
        lab_items.filter(F.col("fluid") == vocab.LAB_FLUID).select("itemid", "label", lab))
    counts = conform.item_counts(chart_events.select("itemid")).select("*", chart).unionByName(
        conform.item_counts(lab_events.select("itemid")).select("*", lab))
    candidates = conform.candidates_frame(spark, chart_candidates, "chartevents").unionByName(
        conform.candidates_frame(spark, lab_candidates, "labevents"))
    mapping = conform.resolve_mapping(dictionary, counts, candidates, ["chartevents", "labevents"], {"chartevents": list(fahrenheit)})
    readings = conform.conform_events(chart_events, mapping.filter(F.col("source") == "chartevents")).unionByName(
        conform.conform_events(lab_events, mapping.filter(F.col("source") == "labevents")))
    out = {"mapping": mapping, "readings": readings, "report": conform.mapping_report(readings, mapping),
           "unresolved": conform.unresolved(mapping), "mapping_lists": conform.mapping_lists(mapping)}
    if stays is not None:
        out["patients"] = stays
    if out_dir:
        files.write_sorted(readings, os.path.join(out_dir, "vitals_long"), ["patient_id", "charttime"])
        if stays is not None:
            stays.write.mode("overwrite").parquet(os.path.join(out_dir, "patients"))
        files.write_json(out["report"], os.path.join(out_dir, "mapping_report"))
        files.write_json(out["mapping_lists"], os.path.join(out_dir, "mapping_lists"))
    return out
