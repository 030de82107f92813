"""M4: train on the train split, select on validation, evaluate on test, write metrics."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import ml, ranking
from wardline.sources import files

RATIOS = ("precision", "recall_sensitivity", "specificity", "f1_score", "accuracy")


def scored_split(model, windows: DataFrame, split: str = "test", label: str = "y") -> DataFrame:
    """(y, score) of every window of a split."""
    data = windows.filter(F.col("split") == split).select(ml.flat_features(F.col("X")).alias("features"),
                                                          F.col(label).cast("int").alias("y"))
    scored = model.transform(data)
    return scored.select("y", ml.probability(scored).alias("score"))


def metrics_row(scored: DataFrame) -> DataFrame:
    """One nested row: areas, n_samples, positive_rate, and the metrics at 0.5 and at the best-F1 threshold."""
    cum = ranking.cumulative_desc(ranking.score_histogram(scored))
    best = ranking.best_f1_threshold(cum).collect()[0]["threshold"]
    fields = ["threshold", "tn", "fp", "fn", "tp", *RATIOS]
    at = [ranking.confusion_at(scored, t).select(F.struct(*fields).alias(name))
          for t, name in ((0.5, "metrics_at_0_5"), (best, "metrics_at_best_f1_threshold"))]
    summary = scored.agg(F.count(F.lit(1)).alias("n_samples"), F.avg((F.col("y") == 1).cast("double")).alias("positive_rate"))
    # four tables of one row each
    return ranking.auroc_auprc(cum).crossJoin(summary).crossJoin(at[0]).crossJoin(at[1])


def text_report(scored: DataFrame, threshold: float) -> DataFrame:
    """The per-class report as lines of text (five of them and a header)."""
    cell = lambda c: F.lpad(F.coalesce(F.format_string("%.2f", F.col(c)), F.lit("")), 10, " ")
    lines = ranking.classification_report(scored, threshold).select(
        F.concat(F.lpad("label", 14, " "), cell("precision"), cell("recall"), cell("f1_score"),
                 F.lpad(F.format_string("%.0f", F.col("support")), 10, " ")).alias("value"))
    head = scored.sparkSession.createDataFrame(
        [("".join(["label".rjust(14), *(n.rjust(10) for n in ("precision", "recall", "f1-score", "support"))]),)], "value string")
    return head.unionByName(lines)


def train_and_evaluate(windows: DataFrame, out_dir: str | None = None):
    """(model, candidates, metrics row); with ``out_dir`` also the sidecar, the text report and the ROC points."""
    model, candidates = ml.train_window_classifier(windows)
    scored = scored_split(model, windows).persist()
    try:
        metrics = metrics_row(scored)
        if out_dir:
            files.write_json(metrics, os.path.join(out_dir, "metrics"))
            files.write_json(candidates, os.path.join(out_dir, "candidates"))
            threshold = metrics.first()["metrics_at_best_f1_threshold"]["threshold"]
            text_report(scored, threshold).coalesce(1).write.mode("overwrite").text(os.path.join(out_dir, "report"))
            files.write_csv(ranking.roc_points(ranking.cumulative_desc(ranking.score_histogram(scored))),
                            os.path.join(out_dir, "roc"))
    finally:
        scored.unpersist()
    return model, candidates, metrics
