"""M5: sample → score → representative windows → attribution → global ranking → records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.operators import attribution, ml


def explain(model, windows: DataFrame, channels: Sequence[str], id_cols: Sequence[str] = ("patient_id", "window_end_idx"),
            n_background: int | None = None, n_explain: int | None = None, top_n: int = 10, seed: int = 42) -> dict[str, DataFrame]:
    """``model``: a fitted Spark ML classifier, or a function from (n, steps, channels) to n probabilities."""
    train = windows.filter(F.col("split") == "train")
    # all train windows, as in the registered query; a sample (K6) only when asked for
    background = train if n_background is None else ml.sample_windows(train, n_background, seed, id_cols)
    fill = ml.background_fill(background, len(channels)).first()["fill"]
    target = windows.filter(F.col("split") == "test")
    if n_explain is not None:
        target = ml.sample_windows(target, n_explain, seed + 1, id_cols)

    predict = model if callable(model) else ml.logistic_predictor(model)
    scored = ml.score(target.select(*id_cols, "y", "X"), predict).select(*id_cols, "y", "probability")
    expl = attribution.explain_windows(target.select(*id_cols, "X"), channels, F.array(*[F.lit(float(v)) for v in fill]),
                                       list(id_cols), predict, seed)
    records = attribution.top_contributions(attribution.additivity_gap(expl), top_n, channels) \
        .withColumn("explanation_method", F.lit("shap"))
    return {"examples": ml.example_windows(scored), "explanations": records,
            "global_importance": attribution.global_importance(expl)}
