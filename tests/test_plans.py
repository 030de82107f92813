import os
import tempfile

from pyspark.sql import functions as F

from wardline.operators import ml
from wardline.plans import eda_report, explain, preprocess
from wardline.sources import standin

SF = "/root/testdata/sf0.001"


def test_eda_report_writes_every_statistic(spark):
    rw = standin.readings_wide(spark, SF)
    p = preprocess.prepare(rw, standin.CHANNELS)
    out = tempfile.mkdtemp(prefix="wl-eda-")
    res = eda_report.run_eda(rw, standin.CHANNELS, windows=p.windows, out_dir=out)
    assert "feature_importance" in res and abs(sum(r.importance for r in res["feature_importance"].collect()) - 1) < 1e-9
    for name in res:
        assert os.path.isdir(os.path.join(out, "stats", name))
    assert res["missingness_report"].count() == len(standin.CHANNELS)


def test_explain_plan_is_additive_and_ranked(spark):
    p = preprocess.prepare(standin.readings_wide(spark, SF), standin.CHANNELS)
    model, _ = ml.train_window_classifier(p.windows, reg=(0.01,), max_iter=10)
    res = explain.explain(model, p.windows, standin.CHANNELS, n_background=20, n_explain=15, top_n=3)
    ex = res["explanations"].collect()
    assert len(ex) == 15 and max(abs(r.additivity_gap) for r in ex) < 1e-9
    assert all(len(r.top_contributing_features) == 3 for r in ex)
    g = res["global_importance"].collect()
    assert len(g) == len(standin.CHANNELS) and g[0].mean_abs_contribution >= g[-1].mean_abs_contribution
    assert res["examples"].select(F.col("max_prob_positive.y")).first()[0] in (1, None)
