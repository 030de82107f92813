import numpy as np
from pyspark.sql import functions as F

from wardline.operators import attribution, ml


def test_attribution_is_additive(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=(4, 4)).round(3).tolist()) for i in range(50)]
    w = spark.createDataFrame(rows, "wid long, X array<array<double>>")

    def predict(X):
        m = X.mean(axis=1)
        return 1 / (1 + np.exp(-(m[:, 0] * m[:, 1] + np.sin(m[:, 2]) - m[:, 3] ** 2)))

    fill = F.array(*[F.lit(float(v)) for v in [0.1, -0.2, 0.3, 0.0]])
    expl = attribution.explain_windows(w, ["a", "b", "c", "d"], fill, ["wid"], predict)
    gaps = [abs(r.additivity_gap) for r in attribution.additivity_gap(expl).collect()]
    assert len(gaps) == 50 and max(gaps) < 1e-9
    r = attribution.top_contributions(expl, 2, ["a", "b", "c", "d"]).first()
    top = r.top_contributing_features
    assert len(top) == 2 and abs(top[0].contribution) >= abs(top[1].contribution)
    last = dict(rows)[r.wid][-1]
    assert [t.observed_value for t in top] == [last["abcd".index(t.feature)] for t in top]


def test_walks_match_scoring_each_coalition_alone():
    rng = np.random.default_rng(5)
    x, fill, order = rng.normal(size=(3, 4)), rng.normal(size=4), np.array([2, 0, 3, 1])

    def predict(X):
        return np.tanh(X.sum(axis=1)[:, 0] * X[:, -1, 1] + X[:, 0, 2] - X[:, 1, 3])

    want = np.zeros(4)
    for walk in (order, order[::-1]):
        now = np.tile(fill, (3, 1))
        for c in walk:
            before = predict(now[None])[0]
            now = now.copy()
            now[:, c] = x[:, c]
            want[c] += (predict(now[None])[0] - before) / 2
    base, full, got = attribution.score_walks(x, order, fill, predict)
    assert np.allclose(got, want) and np.isclose(base, predict(np.tile(fill, (1, 3, 1)))[0]) and np.isclose(full, predict(x[None])[0])


def test_ties_go_by_channel_position(spark):
    df = spark.createDataFrame([({"b": 0.5, "a": -0.5, "c": 0.1},)], "shap_values map<string,double>")
    top = attribution.top_contributions(df, 2, ["c", "b", "a"]).first().top_contributing_features
    assert [t.feature for t in top] == ["b", "a"]


def test_rf_importance_ranks_informative_first(spark):
    rng = np.random.default_rng(1)
    inf, noise = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in zip(inf, noise)], "informative double, noise double, y int")
    imp = ml.rf_importance(df, ["informative", "noise"], "y", num_trees=20, max_depth=5).collect()
    assert imp[0].channel == "informative" and abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_rf_importance_of_many_rows_comes_from_several_forests(spark, monkeypatch):
    rng = np.random.default_rng(1)
    inf, noise = rng.normal(size=500), rng.normal(size=500)
    df = spark.createDataFrame([(float(a), float(b), int(a > 0)) for a, b in zip(inf, noise)], "informative double, noise double, y int")
    monkeypatch.setattr(ml, "FOREST_COUNTS", 500 * 4)
    fits, fit = [], ml.RandomForestClassifier.fit
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, data: fits.append((self.getNumTrees(), self.getSeed())) or fit(self, data))
    imp = ml.rf_importance(df, ["informative", "noise"], "y", num_trees=10, max_depth=4).collect()
    assert [n for n, _ in fits] == [4, 4, 2] and len({s for _, s in fits}) == 3
    assert imp[0].channel == "informative" and abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_rf_importance_keeps_nodes_and_sorts_rows_of_several_forests(spark, monkeypatch):
    rng = np.random.default_rng(2)
    inf, noise = rng.integers(0, 20, 400) / 4, rng.normal(size=400)
    df = spark.createDataFrame([(float(a), float(b), int(a > 2)) for a, b in zip(inf, noise)], "informative double, noise double, y int").coalesce(1)
    seen, fit = [], ml.RandomForestClassifier.fit

    def kept(self, data):
        seen.append((self.getCacheNodeIds(), [r.features[0] for r in data.select("features").collect()]))
        return fit(self, data)

    monkeypatch.setattr(ml.RandomForestClassifier, "fit", kept)
    one = ml.rf_importance(df, ["informative", "noise"], "y", num_trees=6, max_depth=4, balanced=False).collect()
    assert [k for k, _ in seen] == [True]
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", lambda self, data: fit(self.setCacheNodeIds(False), data))
    assert one == ml.rf_importance(df, ["informative", "noise"], "y", num_trees=6, max_depth=4, balanced=False).collect()
    monkeypatch.setattr(ml.RandomForestClassifier, "fit", kept)
    monkeypatch.setattr(ml, "FOREST_COUNTS", 400 * 3)
    imp = ml.rf_importance(df, ["informative", "noise"], "y", num_trees=6, max_depth=4, balanced=False).collect()
    assert [k for k, _ in seen[1:]] == [True, True] and all(rows == sorted(inf.tolist()) for _, rows in seen[1:])
    assert imp[0].channel == "informative" and abs(sum(r.importance for r in imp) - 1) < 1e-9


def test_entry_and_registry(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0 and "window_end_idx" in df.columns
    assert set(E.oracle_sql()) <= set(E.queries())
