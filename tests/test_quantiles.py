import numpy as np

from wardline.operators.quantiles import exact_quantiles


def test_exact_quantiles_match_numpy_with_ties_and_coarse_bracket(spark):
    rng = np.random.default_rng(3)
    a = np.concatenate([rng.normal(size=3000), np.full(2000, 0.25)])  # a third of the rows share one value
    b = rng.integers(0, 5, size=5000).astype(float)
    rows = [(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))]
    df = spark.createDataFrame(rows, "a double, b double")
    qs = [0.1, 0.25, 0.5, 0.75, 0.99]
    bb = np.array([r[1] for r in rows if r[1] is not None])
    got, _ = exact_quantiles(df, ["a", "b"], qs)
    for q in qs:
        assert abs(got[("a", q)] - np.quantile(a, q)) < 1e-12
        assert abs(got[("b", q)] - np.quantile(bb, q)) < 1e-12


def test_exact_quantiles_of_extreme_and_missing_values(spark):
    x = [1e308, -1e308, 5e-324, 0.0, 1.0, 1.0 + 2**-52, -3.5, 1e-300, 7.0]
    df = spark.createDataFrame([(v, None, float("nan") if v == 7.0 else v) for v in x], "a double, none double, b double")
    got, _ = exact_quantiles(df, ["a", "none", "b"], [0.0, 0.5, 0.875, 1.0])
    for q in (0.0, 0.5, 0.875, 1.0):
        assert got["a", q] == np.quantile(np.array(x), q) and got["none", q] is None
    assert got["b", 1.0] == 1e308


def test_counting_passes_return_as_many_rows_for_any_input_size(spark, monkeypatch):
    """Rows that reach the driver in a pass depend on the buckets, not on the input."""
    from wardline.operators import quantiles
    seen, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda df, iv: seen.append(narrow(df, iv)) or seen[-1])
    for n in (2_000, 50_000):
        quantiles.exact_quantiles(spark.range(n).selectExpr("cast(pmod(xxhash64(id), 1000003) as double) as v"), ["v"], [0.25, 0.5])
    assert max(len(parts) for call in seen for parts in call.values()) <= quantiles.BUCKETS
