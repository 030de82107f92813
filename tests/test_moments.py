import os
import tempfile

import numpy as np

from wardline.operators import eda, moments


def test_days_added_one_by_one_equal_the_whole(spark):
    rnd = np.random.default_rng(2)
    n = 400
    a = 1e6 + rnd.normal(size=n)
    rows = [(int(i // 100), float(a[i]) if i % 7 else None, float(a[i] * 2 + rnd.normal()) if i % 5 else None, float("nan") if i % 3 == 0 else 4.0)
            for i in range(n)]
    df = spark.createDataFrame(rows, "day int, A double, B double, C double")
    path = os.path.join(tempfile.mkdtemp(prefix="wl-moments-"), "m")
    for days in ((0, 1), (2,), (1,), (3,)):  # day 1 comes twice
        moments.add_days(df.filter(df.day.isin(*days)), ["A", "B", "C"], "day", path)
    kept = spark.read.parquet(path)
    got = {(r.channel_a, r.channel_b): r.corr for r in moments.correlation(kept).collect()}
    want = {(r.channel_a, r.channel_b): r.corr for r in eda.correlation_matrix(df, ["A", "B", "C"]).collect()}
    assert got.keys() == want.keys() and len(got) == 9
    for k in want:
        assert (got[k] is None) == (want[k] is None) and (want[k] is None or abs(got[k] - want[k]) < 1e-9), k
    stats = {r.channel: r for r in moments.channel_statistics(kept).collect()}
    col = np.array([r[1] for r in rows if r[1] is not None])
    assert stats["A"]["count"] == len(col) and abs(stats["A"].std - col.std(ddof=1)) < 1e-9 and abs(stats["A"].mean - col.mean()) < 1e-6
    assert abs(stats["A"].pct_missing - 100 * (1 - len(col) / n)) < 1e-9 and stats["C"].std == 0.0
