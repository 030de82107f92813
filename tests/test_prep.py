import pytest
from pyspark.sql import functions as F

from wardline.operators import fill, impute, split as splitting, windows as win


def test_ffill_holds_last_value_and_backfills(spark):
    df = spark.createDataFrame([("p1", 1, 80.0, None), ("p1", 2, None, None), ("p1", 3, None, 110.0), ("p1", 4, 90.0, None)],
                               "patient_id string, ICULOS int, HR double, Glucose double")
    out = fill.ffill_bfill(df, ["HR", "Glucose"]).orderBy("ICULOS").collect()
    assert [r.HR for r in out] == [80, 80, 80, 90]
    assert [r.Glucose for r in out] == [110] * 4


def test_ffill_never_crosses_entities_and_keeps_unmeasured_null(spark):
    df = spark.createDataFrame([("p1", 1, 80.0, None), ("p1", 2, None, None), ("p2", 1, None, None), ("p2", 2, 95.0, None)],
                               "patient_id string, ICULOS int, HR double, Glucose double")
    out = fill.ffill_bfill(df, ["HR", "Glucose"]).orderBy("patient_id", "ICULOS").collect()
    assert [r.HR for r in out] == [80, 80, 95, 95]
    assert all(r.Glucose is None for r in out)


def test_medians_and_scaler_from_train_only(spark):
    df = spark.createDataFrame([("a", "train", 80.0, 100.0), ("b", "train", 80.0, 100.0), ("c", "test", 500.0, 999.0)],
                               "patient_id string, split string, HR double, Glucose double")
    assert impute.fit_medians(df, ["HR", "Glucose"]) == {"HR": 80.0, "Glucose": 100.0}
    sc = spark.createDataFrame([("train", 70.0), ("train", 80.0), ("train", 90.0), ("val", 500.0), ("test", -100.0)], "split string, HR double")
    s = impute.fit_scaler(sc, ["HR"])
    assert s["HR"] == (80.0, 10.0)
    z = impute.apply_scaler(sc.filter("split = 'train'"), s, ["HR"]).agg(F.avg("HR"), F.stddev("HR")).first()
    assert abs(z[0]) < 1e-12 and abs(z[1] - 1) < 1e-12
    back = impute.invert_scaler(impute.apply_scaler(sc, s, ["HR"]), s, ["HR"]).collect()
    assert [round(r.HR, 9) for r in back] == [70, 80, 90, 500, -100]


def test_all_null_median_is_zero_and_zero_std_is_one(spark):
    df = spark.createDataFrame([("train", 80.0, None), ("train", 80.0, None)], "split string, HR double, Glucose double")
    assert impute.fit_medians(df, ["HR", "Glucose"])["Glucose"] == 0.0
    assert impute.fit_scaler(df, ["HR"])["HR"][1] == 1.0


def _series(spark, n, pid="p1"):
    rows = [(pid, t, 70.0 + t, 100.0 + t, 1 if t == n else 0) for t in range(1, n + 1)]
    return spark.createDataFrame(rows, "patient_id string, ICULOS int, HR double, Glucose double, SepsisLabel int")


def test_window_count_contiguity_and_end_label(spark):
    w = win.build_windows(_series(spark, 10), ["HR", "Glucose"], 4, 1).orderBy("window_end_idx").collect()
    assert len(w) == 7
    assert [x[0] for x in w[0].X] == [71, 72, 73, 74]
    assert w[-1].y == 1 and w[0].y == 0
    assert [r.window_end_idx for r in w] == list(range(3, 10))


def test_window_first_values_and_padding(spark):
    w = win.build_windows(_series(spark, 6), ["HR", "Glucose"], 3, 1).orderBy("window_end_idx").first()
    assert [x[0] for x in w.X] == [71, 72, 73]
    p = win.build_windows(_series(spark, 2), ["HR", "Glucose"], 5, 1).collect()
    assert len(p) == 1 and [x[0] for x in p[0].X] == [71, 71, 71, 71, 72] and p[0].window_end_idx == 4


def test_window_stride_and_independence(spark):
    df = _series(spark, 10).unionByName(_series(spark, 3, "p2"))
    w = win.build_windows(df, ["HR"], 4, 3).collect()
    assert sorted((r.patient_id, r.window_end_idx) for r in w) == [("p1", 3), ("p1", 6), ("p1", 9), ("p2", 3)]


def test_window_guard_rejects_missing(spark):
    df = spark.createDataFrame([("p1", t, None if t == 3 else 1.0, 0) for t in range(1, 6)],
                               "patient_id string, ICULOS int, HR double, SepsisLabel int")
    with pytest.raises(Exception, match="fully-imputed"):
        win.build_windows(df, ["HR"], 2, 1).collect()


def test_split_disjoint_covering_stratified(spark):
    rows = [(f"p{i:03d}", t, 80.0, 1 if (i < 20 and t == 5) else 0) for i in range(100) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "patient_id string, ICULOS int, HR double, SepsisLabel int")
    sp = splitting.split_entities(df, "patient_id", "SepsisLabel").collect()
    assert len(sp) == 100 and len({r.patient_id for r in sp}) == 100
    counts = {}
    for r in sp:
        counts[r.split] = counts.get(r.split, 0) + 1
    assert abs(counts["train"] - 70) <= 2 and abs(counts["val"] - 15) <= 2 and abs(counts["test"] - 15) <= 2
    for s in ("train", "val", "test"):
        prev = sum(r.ever_positive for r in sp if r.split == s) / counts[s]
        assert 0.1 <= prev <= 0.3
    assert splitting.split_violations(spark.createDataFrame([(r.patient_id, r.split) for r in sp], "patient_id string, split string")).count() == 0


def test_split_unknown_entity_fails(spark):
    df = spark.createDataFrame([("a", 1, 0), ("b", 1, 1)], "patient_id string, ICULOS int, SepsisLabel int")
    sp = spark.createDataFrame([("a", "train")], "patient_id string, split string")
    with pytest.raises(Exception, match="not part of this split"):
        splitting.attach_split(df, sp).collect()


def test_exact_rank_matches_global_order(spark):
    df = spark.range(5000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("g"))
    df = df.withColumn("h", F.md5("k"))
    got = {(r.k): r._rank for r in splitting.exact_rank(df, "g", "h", "k", hex_digits=2).collect()}
    rows = sorted(df.collect(), key=lambda r: (r.g, r.h, r.k))
    exp, last_g, i = {}, None, 0
    for r in rows:
        i = i + 1 if r.g == last_g else 1
        last_g = r.g
        exp[r.k] = i
    assert got == exp


def test_bucketed_fill_equals_window_fill(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for p in ("a", "b", "c"):
        for t in range(1, 300):
            rows.append((p, t, rnd.choice([None, None, None, float(t)]), rnd.choice([None] * 9 + [float(-t)])))
    df = spark.createDataFrame(rows, "patient_id string, ICULOS int, HR double, Glucose double")
    a = sorted(fill.ffill_bfill(df, ["HR", "Glucose"]).collect())
    b = sorted(fill.ffill_bfill(df, ["HR", "Glucose"], bucket_width=17).collect())
    assert a == b


def test_bucketed_windows_equal_window_version(spark):
    import random
    rnd = random.Random(11)
    rows = []
    for p, n in (("a", 300), ("b", 5), ("c", 41)):
        for t in range(1, n + 1):
            rows.append((p, t * 3, float(rnd.randint(0, 9)), float(t), rnd.choice([0, 1]), "train"))
    df = spark.createDataFrame(rows, "patient_id string, ICULOS int, HR double, Glucose double, SepsisLabel int, split string")
    for w, s in ((8, 1), (4, 3), (64, 1)):
        a = sorted(win.build_windows(df, ["HR", "Glucose"], w, s, extra=["split"]).collect())
        b = sorted(win.build_windows(df, ["HR", "Glucose"], w, s, extra=["split"], bucket_width=20).collect())
        assert a == b


def test_prepare_bucketed_mode_equals_default(spark):
    from wardline.plans import preprocess
    from wardline.sources import standin
    rw = standin.readings_wide(spark, "/root/testdata/sf0.001")
    a = preprocess.prepare(rw, standin.CHANNELS)
    b = preprocess.prepare(rw, standin.CHANNELS, bucket_width=24)
    assert a.medians == b.medians
    assert all(abs(a.scaler[c][0] - b.scaler[c][0]) < 1e-9 and abs(a.scaler[c][1] - b.scaler[c][1]) < 1e-9 for c in a.scaler)
    wa = sorted(a.windows.collect(), key=lambda r: (r.patient_id, r.window_end_idx))
    wb = sorted(b.windows.collect(), key=lambda r: (r.patient_id, r.window_end_idx))
    assert [(r.patient_id, r.window_end_idx, r.y, r.split) for r in wa] == [(r.patient_id, r.window_end_idx, r.y, r.split) for r in wb]
    assert all(abs(x - y) < 1e-5 for ra, rb in zip(wa, wb) for xa, xb in zip(ra.X, rb.X) for x, y in zip(xa, xb))
