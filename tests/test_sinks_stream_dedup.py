import datetime as dt
import os
import tempfile

from pyspark.sql import functions as F

from wardline.operators import ml
from wardline.plans import preprocess
from wardline.sources import files, standin
from wardline.streaming import jobs

SF = "/root/testdata/sf0.001"


def test_windows_roundtrip_by_split_and_metadata(spark):
    p = preprocess.prepare(standin.readings_wide(spark, SF), standin.CHANNELS)
    out = tempfile.mkdtemp(prefix="wl-win-")
    preprocess.write_windows(p.windows, os.path.join(out, "windows"))
    test = files.read_windows(spark, os.path.join(out, "windows"), "test")
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()
    assert test.count() == p.windows.filter("split = 'test'").count() > 0
    meta = preprocess.metadata_row(p, {"window_size": 8}).first()
    assert set(meta.medians) == set(standin.CHANNELS) and meta.params["window_size"] == "8"
    files.write_sorted(p.filled, os.path.join(out, "filled"), ["patient_id", "ICULOS"], partitions=3)
    back = spark.read.parquet(os.path.join(out, "filled"))
    assert back.count() == p.filled.count()


def test_sample_is_deterministic_and_without_replacement(spark):
    p = preprocess.prepare(standin.readings_wide(spark, SF), standin.CHANNELS)
    a = [(r.patient_id, r.window_end_idx) for r in ml.sample_windows(p.windows, 20, 1).collect()]
    b = [(r.patient_id, r.window_end_idx) for r in ml.sample_windows(p.windows, 20, 1).collect()]
    assert a == b and len(set(a)) == 20


def test_stream_dedup_alert_ids(spark):
    base = tempfile.mkdtemp(prefix="wl-dedup-")
    src = os.path.join(base, "src")
    os.makedirs(src)
    t0 = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "p", t0), (1, "p", t0), (2, "p", t0 + dt.timedelta(minutes=1))],
                               "id long, patient_id string, created_at timestamp")
    df.write.mode("overwrite").parquet(src)
    s = spark.readStream.schema(df.schema).parquet(src)
    jobs.run_available(jobs.dedup_alert_ids(s), os.path.join(base, "out"), os.path.join(base, "ckpt"))
    assert sorted(r.id for r in spark.read.parquet(os.path.join(base, "out")).collect()) == [1, 2]


def test_once_only_landing_keeps_late_rows_and_bounds_its_state(spark):
    from wardline.streaming import once
    base = tempfile.mkdtemp(prefix="wl-once-")
    src, out, ckpt = (os.path.join(base, x) for x in ("src", "out", "ckpt"))
    schema = "id long, created_at timestamp, arrived timestamp, note string"
    t0 = dt.datetime(2024, 1, 1)

    def run(rows):
        spark.createDataFrame([(i, t0 + dt.timedelta(hours=h), t0 + dt.timedelta(hours=a), n) for i, h, a, n in rows], schema) \
            .coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(schema).parquet(src)
        return sorted((r.id, r.note) for r in once.land_once(s, ["id"], out, ckpt, "arrived", "2 hours", 4).collect())

    def held():
        return spark.read.format("statestore").load(ckpt).count()

    run([(1, 0, 0, "a"), (1, 0, 0, "a"), (2, 0, 0, "b")])
    assert held() == 2
    # within the horizon the state knows 2; 3 is days late by its own time but new
    first = run([(2, 0, 1, "again"), (3, -99, 1, "late")])
    assert sorted(i for i, _ in first if i is not None) == [1, 2, 3] and ("late" in dict(first).values())
    run([(10 + k, 50, 50, "x") for k in range(5)])
    run([(20 + k, 60, 60, "x") for k in range(5)])
    # 1, 2 and 3 are forgotten by the state, not by the table
    assert held() <= 10
    got = run([(1, 0, 61, "dup"), (3, -99, 61, "dup"), (4, -50, 61, "late too")])
    assert [n for _, n in got if n == "dup"] == [] and dict((i, n) for i, n in got if i == 4) == {4: "late too"}
    assert sorted(i for i, _ in got if i is not None) == [1, 2, 3, 4, *range(10, 15), *range(20, 25)]
    # a replayed micro-batch lands its own rows again, others' folders stay
    batches = sorted(f for f in os.listdir(out) if f.startswith("_batch="))
    assert len(batches) >= 5
    again = spark.createDataFrame([(4, t0, t0, "late too"), (1, t0, t0, "dup")], schema).withColumn("_bucket", once._bucket(["id"], 4))
    last = int(batches[-1].split("=")[1])
    assert [r.id for r in once.new_rows(again, out, last, ["id"], 4).collect()] in ([4], [])
    assert [r.id for r in once.new_rows(again, out, last + 1, ["id"], 4).collect()] == []


def test_once_only_landing_begins_with_an_empty_file(spark):
    from wardline.streaming import once
    base = tempfile.mkdtemp(prefix="wl-once-empty-")
    src, schema = os.path.join(base, "src"), "id long, note string"
    for rows in ([], [(1, "a"), (2, "b"), (None, "c")], [(2, "b"), (3, "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    got = once.land_once(s, ["id"], os.path.join(base, "out"), os.path.join(base, "ckpt"), horizon="0 seconds")
    assert sorted(got.collect(), key=str) == sorted([(1, "a"), (2, "b"), (3, "d"), (None, "c")], key=str)
