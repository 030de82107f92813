import json
import os
import tempfile

import pytest

from wardline import vocab
from wardline.sources import files

CANON = list(vocab.CLINICAL_CHANNELS) + list(vocab.DEMOGRAPHIC_FEATURES) + [vocab.TIME_COLUMN, vocab.LABEL_COLUMN]


def _write(path, header, rows):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write("|".join(header) + "\n")
        for r in rows:
            f.write("|".join(str(r.get(c, "NaN")) for c in header) + "\n")


def _rows(n, positive_last=False, hr0=80):
    return [{"HR": hr0 + t, "ICULOS": t + 1, "SepsisLabel": int(positive_last and t == n - 1), "Age": 60} for t in range(n)]


def test_reads_by_header_name_across_orders(spark):
    root = tempfile.mkdtemp(prefix="wl-psv-")
    _write(os.path.join(root, "setA", "p000001.psv"), CANON, _rows(5))
    _write(os.path.join(root, "setA", "p000002.psv"), list(reversed(CANON)), _rows(8, True, 100))
    _write(os.path.join(root, "setB", "p100001.psv"), CANON, _rows(3))
    df = files.read_patient_files(spark, root, ["setA", "setB"])
    assert df.count() == 16 and df.columns == list(vocab.ALL_COLUMNS)
    p2 = df.filter("patient_id = 'p000002'").orderBy("ICULOS").collect()
    assert [r.HR for r in p2][:2] == [100.0, 101.0] and p2[-1].SepsisLabel == 1 and p2[0].Glucose is None
    assert files.read_patient_files(spark, root, ["setA", "setB"], limit=1).select("patient_id").distinct().collect()[0][0] == "p000001"
    with pytest.raises(Exception):
        files.read_patient_files(spark, root, ["setC"]).count()


def test_missing_column_is_an_error(spark):
    root = tempfile.mkdtemp(prefix="wl-psv-")
    _write(os.path.join(root, "setA", "p1.psv"), [c for c in CANON if c != "Glucose"], _rows(2))
    with pytest.raises(ValueError, match="Glucose"):
        files.read_patient_files(spark, root, ["setA"])


def test_threshold_sidecar(spark):
    d = tempfile.mkdtemp(prefix="wl-thr-")
    p = os.path.join(d, "metrics.json")
    with open(p, "w") as f:
        json.dump({"metrics_at_best_f1_threshold": {"threshold": 0.31}}, f)
    assert files.load_threshold(spark, p) == 0.31
    assert files.load_threshold(spark, os.path.join(d, "absent.json")) == vocab.FALLBACK_THRESHOLD


def test_threshold_is_read_from_what_evaluation_writes(spark):
    from wardline.plans import evaluate
    rows = [(int(k % 3 == 0), 0.9 - k / 100 if k % 3 == 0 else 0.5 - k / 200) for k in range(60)]
    scored = spark.createDataFrame(rows, "y int, score double")
    d = tempfile.mkdtemp(prefix="wl-metrics-")
    files.write_json(evaluate.metrics_row(scored), os.path.join(d, "metrics"))
    row = evaluate.metrics_row(scored).first()
    assert files.load_threshold(spark, os.path.join(d, "metrics")) == row.metrics_at_best_f1_threshold.threshold
    assert row.n_samples == 60 and abs(row.positive_rate - 1 / 3) < 1e-12 and row["metrics_at_0_5"].threshold == 0.5
    lines = [r.value.split() for r in evaluate.text_report(scored, 0.5).collect()]
    assert lines[0][0] == "label" and {x[0] for x in lines[1:]} == {"0", "1", "accuracy", "macro", "weighted"}
    with open(os.path.join(d, "bad.json"), "w") as f:
        f.write("no json")
    assert files.load_threshold(spark, os.path.join(d, "bad.json")) == vocab.FALLBACK_THRESHOLD


def test_limit_goes_by_full_path(spark):
    root = tempfile.mkdtemp(prefix="wl-limit-")
    _write(os.path.join(root, "setA", "p000009.psv"), CANON, _rows(2))
    _write(os.path.join(root, "setB", "p000001.psv"), CANON, _rows(2))
    got = files.read_patient_files(spark, root, ["setA", "setB"], limit=1)
    assert {r.patient_id for r in got.collect()} == {"p000009"}


def test_patient_files_are_opened_once(spark):
    root = tempfile.mkdtemp(prefix="wl-once-open-")
    conf = {k: spark.conf.get(k) for k in ("spark.sql.files.openCostInBytes", "spark.sql.sources.parallelPartitionDiscovery.parallelism")}
    df = spark.createDataFrame([("p1", "A", 1, 80.0, 0), ("p1", "A", 2, None, 1), ("p2", "B", 1, 70.0, 0)],
                               "patient_id string, set string, ICULOS int, HR double, SepsisLabel int")
    files.write_patient_files(df, root, ["HR", "ICULOS", "SepsisLabel"])
    got = files.read_patient_files(spark, root, ["set=A", "set=B"], None, ["patient_id", "HR", "ICULOS", "SepsisLabel"],
                                   suffix=".txt", key_pattern="patient_id=([^/]+)/")
    for folder, _, names in os.walk(root):
        for name in names:
            with open(os.path.join(folder, name), "w") as f:
                f.write("changed")
    assert [tuple(r) for r in got.collect()] == [("p1", 80.0, 1, 0), ("p1", None, 2, 1), ("p2", 70.0, 1, 0)]
    assert {k: spark.conf.get(k) for k in conf} == conf


def test_tasks_write_patient_files_themselves(spark):
    root, spark_root = (os.path.join(tempfile.mkdtemp(prefix="wl-stays-"), "files") for _ in range(2))
    keys = ["p1", "p 2", "a/b:c=d%e'f\"g#h*i?j\\k{l}[m]^n\u007fo\u0001é", None, ""]
    df = spark.createDataFrame([(k, "A", t, 80.0 + t) for k in keys for t in (2, 1)], "patient_id string, set string, ICULOS int, HR double")
    for _ in range(2):  # a second time in place of the first
        files.write_patient_files(df, root, ["HR", "ICULOS"])
    df.select("set", "patient_id", "HR").write.partitionBy("set", "patient_id").parquet(spark_root)
    folders = sorted(os.listdir(os.path.join(root, "set=A")))
    assert folders == sorted(os.listdir(os.path.join(spark_root, "set=A"))) and len(folders) == 4
    for name in folders:  # one file a patient and nothing beside it: no checksum file, for which Hadoop starts a process
        assert os.listdir(os.path.join(root, "set=A", name)) == ["part-00000.txt"]
    with open(os.path.join(root, "set=A", "patient_id=p1", "part-00000.txt")) as f:
        assert f.read() == "HR|ICULOS\n81.0|1\n82.0|2\n"
    assert "_SUCCESS" in os.listdir(root)
    got = files.read_patient_files(spark, root, ["set=A"], None, ["patient_id", "HR", "ICULOS"], suffix=".txt", key_pattern="patient_id=([^/]+)/")
    assert got.count() == 10


def test_csv_table_and_topic_stream(spark):
    d = tempfile.mkdtemp(prefix="wl-csv-")
    with open(os.path.join(d, "d_items.csv"), "w") as f:
        f.write("itemid,label,linksto,extra\n220045,Heart Rate,chartevents,x\n223761,Temperature Fahrenheit,chartevents,y\n")
    t = files.read_csv_table(spark, d, "itemid long, label string, linksto string, extra string", ["itemid", "label"])
    assert t.columns == ["itemid", "label"] and t.count() == 2
    src = os.path.join(d, "msgs")
    os.makedirs(src)
    with open(os.path.join(src, "m.json"), "w") as f:
        for topic in ("icu/p1/vitals", "icu/p1/status", "icu/p2/vitals", "icu/a/b/vitals"):
            f.write(json.dumps({"topic": topic, "value": "{}", "arrival_ts": "2024-01-01T00:00:00Z"}) + "\n")
    from wardline.streaming import jobs
    jobs.run_available(files.topic_source(spark, src), os.path.join(d, "out"), os.path.join(d, "ckpt"))
    got = sorted(r.topic for r in spark.read.parquet(os.path.join(d, "out")).collect())
    assert got == ["icu/p1/vitals", "icu/p2/vitals"]
