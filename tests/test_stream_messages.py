import json
import os
import tempfile

import pandas as pd
from pyspark.sql import functions as F

from wardline import vocab
from wardline.operators import messages
from wardline.streaming import jobs, state


def _reason(spark, raw):
    return spark.createDataFrame([(raw,)], "value string").select(messages.rejection_reason(F.col("value"))).first()[0]


def test_message_rules(spark):
    good = {"patient_id": "p1", "timestamp": "2024-01-01T00:00:00Z", "source": "iot_sensor", "channels": {"HR": 80, "Temp": None, "O2Sat": 97.5}}
    assert _reason(spark, json.dumps(good)) is None
    assert _reason(spark, json.dumps({**good, "pad": "x" * 5000})) == vocab.REJECT_TOO_LARGE
    assert _reason(spark, "{not json") == vocab.REJECT_NOT_JSON
    assert _reason(spark, json.dumps([good])) == vocab.REJECT_NOT_JSON
    assert _reason(spark, json.dumps({**good, "patient_id": ""})) == vocab.REJECT_NO_PATIENT
    assert _reason(spark, json.dumps({**good, "timestamp": ""})) == vocab.REJECT_NO_TIMESTAMP
    assert _reason(spark, json.dumps({**good, "source": "radio"})) == vocab.REJECT_BAD_SOURCE
    assert _reason(spark, json.dumps({**good, "channels": [1]})) == vocab.REJECT_CHANNELS_NOT_OBJECT
    assert _reason(spark, json.dumps({**good, "channels": {"HR": "fast"}})) == "channel 'HR' must be a number or null, got str"
    assert _reason(spark, json.dumps({**good, "channels": {"HR": True}})) is None


def test_unknown_channels_are_rejected(spark):
    rows = [(1, "icu/p/vitals", json.dumps({"patient_id": "p", "timestamp": "t", "source": "iot_sensor", "channels": c}))
            for c in ({"HR": 1}, {"HR": 1, "Zz": 2, "Aa": None}, {"HR": "x", "Zz": 1})]
    df = spark.createDataFrame(rows, "message_id long, topic string, value string")
    got = [r.reason for r in messages.validate_messages(df, vocabulary=["HR"]).collect()]
    assert got == [None, "unknown channel 'Aa'", "channel 'HR' must be a number or null, got str"]


def test_cooldown_jumps_match_a_plain_fold():
    import numpy as np
    rng = np.random.default_rng(2)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        us, rank = np.sort(rng.integers(0, 100, n)), rng.integers(1, 4, n)
        last = (None, None) if rng.random() < 0.5 else (int(rng.integers(-20, 60)), int(rng.integers(1, 4)))
        want, (t, r) = [], last
        for i in range(n):
            if t is None or rank[i] > r or us[i] - t >= 15:
                want.append(i)
                t, r = us[i], rank[i]
        assert state.raised_positions(us, rank, 15, *last) == want


def _write_events(path, rows):
    os.makedirs(path, exist_ok=True)
    pd.DataFrame(rows, columns=["patient_id", "message_id", "timestamp", "HR", "Temp"]).to_parquet(
        os.path.join(path, f"part-{rows[0][1]}.parquet"), coerce_timestamps="us")


def test_stream_window_state_survives_restart(spark):
    base = tempfile.mkdtemp(prefix="wl-stream-")
    src, out, ckpt = os.path.join(base, "src"), os.path.join(base, "out"), os.path.join(base, "ckpt")
    t0 = pd.Timestamp("2024-01-01")
    rows = [("p1", i, t0 + pd.Timedelta(hours=i), 101.0 if i == 0 else None, None) for i in range(10)]
    _write_events(src, rows[:5])
    schema = "patient_id string, message_id long, timestamp timestamp_ntz, HR double, Temp double"

    def run():
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src) \
            .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        w = state.stream_windows(s, ["HR", "Temp"], {"HR": 83.0, "Temp": 37.0}, {"HR": 84.0, "Temp": 37.0}, {"HR": 17.0, "Temp": 1.0}, 8)
        jobs.run_available(w, out, ckpt)
        return spark.read.parquet(out)

    assert run().count() == 0  # fewer than 8 readings: no window yet, no padding
    _write_events(src, rows[5:])
    got = run().orderBy("message_id").collect()
    assert [r.message_id for r in got] == [7, 8, 9]  # state carried across the restart
    first = got[0].X
    assert len(first) == 16 and abs(first[0] - 1.0) < 1e-6 and abs(first[-2] - 1.0) < 1e-6  # (101-84)/17, carried forward
    assert abs(first[1] - 0.0) < 1e-6  # never seen → median 37 → (37-37)/1
    assert [r.reading for r in got] == [[None, None]] * 3  # the readings' own values


def test_ingest_lands_accepted_rejected_and_provisions_once(spark):
    from wardline.sources import files
    base = tempfile.mkdtemp(prefix="wl-ingest-")
    src = os.path.join(base, "src")
    os.makedirs(src)
    good = lambda pid, ts: json.dumps({"patient_id": pid, "timestamp": ts, "source": "iot_sensor", "channels": {"HR": 80}})
    # the payload names the patient: the second batch's first message stands on another patient's topic
    batches = [[("icu/p1/vitals", good("p1", "2024-01-01T00:00:00Z")), ("icu/p1/vitals", "{bad"), ("icu/p2/status", good("p2", "x"))],
               [("icu/p9/vitals", good("p1", "2024-01-01T01:00:00Z")), ("icu/p3/vitals", good("p3", "2024-01-01T01:00:00Z"))]]
    for i, rows in enumerate(batches):
        with open(os.path.join(src, f"m{i}.json"), "w") as f:
            for j, (topic, value) in enumerate(rows):
                f.write(json.dumps({"message_id": i * 10 + j, "topic": topic, "value": value, "arrival_ts": f"2024-01-01T0{i}:00:00Z"}) + "\n")
    stream = spark.readStream.schema("message_id long, topic string, value string, arrival_ts timestamp") \
        .option("maxFilesPerTrigger", 1).json(src).filter(F.col("topic").rlike(vocab.VITALS_TOPIC_FILTER_REGEX))
    paths = jobs.ingest(spark, stream, base=os.path.join(base, "out"))
    assert spark.read.parquet(paths["accepted"]).count() == 3
    rej = spark.read.parquet(paths["rejected"]).collect()
    assert [r.reason for r in rej] == [vocab.REJECT_NOT_JSON]
    pats = sorted(r.patient_id for r in spark.read.parquet(paths["patients"]).collect())
    assert pats == ["p1", "p3"]  # p1 provisioned once, p2 never subscribed
    assert {r.patient_id for r in spark.read.parquet(paths["accepted"]).collect()} == {"p1", "p3"}
    from wardline.streaming.jobs import rejected_sink
    # replaying batch 1 reproduces its own output instead of dropping it
    replay = messages.validate_messages(spark.read.schema("message_id long, topic string, value string, arrival_ts timestamp")
                                        .json(os.path.join(src, "m1.json")), "value", "topic") \
        .withColumn("patient_id", messages.payload_patient(F.col("value")))
    rejected_sink(paths["rejected"], paths["patients"])(replay, 1)
    assert sorted(r.patient_id for r in spark.read.parquet(paths["patients"]).collect()) == ["p1", "p3"]


def test_parts_of_several_files_are_landed_one_after_the_other(spark):
    base = tempfile.mkdtemp(prefix="wl-parts-")
    src, schema = os.path.join(base, "src"), "message_id long, topic string, value string, arrival_ts timestamp"
    os.makedirs(src)
    value = json.dumps({"patient_id": "p1", "timestamp": "2024-01-01T00:00:00Z", "source": "iot_sensor", "channels": {"HR": 80}})
    for part in range(2):
        for j in range(2):
            with open(os.path.join(src, f"m{part}{j}.json"), "w") as f:
                f.write(json.dumps({"message_id": part * 10 + j, "topic": "icu/p1/vitals", "value": value, "arrival_ts": f"2024-01-01T0{part}:00:00Z"}))
        jobs.land_validated(spark.readStream.schema(schema).json(src), os.path.join(base, "out"))
    assert len([f for f in os.listdir(os.path.join(base, "out", "checkpoint_validated", "commits")) if f.isdigit()]) == 2
    paths = jobs.ingest(spark, spark.readStream.schema(schema).json(src), base=os.path.join(base, "out"))
    assert sorted(r.message_id for r in spark.read.parquet(paths["accepted"]).collect()) == [0, 1, 10, 11]


def test_state_partitions_are_bounded_and_rows_ordered(spark):
    import numpy as np
    name, old = "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set(name, "1000")
    with state.typed_state(spark):
        assert int(spark.conf.get(name)) == state.STORES_PER_CORE * spark.sparkContext.defaultParallelism
    assert spark.conf.get(name) == "1000"
    spark.conf.set(name, old)
    rng = np.random.default_rng(4)
    for _ in range(30):
        n = int(rng.integers(1, 30))
        df = pd.DataFrame({"t": rng.choice([1.0, 2.0, np.nan], n), "id": rng.integers(0, 3, n), "x": np.where(rng.random(n) < 0.5, rng.random(n), np.nan)})
        got = state._rows(iter([df.iloc[:n // 2], df.iloc[n // 2:]]), ["t", "id"])
        assert got.equals(df.sort_values(["t", "id"], kind="stable"))
        values = np.vstack([[np.nan, 1.0], df[["x", "t"]].to_numpy()])
        assert np.array_equal(state._forward_filled(values), pd.DataFrame(values).ffill().to_numpy(), equal_nan=True)


def test_payload_encoding_nulls_and_hours(spark):
    df = spark.createDataFrame([("p1", 1, pd.Timestamp("2024-01-01 05:00").to_pydatetime(), 80.0, float("nan")), ("p1", 2, pd.Timestamp("2024-01-01 09:00").to_pydatetime(), None, 37.0)],
                               "patient_id string, ICULOS int, first_seen timestamp, HR double, Temp double")
    from wardline.operators.fill import nan_to_null
    df = df.withColumn("Temp", nan_to_null(F.col("Temp")))
    out = [json.loads(r.value) for r in messages.encode_payloads(df, ["HR", "Temp"], time_col="first_seen").orderBy("ICULOS").collect()]
    assert out[0]["channels"] == {"HR": 80.0, "Temp": None} and out[1]["channels"] == {"HR": None, "Temp": 37.0}
    assert out[0]["timestamp"].startswith("2024-01-01T05:00:00") and out[1]["timestamp"].startswith("2024-01-01T06:00:00")


def _state(spark, ckpt, name):
    return spark.read.format("statestore").option("stateVarName", name).load(ckpt)


def test_state_is_typed_and_idle_patients_leave(spark):
    base = tempfile.mkdtemp(prefix="wl-idle-")
    src, out, ckpt = (os.path.join(base, x) for x in ("src", "out", "ckpt"))
    t0 = pd.Timestamp("2024-01-01")

    def run(rows, idle_ms):
        _write_events(src, rows)
        s = spark.readStream.schema("patient_id string, message_id long, timestamp timestamp_ntz, HR double, Temp double").parquet(src) \
            .withColumn("timestamp", F.col("timestamp").cast("timestamp"))
        w = state.stream_windows(s, ["HR", "Temp"], {"HR": 83.0, "Temp": 37.0}, {"HR": 84.0, "Temp": 37.0}, {"HR": 17.0, "Temp": 1.0}, 4,
                                 idle_ms=idle_ms)
        jobs.run_available(w, out, ckpt)

    run([("p", 0, t0, 101.0, None), ("p", 1, t0 + pd.Timedelta(hours=1), None, 38.0), ("q", 2, t0, 90.0, None)], 1)
    with state.typed_state(spark):
        known = {r.key[0]: r.value[0] for r in _state(spark, ckpt, "last_known").collect()}
    assert known == {"p": [101.0, 38.0], "q": [90.0, None]}
    # both timers are over when the next micro-batch comes: q leaves, p starts anew
    run([("p", 3 + k, t0 + pd.Timedelta(hours=2 + k), 70.0, None) for k in range(3)], 3_600_000)
    run([("p", 6, t0 + pd.Timedelta(hours=6), None, None)], 3_600_000)
    with state.typed_state(spark):
        known = {r.key[0]: r.value[0] for r in _state(spark, ckpt, "last_known").collect()}
        held = _state(spark, ckpt, "recent").count()
    assert "q" not in known and held == 3
    assert [r.message_id for r in spark.read.parquet(out).collect()] != []


def test_cooldown_state_survives_restart_and_expires(spark):
    base = tempfile.mkdtemp(prefix="wl-cool-")
    src, schema = os.path.join(base, "src"), "patient_id string, id long, created_at timestamp_ntz, risk_level string, sepsis_probability double"
    os.makedirs(src)
    t0 = pd.Timestamp("2024-01-01")

    def run(name, rows, idle_ms=None):
        pd.DataFrame(rows, columns=["patient_id", "id", "created_at", "risk_level", "sepsis_probability"]).to_parquet(
            os.path.join(src, f"part-{rows[0][1]}.parquet"), coerce_timestamps="us")
        s = spark.readStream.schema(schema).parquet(src)
        out = os.path.join(base, name)
        jobs.run_available(state.stream_alerts(s, 30, idle_ms=idle_ms), out, os.path.join(base, f"ckpt-{name}"))
        return sorted(r.id for r in spark.read.parquet(out).collect())

    first = [("p", 1, t0, "High", 0.7), ("p", 2, t0 + pd.Timedelta(minutes=10), "High", 0.7), ("q", 3, t0, "Low", 0.1)]
    assert run("kept", first) == [1]
    later = [("p", 4, t0 + pd.Timedelta(minutes=20), "High", 0.7), ("p", 5, t0 + pd.Timedelta(minutes=21), "Critical", 0.9)]
    assert run("kept", later) == [1, 5]
    with state.typed_state(spark):
        assert {r.key[0]: r.value[1] for r in _state(spark, os.path.join(base, "ckpt-kept"), "last_alert").collect()} == {"p": 3}
    # the same with a state that lives for a millisecond: the cooldown is forgotten between two runs
    src = os.path.join(base, "src2")
    os.makedirs(src)
    assert run("brief", first, 1) == [1]
    assert run("brief", later[:1], 1) == [1, 4]
