"""End-to-end streaming latency: one reading file in → its stored prediction out.

A continuous query (processing-time trigger) runs validation, keyed window
state and Spark ML scoring into a parquet sink. Each measurement writes one
message file for a patient whose window is one reading short, then polls the
committed sink until that message's prediction is there.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.operators import messages
from wardline.streaming import state

SCHEMA = "message_id long, topic string, value string, arrival_ts timestamp"


def _write(path: str, rows: list[dict]) -> None:
    d, name = os.path.split(path)
    tmp = os.path.join(d, f".{name}.tmp")  # dot files are invisible to the file source
    with open(tmp, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
    os.replace(tmp, path)  # the file source only sees complete files


def measure(spark: SparkSession, base: str, channels, medians, mean, std, model, n: int = 5,
            window_size: int = vocab.STREAM_WINDOW_SIZE, timeout_s: float = 60.0) -> dict:
    src, out, ckpt = (os.path.join(base, x) for x in ("src", "out", "ckpt"))
    os.makedirs(src, exist_ok=True)

    def msg(mid, pid, hour):
        payload = {"patient_id": pid, "timestamp": f"2024-01-01T{hour:02d}:00:00Z", "source": "iot_sensor",
                   "channels": {c: float(mid % 7 + i) for i, c in enumerate(channels)}}
        return {"message_id": mid, "topic": f"icu/{pid}/vitals", "value": json.dumps(payload), "arrival_ts": "2024-01-01T00:00:00Z"}

    # warm-up: every test patient gets window_size - 1 readings (no window yet)
    _write(os.path.join(src, "warm.json"), [msg(p * 100 + h, f"lat{p}", h) for p in range(n) for h in range(window_size - 1)])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 10).json(src)
    v = messages.validate_messages(stream, "value", "topic")
    readings = messages.decode_accepted(v, channels).select(
        "patient_id", "message_id", F.col("timestamp").cast("timestamp").alias("timestamp"),
        *[F.col(f"channels.{c}").alias(c) for c in channels])
    windows = state.stream_windows(readings, channels, medians, mean, std, window_size)
    feats = windows.withColumn("features", array_to_vector(F.transform("X", lambda x: x.cast("double"))))
    p = vector_to_array(F.col("probability"))[1]
    scored = model.transform(feats).select("patient_id", "message_id", "window_end", p.alias("sepsis_probability"),
                                           clinical.risk_level(p).alias("risk_level"))
    # state partitions are fixed by the first run of a checkpoint; one per core keeps a
    # single-reading micro-batch small
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(spark.sparkContext.defaultParallelism))
    with state.typed_state(spark):
        q = (scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
             .trigger(processingTime="50 milliseconds").outputMode("append").start())
    spark.conf.set("spark.sql.shuffle.partitions", old)

    def last_batch() -> int:
        lp = q.lastProgress
        return lp["batchId"] if lp else -1

    def consumed_after(batch_id: int) -> bool:
        # a progress report is emitted once its batch has committed to the sink
        return any(pr["batchId"] > batch_id and pr.get("numInputRows", 0) > 0 for pr in q.recentProgress)

    lat = []
    try:
        deadline = time.time() + timeout_s
        while (q.lastProgress is None or q.lastProgress.get("numInputRows", 0) == 0) and time.time() < deadline:
            time.sleep(0.05)  # warm-up batch processed
        for i in range(n):
            mid = 10_000 + i
            before = last_batch()
            t0 = time.perf_counter()
            _write(os.path.join(src, f"m{i}.json"), [msg(mid, f"lat{i}", window_size - 1)])
            while not consumed_after(before) and time.time() < deadline:
                time.sleep(0.01)
            lat.append(time.perf_counter() - t0)
        stored = spark.read.parquet(out).filter(F.col("message_id") >= 10_000).count()
    finally:
        q.stop()
    return {"stream_latency_median_sec": round(statistics.median(lat), 3), "stream_latency_max_sec": round(max(lat), 3),
            "samples": len(lat), "stored_predictions": stored}
