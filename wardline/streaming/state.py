"""Keyed streaming state (J4, J5, J8) with ``transformWithState``.

State lives in Spark's state store as typed variables and is checkpointed, so a
restarted query resumes where it stopped and the state reader
(``spark.read.format("statestore")``) shows each variable as a table. Rows of
one key inside one micro-batch are ordered by the job's clock before they are
applied (Q12); the micro-batch size is bounded by the source's
``maxFilesPerTrigger`` / ``maxOffsetsPerTrigger``.

With an idle time, a patient without rows for so long leaves: a processing-time
timer, moved on by every micro-batch that has rows of the patient, clears the
state; the cooldown's state expires by itself (time to live).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wardline import vocab

# transformWithState keeps its variables as column families of this store.
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# Each partition of a state store is opened, committed and uploaded in every micro-batch.
STORES_PER_CORE = 4


@contextmanager
def state_conf(spark: SparkSession, settings: Mapping[str, str] | None = None):
    """Queries started inside for the first time have no more state partitions than a few for each core."""
    shuffle = "spark.sql.shuffle.partitions"
    most = STORES_PER_CORE * spark.sparkContext.defaultParallelism
    new = {shuffle: str(min(int(spark.conf.get(shuffle)), most)), **(settings or {})}
    old = {k: spark.conf.get(k, None) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def typed_state(spark: SparkSession):
    """Queries started inside keep their state in the store that typed variables need."""
    # a query with timers would run micro-batches without data for ever, and never have done all that is available
    return state_conf(spark, {STORE: ROCKSDB, "spark.sql.streaming.noDataMicroBatches.enabled": "false"})


def _rows(pdfs: Iterator[pd.DataFrame], order: Sequence[str]) -> pd.DataFrame:
    """A key's rows of one micro-batch in the order of the job's clock."""
    parts = list(pdfs)
    rows = parts[0] if len(parts) == 1 else pd.concat(parts, ignore_index=True)
    keys = [rows[c].to_numpy() for c in reversed(order)]
    if any(k.dtype == object for k in keys):
        return rows.sort_values(list(order), kind="stable")
    at = np.lexsort(keys)  # nulls come last
    return rows if (at[1:] > at[:-1]).all() else rows.take(at)


def _micros(c: str):
    """A time as a number: pandas converts times one series at a time, which for a few rows costs more than the rows."""
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


def _forward_filled(values: np.ndarray) -> np.ndarray:
    """Each column's last value up to each row; NaN before the first."""
    at = np.where(np.isnan(values), 0, np.arange(len(values))[:, None])
    return values[np.maximum.accumulate(at, axis=0), np.arange(values.shape[1])]


def _or_none(values: np.ndarray) -> list:
    return np.where(np.isnan(values), None, values).tolist()


class WindowProcessor(StatefulProcessor):
    """J4 + J5: causal impute (last known value, else train median) + z-score;
    emits one full window per reading once ``window_size`` readings are held.
    No back-fill and no padding: the first ``window_size - 1`` readings give no window (Q13).
    With a window go the reading's own values, for the alert's reason (E10).

    State: ``last_known`` (a value), each channel's last value; ``recent`` (a list), the last
    ``window_size - 1`` standardised readings, oldest first.
    """

    def __init__(self, channels: Sequence[str], medians: Mapping[str, float], mean: Mapping[str, float], std: Mapping[str, float],
                 window_size: int = vocab.STREAM_WINDOW_SIZE, order: Sequence[str] = ("timestamp", "message_id"),
                 idle_ms: int | None = None, key: str = "patient_id"):
        self.channels, self.window_size, self.order, self.idle_ms, self.key = list(channels), window_size, list(order), idle_ms, key
        self.medians = np.array([float(medians.get(c, 0.0) or 0.0) for c in channels])
        self.mean = np.array([float(mean[c] or 0.0) for c in channels])
        self.std = np.array([float(std[c]) for c in channels])

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last_known = handle.getValueState("last_known", "values array<double>")
        self.recent = handle.getListState("recent", "z array<float>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, size = len(self.channels), self.window_size
        known = self.last_known.get()
        last = np.array([np.nan if v is None else v for v in known[0]], float) if known else np.full(n, np.nan)
        held = np.array([r[0] for r in self.recent.get()], np.float32).reshape(-1, n)
        batch = _rows(rows, self.order)
        values = batch[self.channels].to_numpy(dtype=float)
        # causal fill, vectorised: carried last-known values first, then forward fill, then medians
        filled = _forward_filled(np.vstack([last[None, :], values]))[1:]
        raw = np.where(np.isnan(filled), self.medians, filled)
        seq = np.vstack([held, ((raw - self.mean) / self.std).astype(np.float32)])
        self.last_known.update((_or_none(filled[-1]),))
        self._hold(seq, len(held))
        _restart_timer(self.handle, timerValues, self.idle_ms)
        if len(seq) < size:
            return
        windows = np.lib.stride_tricks.sliding_window_view(seq, (size, n))[:, 0]  # (len - size + 1, size, n)
        ends = np.arange(size - 1, len(seq)) - len(held)
        here = ends >= 0  # windows that end on a reading of this batch
        at = ends[here]
        yield pd.DataFrame({
            self.key: [key[0]] * len(at), "message_id": batch["message_id"].to_numpy()[at],
            "window_end": batch["timestamp"].to_numpy()[at], "created_at": batch[self.order[0]].to_numpy()[at],
            "X": list(windows[here].reshape(-1, size * n)),
            "reading": _or_none(values[at])})

    def _hold(self, seq: np.ndarray, held: int) -> None:
        """Append what is new while the list is not full, else put the newest readings in its place."""
        keep = self.window_size - 1
        if len(seq) <= keep:
            self.recent.appendList([(r.tolist(),) for r in seq[held:]])
        elif keep:
            self.recent.put([(r.tolist(),) for r in seq[-keep:]])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last_known.clear()
        self.recent.clear()
        return iter([])

    def close(self) -> None:
        pass


def _restart_timer(handle: StatefulProcessorHandle, timers, idle_ms: int | None) -> None:
    """The key's only timer ends ``idle_ms`` from now."""
    if idle_ms is None:
        return
    for old in list(handle.listTimers()):
        handle.deleteTimer(old)
    handle.registerTimer(timers.getCurrentProcessingTimeInMs() + idle_ms)


def _time_mode(idle_ms: int | None) -> str:
    return "None" if idle_ms is None else "ProcessingTime"


def stream_windows(readings: DataFrame, channels: Sequence[str], medians, mean, std,
                   window_size: int = vocab.STREAM_WINDOW_SIZE, key: str = "patient_id",
                   order: Sequence[str] = ("timestamp", "message_id"), idle_ms: int | None = None) -> DataFrame:
    """Readings (patient_id, message_id, timestamp, one column per channel) → full windows.

    ``X`` is the flat window (step by step), ``created_at`` the first column of
    ``order``, the job's clock. With ``idle_ms`` the state of a patient without
    readings for so long is dropped.
    """
    schema = (f"{key} {readings.schema[key].dataType.simpleString()}, message_id long, window_end long, "
              "created_at long, X array<float>, reading array<double>")
    processor = WindowProcessor(channels, medians, mean, std, window_size, order, idle_ms, key)
    times = dict.fromkeys(["timestamp", order[0]])
    numbered = readings.select(key, "message_id", *[_micros(c) for c in times], *channels)
    windows = numbered.groupBy(key).transformWithStateInPandas(processor, schema, "append", _time_mode(idle_ms))
    return windows.withColumns({c: F.timestamp_micros(c) for c in ("window_end", "created_at")})


def raised_positions(us: np.ndarray, rank: np.ndarray, cd_us: int, last_us: int | None, last_rank: int | None) -> list[int]:
    """Positions that raise an alert, for times in ascending order: from each alert the next is the first
    row of higher rank or the first one a cooldown later, both found by binary search."""
    higher = {r: np.flatnonzero(rank > r) for r in np.unique(rank).tolist()}
    if last_rank is not None:
        higher[last_rank] = np.flatnonzero(rank > last_rank)
    keep, i = [], 0
    while i < len(us):
        if last_us is not None:
            above = higher[last_rank]
            at = int(np.searchsorted(above, i))
            i = min(int(above[at]) if at < len(above) else len(us), max(i, int(np.searchsorted(us, last_us + cd_us))))
            if i >= len(us):
                break
        keep.append(i)
        last_us, last_rank = int(us[i]), int(rank[i])
        i += 1
    return keep


NO_TIME = np.iinfo(np.int64).min


class CooldownProcessor(StatefulProcessor):
    """J8 in streaming form: state = time and rank of the entity's last alert (``last_alert``, a value).

    The clock is ``created_at``, the time a prediction was made in microseconds, which only
    grows from one micro-batch to the next: how rows are dealt to micro-batches
    then does not matter. A row that is older than the last alert is inside its
    cooldown unless its rank is higher. With ``idle_ms`` the state expires so long after it was written.
    Every row comes out again with ``raised``.
    """

    def __init__(self, columns: Sequence[str], cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES,
                 levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, idle_ms: int | None = None):
        self.columns, self.levels, self.idle_ms = list(columns), set(levels), idle_ms
        self.cooldown_us = int(round(cooldown_minutes * 60 * 1_000_000))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last_alert = handle.getValueState("last_alert", "us long, rank int", self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _rows(rows, ["created_at", "id"])
        raised = np.zeros(len(batch), bool)
        levels = batch["risk_level"].tolist()
        triggered = np.array([i for i, level in enumerate(levels) if level in self.levels], dtype=int)
        if len(triggered):
            us = batch["created_at"].fillna(NO_TIME).to_numpy().astype("int64")[triggered]
            ranks = np.array([vocab.RISK_RANK.get(levels[i], 0) for i in triggered], dtype=int)
            keep = raised_positions(us, ranks, self.cooldown_us, *(self.last_alert.get() or (None, None)))
            if keep:
                self.last_alert.update((int(us[keep[-1]]), int(ranks[keep[-1]])))
                raised[triggered[keep]] = True
        batch = batch if list(batch.columns) == self.columns else batch[self.columns]
        yield batch.assign(raised=raised)

    def close(self) -> None:
        pass


def flag_alerts(preds: DataFrame, cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES,
                levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, carry: Sequence[str] = (), idle_ms: int | None = None) -> DataFrame:
    """Predictions stream with ``raised``: whether the prediction raises an alert (same rule as the batch form)."""
    p = preds.select("patient_id", "id", F.col("created_at").cast("timestamp").alias("created_at"), "risk_level",
                     "sepsis_probability", *carry)
    times = [f.name for f in p.schema.fields if f.dataType.typeName() == "timestamp"]
    numbered = p.withColumns({c: _micros(c) for c in times})
    processor = CooldownProcessor(numbered.columns, cooldown_minutes, levels, idle_ms)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in numbered.schema.fields)
    flagged = numbered.groupBy("patient_id").transformWithStateInPandas(processor, f"{schema}, raised boolean", "append", _time_mode(idle_ms))
    return flagged.withColumns({c: F.timestamp_micros(c) for c in times})


def stream_alerts(preds: DataFrame, cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES,
                  levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, carry: Sequence[str] = (),
                  idle_ms: int | None = None) -> DataFrame:
    """Predictions stream → raised alerts, with the columns in ``carry``."""
    return flag_alerts(preds, cooldown_minutes, levels, carry, idle_ms).filter("raised").drop("raised")
