"""Exact alert cooldown (J8) without holding an entity in one task.

Rule, per entity, rows in (time, id) order: a triggered row is raised when
there is no earlier alert, when its rank is above the last alert's rank, or
when the last alert is at least ``cooldown`` old; suppressed rows do not
change the state; existing (manual) alerts always update the state and come
first at equal times (an unknown level ranks lowest, a null time is the epoch).

The state before a row depends on which rows before it were raised, so no window
function gives it. It is a parallel prefix over transfer functions instead, one
plan for any size:

1. Rows are dealt to segments of ``SEGMENT`` cooldowns of an entity. What a
   segment does to the last alert before it is a function of that alert's (time, rank):
   a step function of the end of its cooldown for each rank, as all that matters is the first row of
   the segment past that end, above that rank, or existing. Steps with one result are merged, so
   the function is a few rows. An alert that leaves a segment untouched is over a cooldown old when
   the next one starts, and counts as none from there on.
2. Functions of up to ``FAN`` neighbouring segments are composed into one, again and again until no
   entity has more than ``FAN`` left: log rounds.
3. From the top down each segment gets the last alert before it, and at the bottom each segment's
   rows are followed from there.

A task holds one Arrow batch of segments; a segment holds at most ``SEGMENT`` cooldowns of one entity's rows.
Within a batch all segments are worked on together in numpy: from each row the next
raise is the least of three searches, and the rows that are raised are followed
from all segments' first rows at once.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline import vocab
from wardline.functions import clinical
from wardline.session import reliable_checkpoint

SEGMENT = 1024  # cooldowns of a segment
FAN = 256  # functions composed at once
MOST_US = 1 << 47  # of a segment, so that a batch of them has room in 64 bits

RANKS = np.unique([0, *vocab.RISK_RANK.values()])
END = np.iinfo(np.int64).max


def prepare_rows(preds: DataFrame, cd_us: int, segment: int, levels: Sequence[str], key: str, ts: str, id_col: str, risk: str,
                 carry: Sequence[str], existing: DataFrame | None) -> DataFrame:
    """Triggered rows and existing alerts (_m = 1) with the time in microseconds, the rank and the segment."""
    rows = preds.filter(F.col(risk).isin(list(levels))).select(
        F.col(key).alias("_k"), F.col(ts).alias("_ts"), F.col(id_col).alias("_id"), F.col(risk).alias("_risk"),
        *[F.col(c).alias(f"_c_{c}") for c in carry], F.lit(0).alias("_m"))
    if existing is not None:
        none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema}
        rows = rows.unionByName(existing.select(
            F.col(key).alias("_k"), F.col(ts).alias("_ts"), none["_id"], F.col(risk).alias("_risk"),
            *[none[f"_c_{c}"] for c in carry], F.lit(1).alias("_m")))
    us = F.coalesce(F.unix_micros(F.col("_ts").cast("timestamp")), F.lit(0))
    return rows.withColumns({"_us": us, "_rank": F.coalesce(clinical.risk_rank(F.col("_risk")), F.lit(0)).cast("int"),
                             "_s": F.floor(us / F.lit(cd_us * segment)).cast("long")})


def _groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Whole groups of equal ``keys`` of batches sorted by them: (rows, starts of groups closed by their number)."""
    held: list[pa.RecordBatch] = []

    def borders(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            codes = batch.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        both = pa.concat_batches([held[-2].slice(held[-2].num_rows - 1), batch.slice(0, 1)]) if len(held) > 1 else None
        if both is not None and len(borders(both)) == 1 and len(borders(batch)) == 1:
            continue  # all of it belongs to the group before
        rows = pa.concat_batches(held)
        starts = borders(rows)
        if len(starts) > 1:
            yield rows.slice(0, int(starts[-1])), starts
        held = [rows.slice(int(starts[-1]))]
    if held:
        rows = pa.concat_batches(held)
        yield rows, np.append(borders(rows), rows.num_rows)


class Segments:
    """Rows of whole segments, sorted by time within each, and the next raise after each row."""

    def __init__(self, rows: pa.RecordBatch, starts: np.ndarray, span: int, cd_us: int):
        us, self.rank = rows.column("_us").to_numpy(), rows.column("_rank").to_numpy()
        self.starts, self.ends = starts[:-1], starts[1:]
        n = len(us)
        self.group = np.repeat(np.arange(len(self.starts)), np.diff(starts))
        self.us, self.base = us, us[self.starts] // span * span
        # times since the segment's begin, segments so far apart that none sees the next
        at = us - self.base[self.group]
        self.gap = int(at.max()) + cd_us + 1
        self.at = at + self.group * self.gap
        end_of = self.ends[self.group]
        self.above = {r: np.append(np.flatnonzero(self.rank > r), n) for r in RANKS.tolist()}
        self.manual = np.append(np.flatnonzero(rows.column("_m").to_numpy() == 1), n)
        here, higher = np.arange(n), np.full(n, n)
        for r, found in self.above.items():
            own = self.rank == r
            higher[own] = found[np.searchsorted(found, here[own] + 1)]
        late = np.searchsorted(self.at, self.at + cd_us)
        nxt = np.minimum(np.minimum(late, higher), self.manual[np.searchsorted(self.manual, here + 1)])
        self.next = np.where(nxt < end_of, nxt, -1)

    def last(self) -> np.ndarray:
        """For each row, raised, the last alert of its segment."""
        to = np.where(self.next < 0, np.arange(len(self.next)), self.next)
        while not np.array_equal(further := to[to], to):
            to = further
        return to

    def entry(self, rank: np.ndarray, past: np.ndarray, group: np.ndarray) -> np.ndarray:
        """First alert of segments given the last alert's rank and the first row past its cooldown (-1: none)."""
        first = np.where(past < 0, len(self.us), past)
        start = self.starts[group]
        for r, found in self.above.items():
            own = rank == r
            first[own] = np.minimum(first[own], found[np.searchsorted(found, start[own])])
        first = np.minimum(first, self.manual[np.searchsorted(self.manual, start)])
        return np.where(first < self.ends[group], first, -1)


FUNCTION = "rank int, upto long, us long, to_rank int"


def _functions(batches: Iterator[pa.RecordBatch], cd_us: int, span: int) -> Iterator[pa.RecordBatch]:
    """Each segment's transfer function: for a last alert of ``rank`` whose cooldown ends by ``upto`` (the least such
    row counts) the last alert after the segment, null where no row is raised."""
    for rows, starts in _groups(batches, ("_k", "_s")):
        s = Segments(rows, starts, span, cd_us)
        last = s.last()
        # steps end at the rows of the segment's first cooldown; beyond, the first row after it is past any end
        early = np.flatnonzero(s.us < (s.base + cd_us)[s.group])
        groups = np.arange(len(s.starts))
        n_early = np.bincount(s.group[early], minlength=len(groups))
        after = np.where(s.starts + n_early < s.ends, s.starts + n_early, -1)
        group = np.concatenate([s.group[early], groups])
        past, upto = np.concatenate([early, after]), np.concatenate([s.us[early], np.full(len(groups), END)])
        order = np.lexsort((upto, group))
        group, past, upto = group[order], past[order], upto[order]
        parts = []
        for r in RANKS:
            to = s.entry(np.full(len(group), r), past, group)
            to = np.where(to < 0, -1, last[to])
            keep = np.ones(len(group), bool)  # of equal neighbours the last step stays
            keep[:-1] = (group[1:] != group[:-1]) | (to[1:] != to[:-1])
            parts.append((group[keep], np.full(keep.sum(), r), upto[keep], to[keep]))
        group, rank, upto, to = (np.concatenate(x) for x in zip(*parts, strict=True))
        at, none = s.starts[group], to < 0
        yield pa.RecordBatch.from_arrays(
            [rows.column("_k").take(pa.array(at)), rows.column("_s").take(pa.array(at)), pa.array(rank, pa.int32()), pa.array(upto),
             pa.array(s.us[to], mask=none), pa.array(s.rank[to].astype(np.int32), mask=none)],
            ["_k", "_s", "rank", "upto", "us", "to_rank"])


def _raised(batches: Iterator[pa.RecordBatch], cd_us: int, span: int, names: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """Triggered rows that are raised, each segment followed from the last alert before it (_in_us, _in_rank)."""
    for rows, starts in _groups(batches, ("_k", "_s")):
        s = Segments(rows, starts, span, cd_us)
        before = rows.column("_in_us").fill_null(-(1 << 62)).to_numpy()[s.starts]
        rank = rows.column("_in_rank").fill_null(0).to_numpy()[s.starts]
        groups = np.arange(len(s.starts))
        past = np.searchsorted(s.at, np.clip(before + cd_us - s.base, 0, s.gap - 1) + groups * s.gap)
        at = s.entry(rank, np.where(past < s.ends, past, -1), groups)
        mark = np.zeros(rows.num_rows, bool)
        at = at[at >= 0]
        while len(at):
            mark[at] = True
            at = s.next[at]
            at = at[at >= 0]
        mark &= rows.column("_m").to_numpy() == 0
        yield rows.filter(pa.array(mark)).select(names)


State = tuple[int, int] | None


class Function:
    """A transfer function read from its rows: last alert before to last alert after."""

    def __init__(self):
        self.upto, self.to = defaultdict(list), defaultdict(list)

    def add(self, rank: int, upto: int, to: State) -> None:
        self.upto[rank].append(upto)
        self.to[rank].append(to)

    def __call__(self, state: State, cd_us: int) -> State:
        if state is None:
            return self.to[0][0]  # any row is past the end of no cooldown
        return self.to[state[1]][bisect_left(self.upto[state[1]], state[0] + cd_us)]


def _by_parent(batches: Iterator[pa.RecordBatch], parent: str) -> Iterator[tuple[pa.Scalar, int, list[tuple[int, Function]], int | None, int | None]]:
    """(entity, parent, functions of its segments in order, last alert before the parent) of rows sorted so."""
    for rows, starts in _groups(batches, ("_k", parent)):
        number, parents = rows.column("_s").to_pylist(), rows.column(parent).to_pylist()
        columns = [rows.column(c).to_pylist() for c in ("rank", "upto", "us", "to_rank")]
        into = [rows.column(c).to_pylist() if c in rows.schema.names else None for c in ("_in_us", "_in_rank")]
        for lo, hi in zip(starts[:-1], starts[1:], strict=True):
            functions: list[tuple[int, Function]] = []
            for i in range(lo, hi):
                if not functions or functions[-1][0] != number[i]:
                    functions.append((number[i], Function()))
                rank, upto, us, to_rank = (c[i] for c in columns)
                functions[-1][1].add(rank, upto, None if us is None else (us, to_rank))
            state = (into[0][lo], into[1][lo]) if into[0] and into[0][lo] is not None else None
            yield rows.column("_k")[int(lo)], parents[lo], functions, state


def _compose(batches: Iterator[pa.RecordBatch], cd_us: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One function for each parent: the steps of its first segment, their results taken through the others."""
    for key, parent, functions, _ in _by_parent(batches, "_p"):
        out, first = [], functions[0][1]
        for rank in sorted(first.upto):
            steps = []
            for upto, state in zip(first.upto[rank], first.to[rank], strict=True):
                for _, f in functions[1:]:
                    state = f(state, cd_us)
                if steps and steps[-1][1] == state:
                    steps[-1] = (upto, state)
                else:
                    steps.append((upto, state))
            out += [(key.as_py(), parent, rank, upto, *(state or (None, None))) for upto, state in steps]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def _hand_down(batches: Iterator[pa.RecordBatch], cd_us: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The last alert before each segment, from that before its parent."""
    out = []
    for key, _, functions, state in _by_parent(batches, "_p"):
        for number, f in functions:
            out.append((key.as_py(), number, *(state or (None, None))))
            state = f(state, cd_us)
        if len(out) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def cooldown_alerts(preds: DataFrame, cooldown_minutes: float = vocab.ALERT_COOLDOWN_MINUTES,
                    levels: Sequence[str] = vocab.ALERT_TRIGGER_LEVELS, key: str = "patient_id",
                    ts: str = "created_at", id_col: str = "id", risk: str = "risk_level",
                    existing: DataFrame | None = None, carry: Sequence[str] = (), segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """Raised rows of ``preds`` (key, id, time, level and the columns in ``carry``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    cd_us = int(round(cooldown_minutes * 60 * 1_000_000))
    segment = max(1, min(segment, MOST_US // cd_us))
    span = cd_us * segment
    rows = reliable_checkpoint(prepare_rows(preds, cd_us, segment, levels, key, ts, id_col, risk, carry, existing))
    kind = rows.schema["_k"].dataType.simpleString()

    def sorted_by(df: DataFrame, *names: str, within: Sequence[str]) -> DataFrame:
        return df.repartition(*names).sortWithinPartitions(*names, *within)

    # at equal times existing alerts come first
    in_order = ["_us", F.desc("_m"), "_id"]
    light = rows.select("_k", "_s", "_us", "_m", "_id", "_rank")
    level = reliable_checkpoint(sorted_by(light, "_k", "_s", within=in_order).mapInArrow(
        lambda b: _functions(b, cd_us, span), f"_k {kind}, _s long, {FUNCTION}"))
    schema = to_arrow_schema(level.schema)
    handed = to_arrow_schema(level.select("_k", "_s", F.col("us").alias("_in_us"), F.col("to_rank").alias("_in_rank")).schema)
    levels_up = [level]
    while (levels_up[-1].groupBy("_k").agg(F.countDistinct("_s").alias("n")).agg(F.max("n")).first()[0] or 0) > fan:
        parents = levels_up[-1].withColumn("_p", F.floor(F.col("_s") / fan).cast("long"))
        up = sorted_by(parents, "_k", "_p", within=["_s", "rank", "upto"]).mapInArrow(
            lambda b: _compose(b, cd_us, schema), level.schema)
        levels_up.append(reliable_checkpoint(up))
    # the top's parent is the whole entity, before which there is no alert
    before = None
    for k in range(len(levels_up) - 1, -1, -1):
        here = levels_up[k]
        if before is None:
            here = here.withColumn("_p", F.lit(0).cast("long"))
        else:
            here = here.withColumn("_p", F.floor(F.col("_s") / fan).cast("long"))
            known = before.select(F.col("_k").alias("_bk"), F.col("_s").alias("_bp"), "_in_us", "_in_rank")
            here = here.join(known, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_p") == F.col("_bp")), "left").drop("_bk", "_bp")
        before = reliable_checkpoint(sorted_by(here, "_k", "_p", within=["_s", "rank", "upto"]).mapInArrow(
            lambda b: _hand_down(b, cd_us, handed), f"_k {kind}, _s long, _in_us long, _in_rank int"))
    known = before.select(F.col("_k").alias("_bk"), F.col("_s").alias("_bs"), "_in_us", "_in_rank")
    rows = rows.join(known, F.col("_k").eqNullSafe(F.col("_bk")) & (F.col("_s") == F.col("_bs")), "left").drop("_bk", "_bs")
    names = ["_k", "_id", "_ts", "_risk", *[f"_c_{c}" for c in carry]]
    out = sorted_by(rows, "_k", "_s", within=in_order).mapInArrow(
        lambda b: _raised(b, cd_us, span, names), rows.select(*names).schema)
    return out.select(F.col("_k").alias(key), F.col("_id").alias(id_col), F.col("_ts").alias(ts), F.col("_risk").alias(risk),
                      *[F.col(f"_c_{c}").alias(c) for c in carry])
