"""DuckDB SQL for the stand-in views; composed into the oracle queries.

Every fragment is a list of CTEs ("name AS (...)"); ``with_(...)`` joins them.
Float outputs are rounded to 6 decimals on both sides.
"""

from __future__ import annotations

from wardline import vocab
from wardline.sources.standin import (CHANNELS, LABEL_THRESHOLD, PATIENT_CREATED_AT, PROB_SCALE,
                                      STATUS_BY_ORDER, STATUS_BY_SEGMENT, VITAL_STANDIN)

CH = CHANNELS
T = vocab.FALLBACK_THRESHOLD


def q(c: str) -> str:
    return f'"{c}"'


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def with_recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def r6(expr: str) -> str:
    return f"round(CAST({expr} AS DOUBLE), 6)"


RW = [
    "rw0 AS (SELECT user_id AS patient_id, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS hr, "
    + ", ".join(f"max(CASE WHEN event_type = '{c}' THEN value END) AS {q(c)}" for c in CH)
    + f", CAST(max(value) >= {LABEL_THRESHOLD} AS INTEGER) AS \"SepsisLabel\" FROM events GROUP BY 1, 2)",
    "rw AS (SELECT patient_id, hr, CAST(row_number() OVER (PARTITION BY patient_id ORDER BY hr) AS INTEGER) AS \"ICULOS\", "
    + ", ".join(q(c) for c in CH) + ", \"SepsisLabel\" FROM rw0)",
]


def _ffill(src: str, name: str) -> str:
    run = "OVER (PARTITION BY patient_id ORDER BY \"ICULOS\" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    whole = "OVER (PARTITION BY patient_id ORDER BY \"ICULOS\" ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    cols = ", ".join(f"coalesce(last_value({q(c)} IGNORE NULLS) {run}, first_value({q(c)} IGNORE NULLS) {whole}) AS {q(c)}"
                     for c in CH)
    return f"{name} AS (SELECT patient_id, hr, \"ICULOS\", {cols}, \"SepsisLabel\" FROM {src})"


FF = RW + [_ffill("rw", "ff")]

SPLIT = RW + [
    "pp AS (SELECT patient_id, CAST(max(\"SepsisLabel\") AS INTEGER) AS ever_positive FROM rw GROUP BY 1)",
    "cls AS (SELECT ever_positive, count(*) AS n FROM pp GROUP BY 1)",
    "pp2 AS (SELECT pp.*, CASE WHEN (SELECT min(n) FROM cls) >= 2 THEN ever_positive ELSE 0 END AS stratum FROM pp)",
    "rk AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5(CAST(patient_id AS VARCHAR) || ':42'), patient_id) AS k, "
    "count(*) OVER (PARTITION BY stratum) AS n FROM pp2)",
    "sp AS (SELECT patient_id, ever_positive, CASE WHEN k <= round(n * 0.15) THEN 'test' "
    "WHEN k <= round(n * 0.15) + round(n * 0.15) THEN 'val' ELSE 'train' END AS split FROM rk)",
]

FFS = SPLIT + [_ffill("rw", "ff"), "ffs AS (SELECT ff.*, sp.split FROM ff JOIN sp USING (patient_id))"]

MED = FFS + [
    "med AS (SELECT " + ", ".join(f"coalesce(CAST(median({q(c)}) AS DOUBLE), 0.0) AS {q(c)}" for c in CH)
    + " FROM ffs WHERE split = 'train')",
    "imp AS (SELECT ffs.patient_id, ffs.hr, ffs.\"ICULOS\", "
    + ", ".join(f"coalesce(ffs.{q(c)}, med.{q(c)}) AS {q(c)}" for c in CH)
    + ", ffs.\"SepsisLabel\", ffs.split FROM ffs, med)",
]

SCALER = MED + [
    "sc0 AS (SELECT " + ", ".join(f"avg({q(c)}) AS {q(c + '__m')}, stddev_samp({q(c)}) AS {q(c + '__s')}" for c in CH)
    + " FROM imp WHERE split = 'train')",
    "sc AS (SELECT " + ", ".join(
        f"{q(c + '__m')}, CASE WHEN {q(c + '__s')} IS NULL OR isnan({q(c + '__s')}) OR {q(c + '__s')} = 0 "
        f"THEN 1.0 ELSE {q(c + '__s')} END AS {q(c + '__s')}" for c in CH) + " FROM sc0)",
    "z AS (SELECT imp.patient_id, imp.hr, imp.\"ICULOS\", "
    + ", ".join(f"(imp.{q(c)} - sc.{q(c + '__m')}) / sc.{q(c + '__s')} AS {q(c)}" for c in CH)
    + ", imp.\"SepsisLabel\", imp.split FROM imp, sc)",
]


def windows_sql(src: str, w: int, stride: int, extra_select: str = "") -> list[str]:
    return [
        f"wz AS (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY \"ICULOS\") AS rn, "
        f"count(*) OVER (PARTITION BY patient_id) AS n FROM {src})",
        f"ends AS (SELECT patient_id, rn AS rn_e, n, \"ICULOS\" AS window_end_time, \"SepsisLabel\" AS y, split FROM wz "
        f"WHERE (rn >= {w} AND (rn - {w}) % {stride} = 0) OR (n < {w} AND rn = n))",
        f"steps AS (SELECT e.*, s.step FROM ends e CROSS JOIN range({w}) s(step))",
        f"wx AS (SELECT e.patient_id, e.split, CAST(e.rn_e - 1 + greatest({w} - e.n, 0) AS BIGINT) AS window_end_idx, "
        f"e.window_end_time, CAST(e.y AS BIGINT) AS y, CAST(e.step AS INTEGER) AS step, "
        + ", ".join(f"CAST(CAST(z.{q(c)} AS FLOAT) AS DOUBLE) AS {q(c)}" for c in CH)
        + f" FROM steps e JOIN wz z ON z.patient_id = e.patient_id AND z.rn = greatest(1, e.rn_e - {w - 1} + e.step))",
    ]


# predictions: one per event
PRED = [
    f"pred AS (SELECT event_id AS id, user_id AS patient_id, ts AS created_at, least(value / {PROB_SCALE}, 1.0) AS p FROM events)",
    "preds AS (SELECT id, patient_id, created_at, p AS sepsis_probability, "
    f"CAST(p >= {T!r} AS INTEGER) AS predicted_label, "
    f"CASE WHEN p >= {vocab.CRITICAL_PROBABILITY} THEN 'Critical' WHEN p >= {T!r} THEN 'High' "
    f"WHEN p >= {vocab.MEDIUM_PROBABILITY} THEN 'Medium' ELSE 'Low' END AS risk_level FROM pred)",
]

RANK_SQL = "CASE risk_level WHEN 'Low' THEN 0 WHEN 'Medium' THEN 1 WHEN 'High' THEN 2 WHEN 'Critical' THEN 3 ELSE 0 END"

STATUS_SQL = "CASE c_mktsegment " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_BY_SEGMENT.items()) + " END"
ORDER_STATUS_SQL = "CASE o_orderstatus " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in STATUS_BY_ORDER.items()) + " END"

PATIENTS = [
    "pat AS (SELECT c_custkey AS patient_id, 'live' AS source_dataset, c_acctbal AS age, c_mktsegment AS sex, "
    f"{STATUS_SQL} AS current_status, 'owner_' || CAST(c_nationkey AS VARCHAR) AS created_by, "
    f"TIMESTAMP '{PATIENT_CREATED_AT}' AS created_at FROM customer)"
]

VITALS = RW + [
    "vit AS (SELECT patient_id * 1000000 + \"ICULOS\" AS id, patient_id, hr AS ts, "
    + ", ".join(f"{q(src)} AS {q(name)}" for name, src in VITAL_STANDIN.items())
    + " FROM rw)"
]


def whole_text(x: str) -> str:
    """Python '{x:.0f}' in DuckDB: round half to even, print without decimals."""
    return f"CAST(CAST(round_even(CAST({x} AS DOUBLE), 0) AS BIGINT) AS VARCHAR)"


def reason_sql(prefix: str = "") -> str:
    parts = []
    for name, low, high, unit, label in vocab.VITAL_RANGES:
        if name not in VITAL_STANDIN:
            continue
        v = f"{prefix}{q(name)}"
        txt = lambda kind: f"'{kind} {label} (' || {whole_text(v)} || '{unit})'"
        branches = []
        if low is not None:
            branches.append(f"WHEN {v} < {low} THEN {txt('Low')}")
        if high is not None:
            branches.append(f"WHEN {v} > {high} THEN {txt('Elevated')}")
        parts.append("CASE " + " ".join(branches) + " END")
    arr = "list_filter([" + ", ".join(parts) + "], lambda x: x IS NOT NULL)"
    return f"array_to_string({arr}[1:{vocab.MAX_FINDINGS}], ', ')"


def message_sql(level: str, pid: str, p: str, reason: str) -> str:
    why = f"CASE WHEN coalesce({reason}, '') = '' THEN ' -- {vocab.FALLBACK_REASON}' ELSE ' -- ' || {reason} END"
    return (f"'[' || {level} || '] Sepsis risk for patient ' || CAST({pid} AS VARCHAR) || ': ' || "
            f"{whole_text(f'{p} * 100')} || '% probability' || {why}")
