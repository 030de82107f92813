"""Registered queries of whole plans and file sources: written as the plan writes, then read back."""

from __future__ import annotations

import os

import numpy as np
from pyspark.sql import functions as F

from wardline import vocab
from wardline.catalog import conform as C
from wardline.catalog import eda as E
from wardline.catalog import metrics as M
from wardline.catalog import more
from wardline.catalog import sql as S
from wardline.catalog.registry import r6, register, round_doubles
from wardline.operators import focal, ml, moments, ranking
from wardline.operators import windows as win
from wardline.plans import conform as conform_plan
from wardline.plans import eda_report, explain
from wardline.session import scratch_path, write_scratch
from wardline.sources import files, standin
from wardline.sources.standin import CHANNELS as CH

KEY = "patient_id"
CHQ = ", ".join(S.q(c) for c in CH)

# --- patient files ---------------------------------------------------------------------------

SETS = ("A", "B")
_SET = ("ps AS (SELECT patient_id, CASE WHEN max(\"SepsisLabel\") = 1 THEN 'A' ELSE 'B' END AS part FROM rw GROUP BY 1)")
_FILE_ROWS = f"SELECT CAST(patient_id AS VARCHAR) AS patient_id, {CHQ}, \"ICULOS\", \"SepsisLabel\" FROM rw"


def _patient_files(spark, d, limit=None):
    """Readings written as one file a patient in two sets (ever positive or not), read through the file source."""
    root = scratch_path(spark, "patient-files")
    rw = standin.readings_wide(spark, d)
    part = rw.groupBy(KEY).agg(F.when(F.max("SepsisLabel") == 1, "A").otherwise("B").alias("set"))
    files.write_patient_files(rw.join(part, KEY), root, [*CH, "ICULOS", "SepsisLabel"])
    return files.read_patient_files(spark, root, [f"set={s}" for s in SETS], limit, [KEY, *CH, "ICULOS", "SepsisLabel"],
                                    suffix=".txt", key_pattern=f"{KEY}=([^/]+)/")


@register("patient_files", S.with_(*S.RW) + _FILE_ROWS)
def patient_files(spark, d):
    """A1 + A3 + I1: all patient files of both sets."""
    return _patient_files(spark, d)


@register("patient_files_first", S.with_(*S.RW, _SET) + _FILE_ROWS + " WHERE patient_id IN (SELECT patient_id FROM ps "
          "ORDER BY part, CAST(patient_id AS VARCHAR) LIMIT 25)")
def patient_files_first(spark, d):
    """A2: the first 25 files in the order of their full paths (the limit is the feature)."""
    return _patient_files(spark, d, 25)


# --- M2 with two sources -----------------------------------------------------------------------

_VALUES = C._values(standin.CHART_CANDIDATES, "chart") + ", " + C._values(standin.LAB_CANDIDATES, "lab")
_TWO = [
    f"cand AS (SELECT * FROM (VALUES {_VALUES}) t(channel, source, cand))",
    "dict AS (SELECT p_partkey AS itemid, p_type AS label, 'chart' AS kind FROM part WHERE p_size < 40 "
    "UNION ALL SELECT p_partkey, p_type, 'lab' FROM part WHERE p_size >= 15)",
    "ev AS (SELECT o_custkey AS subject_id, l_shipdate AS charttime, l_partkey AS itemid, l_quantity AS valuenum, "
    "CASE WHEN l_linestatus = 'O' THEN 'chart' ELSE 'lab' END AS kind FROM lineitem JOIN orders ON l_orderkey = o_orderkey)",
    "cnt AS (SELECT kind, itemid, count(*) AS n FROM ev GROUP BY ALL)",
    "b2 AS (SELECT c.channel, c.source, d.itemid, d.label, n FROM cand c JOIN dict d ON d.kind = c.source AND lower(d.label) = c.cand "
    "JOIN cnt USING (itemid, kind) QUALIFY row_number() OVER (PARTITION BY source, channel ORDER BY n DESC, itemid ASC) = 1)",
    f"map AS (SELECT *, source = 'chart' AND label = '{standin.FAHRENHEIT_STANDIN}' AS is_fahrenheit FROM b2 WHERE source = 'chart' "
    "UNION ALL SELECT *, false FROM b2 WHERE source = 'lab' AND channel NOT IN (SELECT channel FROM b2 WHERE source = 'chart'))",
]


def _two_sources(spark, d):
    part = standin.table(spark, d, "part").select(F.col("p_partkey").alias("itemid"), F.col("p_type").alias("label"), "p_size")
    chart = part.select("itemid", "label", F.when(F.col("p_size") < 40, "chartevents").otherwise("datetimeevents").alias("linksto"))
    lab = part.select("itemid", "label", F.when(F.col("p_size") >= 15, "Blood").otherwise("Urine").alias("fluid"))
    li, o = standin.table(spark, d, "lineitem"), standin.table(spark, d, "orders")
    ev = li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("subject_id"), F.col("l_shipdate").alias("charttime"), F.col("l_partkey").alias("itemid"),
        F.col("l_quantity").alias("valuenum"), "l_linestatus")
    out = scratch_path(spark, "conformed")
    conform_plan.run_conform(spark, chart, lab, ev.filter("l_linestatus = 'O'"), ev.filter("l_linestatus <> 'O'"), None,
                             standin.CHART_CANDIDATES, standin.LAB_CANDIDATES, out, [standin.FAHRENHEIT_STANDIN])
    return out


@register("conform_plan", S.with_(*_TWO) + "SELECT CAST(subject_id AS VARCHAR) AS patient_id, charttime, channel, "
          "round(CASE WHEN is_fahrenheit THEN (valuenum - 32) * 5 / 9 ELSE valuenum END, 6) AS value, 'mimic_iv_demo' AS source "
          "FROM ev JOIN map ON map.itemid = ev.itemid AND map.source = ev.kind WHERE valuenum IS NOT NULL")
def conform_plan_readings(spark, d):
    """M2 + I2: the union of chart and laboratory readings as the plan writes it (chart before laboratory)."""
    return round_doubles(spark.read.parquet(os.path.join(_two_sources(spark, d), "vitals_long")))


@register("conform_plan_report", S.with_(*_TWO) + "SELECT 'n_patients' AS metric, count(DISTINCT subject_id) AS value FROM ev "
          "JOIN map ON map.itemid = ev.itemid AND map.source = ev.kind WHERE valuenum IS NOT NULL UNION ALL SELECT 'n_rows', count(*) FROM ev "
          "JOIN map ON map.itemid = ev.itemid AND map.source = ev.kind WHERE valuenum IS NOT NULL UNION ALL SELECT 'n_resolved', count(*) FROM map")
def conform_plan_report(spark, d):
    """M2 + F26: the plan's written mapping report."""
    report = spark.read.schema("metric string, value long").json(os.path.join(_two_sources(spark, d), "mapping_report"))
    return report.filter("metric <> 'n_unresolved'")


# --- M3, M5, D10, F16 ---------------------------------------------------------------------------

@register("eda_report", E.DESC_SQL)
def eda_report_written(spark, d):
    """M3 + B4: the report's table of descriptive statistics, read from its CSV."""
    out = scratch_path(spark, "eda-report")
    eda_report.run_eda(standin.readings_wide(spark, d), CH, out_dir=out)
    schema = "channel string, count long, mean double, std double, min double, p25 double, p50 double, p75 double, max double, pct_missing double"
    path = os.path.join(out, "stats", "descriptive_statistics")
    return round_doubles(files.read_csv_table(spark, path, schema))


@register("explain_plan", S.with_(*more._tall_sql()) + "SELECT patient_id, window_end_idx, round(max(base_value), 6) AS base_value, "
          "round(max(prediction), 6) AS prediction, 3 AS n_top, 'shap' AS method FROM con GROUP BY 1, 2")
def explain_plan(spark, d):
    """M5: the explanation records of the whole plan under the declared model."""
    res = explain.explain(more.declared, more._prepared(spark, d).windows, CH, top_n=3)
    return res["explanations"].select(KEY, "window_end_idx", r6("base_value").alias("base_value"), r6("prediction").alias("prediction"),
                                      F.size("top_contributing_features").alias("n_top"), F.col("explanation_method").alias("method"))


@register("imputation_guard", S.with_(*S.RW) + f"SELECT patient_id, \"ICULOS\", array_to_string(list_filter([{', '.join(f'CASE WHEN {S.q(c)} IS NULL THEN ' + repr(c) + ' END' for c in CH)}], "
          f"lambda c: c IS NOT NULL), ',') AS missing, '{win.MISSING_MSG}' AS error FROM rw WHERE " + " OR ".join(f"{S.q(c)} IS NULL" for c in CH))
def imputation_guard(spark, d):
    """The readings that window building refuses, and why."""
    return win.unimputed(standin.readings_wide(spark, d), CH).withColumn("missing", F.array_join("missing", ","))


# scores with many thresholds, so that points can be dropped
_FINE = M.SCORED.replace("CAST(l_discount AS DOUBLE) AS score", "round(l_extendedprice * l_discount, 0) AS score")


@register("roc_points_sparse", S.with_(_FINE, *M.HIST[1:], "nx AS (SELECT *, lead(pos) OVER w AS np, lead(neg) OVER w AS nn, row_number() OVER w AS k "
          "FROM cum WINDOW w AS (ORDER BY score DESC))") + "SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold UNION ALL "
          "SELECT round(cum_neg / N, 6), round(cum_pos / P, 6), round(score, 6) FROM nx WHERE k = 1 OR np IS NULL OR np <> pos OR nn <> neg")
def roc_points_sparse(spark, d):
    """F16 + Q11: the curve without points whose step equals the next one's."""
    li = standin.table(spark, d, "lineitem")
    scored = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), F.round(F.col("l_extendedprice") * F.col("l_discount"), 0).alias("score"))
    return round_doubles(ranking.sparse_roc_points(ranking.score_histogram(scored)))


# --- K3 with the focal loss -----------------------------------------------------------------------

def _slope_sql(y: int) -> str:
    """Derivative of the focal loss by the score at score 0 (probability one half)."""
    a, g = vocab.FOCAL_ALPHA, vocab.FOCAL_GAMMA
    right = f"({a if y else 1 - a!r} * pow(0.5, {g!r}) * ({g!r} * 0.5 * ln(0.5) - 0.5))"
    return right if y else f"(-{right})"


@register("focal_step", S.with_(*S.SCALER, *S.windows_sql("z", 8, 1), "tr AS (SELECT *, CASE WHEN y = 1 THEN " + _slope_sql(1) + " ELSE "
                                + _slope_sql(0) + " END AS slope FROM wx WHERE split = 'train')")
          + " UNION ALL ".join(f"SELECT CAST(step AS INTEGER) AS step, '{c}' AS channel, round(-avg(slope * {S.q(c)}), 5) AS weight FROM tr GROUP BY step" for c in CH))
def focal_step(spark, d):
    """K3 + C17: the weights after one gradient step of the focal loss from zero, rate 1, over all train windows."""
    train = more._prepared(spark, d).windows.filter("split = 'train'").select("X", "y")
    _, gradient = focal.loss_and_gradient(train, np.zeros(8 * len(CH) + 1))
    rows = [(i // len(CH), CH[i % len(CH)], float(-g)) for i, g in enumerate(gradient[:-1])]
    return spark.createDataFrame(rows, "step int, channel string, weight double").withColumn("weight", F.round("weight", 5))


@register("focal_classifier")
def focal_classifier(spark, d):
    """K3 + K4 with the focal loss: fitted on train, penalty by validation AUROC, scores of the test windows."""
    windows = write_scratch(more._prepared(spark, d).windows, "windows")
    model, _ = focal.train_focal_classifier(windows, max_iter=8)
    test = windows.filter("split = 'test'").select(KEY, "window_end_idx", "y", "X")
    return ml.score(test, model).select(KEY, "window_end_idx", "y", r6("probability").alias("probability"))


# --- statistics kept up to date ---------------------------------------------------------------------

def _daily(spark, d):
    """Moments by day in three additions, the last of which brings the second one's first day again."""
    rw = standin.readings_wide(spark, d).withColumn("day", F.to_date("hr"))
    rw = write_scratch(rw, "readings-by-day")
    days = [r[0] for r in rw.select("day").distinct().orderBy("day").collect()]
    path = scratch_path(spark, "moments")
    third = max(1, len(days) // 3)
    for lo, hi in ((0, third), (third, 2 * third), (third, third + 1), (2 * third, len(days))):
        if days[lo:hi]:
            moments.add_days(rw.filter(F.col("day").isin(days[lo:hi])), CH, "day", path)
    return spark.read.parquet(path)


@register("corr_by_day", E.ORACLE_CORR)
def corr_by_day(spark, d):
    """F6 from daily moments."""
    return round_doubles(moments.correlation(_daily(spark, d)))


@register("stats_by_day", f"SELECT channel, count, mean, std, pct_missing FROM ({E.DESC_SQL})")
def stats_by_day(spark, d):
    """F2 + F4 from daily moments."""
    return round_doubles(moments.channel_statistics(_daily(spark, d)))
