"""Registered EDA queries (M3) on the raw stand-in readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.registry import r6, register, round_doubles
from wardline.operators import eda
from wardline.session import reliable_checkpoint
from wardline.sources import standin
from wardline.sources.standin import CHANNELS as CH

KEY, LABEL = "patient_id", "SepsisLabel"
q = S.q


def _rw(spark, d):
    return standin.readings_wide(spark, d)


def _union(parts):
    return " UNION ALL ".join(parts)


DESC_SQL = S.with_(*S.RW) + "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS channel, count({q(c)}) AS count, {S.r6(f'avg({q(c)})')} AS mean, {S.r6(f'stddev_samp({q(c)})')} AS std, "
    f"{S.r6(f'min({q(c)})')} AS min, {S.r6(f'quantile_cont({q(c)}, 0.25)')} AS p25, {S.r6(f'quantile_cont({q(c)}, 0.5)')} AS p50, "
    f"{S.r6(f'quantile_cont({q(c)}, 0.75)')} AS p75, {S.r6(f'max({q(c)})')} AS max, "
    f"{S.r6(f'100.0 * (1.0 - CAST(count({q(c)}) AS DOUBLE) / count(*))')} AS pct_missing FROM rw" for c in CH]) + ")"


@register("descriptive_stats", DESC_SQL)
def descriptive_stats(spark, d):
    return round_doubles(eda.descriptive_stats(_rw(spark, d), CH))


@register("label_stats", S.with_(*S.RW) + "SELECT \"SepsisLabel\", " + ", ".join(
    f"{S.r6(f'avg({q(c)})')} AS {q(c + '_mean')}, {S.r6(f'stddev_samp({q(c)})')} AS {q(c + '_std')}" for c in CH)
    + " FROM rw GROUP BY 1")
def label_stats(spark, d):
    return round_doubles(eda.label_group_stats(_rw(spark, d), CH, LABEL))


@register("missingness", S.with_(*S.RW) + "SELECT * FROM (" + _union([
    f"SELECT '{c}' AS channel, count(*) FILTER (WHERE {q(c)} IS NULL) AS n_missing, count(*) AS n_total, "
    f"{S.r6(f'100.0 * count(*) FILTER (WHERE {q(c)} IS NULL) / count(*)')} AS pct_missing FROM rw" for c in CH]) + ")")
def missingness(spark, d):
    return round_doubles(eda.missingness(_rw(spark, d), CH))


@register("missingness_by_patient", S.with_(*S.RW, "pm AS (SELECT patient_id, " + ", ".join(
    f"avg(CASE WHEN {q(c)} IS NULL THEN 1.0 ELSE 0.0 END) AS {q(c)}" for c in CH) + " FROM rw GROUP BY 1)")
    + "SELECT * FROM (" + _union([f"SELECT '{c}' AS channel, {S.r6(f'avg({q(c)})')} AS avg_per_patient_missing_rate FROM pm"
                                  for c in CH]) + ")")
def missingness_by_patient(spark, d):
    return round_doubles(eda.missingness_by_entity(_rw(spark, d), CH, KEY))


def _corr_cell(a, b):
    return (f"CASE WHEN count(*) FILTER (WHERE {q(a)} IS NOT NULL AND {q(b)} IS NOT NULL) >= 30 "
            f"THEN {S.r6(f'corr({q(a)}, {q(b)})')} END")


CORR_CTE = "cm AS (SELECT * FROM (" + _union([
    f"SELECT '{a}' AS channel_a, '{b}' AS channel_b, {_corr_cell(a, b)} AS corr FROM rw" for a in CH for b in CH]) + "))"


ORACLE_CORR = S.with_(*S.RW, CORR_CTE) + "SELECT channel_a, channel_b, CASE WHEN isnan(corr) THEN NULL ELSE corr END AS corr FROM cm"


@register("corr_matrix", ORACLE_CORR)
def corr_matrix(spark, d):
    return round_doubles(eda.correlation_matrix(_rw(spark, d), CH))


POS = "CASE {x} " + " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CH)) + " END"
TOP_CTE = ("tp AS (SELECT channel_a AS feature_a, channel_b AS feature_b, corr AS correlation FROM cm "
           f"WHERE {POS.format(x='channel_a')} < {POS.format(x='channel_b')} AND corr IS NOT NULL AND NOT isnan(corr) "
           f"ORDER BY abs(corr) DESC, {POS.format(x='channel_a')}, {POS.format(x='channel_b')} LIMIT 15)")


@register("top_pairs", S.with_(*S.RW, CORR_CTE, TOP_CTE) + "SELECT * FROM tp")
def top_pairs(spark, d):
    return round_doubles(eda.top_pairs(eda.correlation_matrix(_rw(spark, d), CH), CH, 15))


@register("channel_coverage", "SELECT event_type AS channel, count(value) AS n_readings, count(DISTINCT user_id) AS n_patients "
                              "FROM events WHERE value IS NOT NULL GROUP BY 1")
def channel_coverage(spark, d):
    return eda.channel_coverage(standin.readings_tall(spark, d))


STAYS_SQL = ("st AS (SELECT o_orderkey AS stay_id, o_custkey AS patient_id, o_orderpriority AS unit_admitted, "
             "c_acctbal AS age, c_mktsegment AS sex FROM orders LEFT JOIN customer ON o_custkey = c_custkey)")


@register("demographics", S.with_(STAYS_SQL) + (
    "SELECT 'n_patients' AS metric, CAST(NULL AS VARCHAR) AS category, CAST(count(DISTINCT patient_id) AS DOUBLE) AS value FROM st "
    "UNION ALL SELECT 'age_mean', NULL, round(avg(age), 6) FROM st "
    "UNION ALL SELECT 'age_std', NULL, round(stddev_samp(age), 6) FROM st "
    "UNION ALL SELECT 'sex_count', sex, CAST(count(*) AS DOUBLE) FROM (SELECT patient_id, arg_min(sex, stay_id) AS sex FROM st GROUP BY 1) GROUP BY 2 "
    "UNION ALL SELECT 'unit_count', unit_admitted, CAST(count(*) AS DOUBLE) FROM st GROUP BY 2"))
def demographics(spark, d):
    return round_doubles(eda.demographics(standin.stays(spark, d)))


def _tall_labeled(spark, d):
    rw = _rw(spark, d)
    # read twice (channel ranges, then bins): materialise the tall rows once
    return reliable_checkpoint(rw.unpivot([KEY, LABEL], list(CH), "channel", "value").filter(F.col("value").isNotNull()))


HIST_CTE = [
    "tl AS (SELECT patient_id, \"SepsisLabel\", channel, value FROM (UNPIVOT rw ON " + ", ".join(q(c) for c in CH)
    + " INTO NAME channel VALUE value) WHERE value IS NOT NULL)",
    "rg AS (SELECT channel, min(value) AS lo, max(value) AS hi FROM tl GROUP BY 1)",
    "hb AS (SELECT tl.channel, \"SepsisLabel\", CAST(CASE WHEN hi - lo = 0 THEN 0 ELSE least(floor((value - lo) / (hi - lo) * 20), 19) END AS INTEGER) AS bin, "
    "lo, hi FROM tl JOIN rg USING (channel))",
]


@register("label_histogram", S.with_(*S.RW, *HIST_CTE) + (
    "SELECT channel, \"SepsisLabel\", bin, round(lo + bin * (hi - lo) / 20, 6) AS bin_start, count(*) AS n "
    "FROM hb GROUP BY channel, \"SepsisLabel\", bin, lo, hi"))
def label_histogram(spark, d):
    return round_doubles(eda.label_histogram(_tall_labeled(spark, d), LABEL, 20))


PROFILE = "prof AS (SELECT patient_id, count(*) AS n_rows, CAST(max(\"SepsisLabel\") AS INTEGER) AS ever_positive FROM rw GROUP BY 1)"


@register("example_patients", S.with_(*S.RW, PROFILE) + (
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ever_positive ORDER BY patient_id) AS INTEGER) AS rank "
    "FROM prof WHERE n_rows >= 20) WHERE rank <= 2"))
def example_patients(spark, d):
    return eda.example_entities(_rw(spark, d), KEY, LABEL, 2, 20)


@register("cohort_pick", S.with_(*S.RW, PROFILE) + (
    "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY ever_positive ORDER BY patient_id) AS INTEGER) AS rank "
    "FROM (SELECT * FROM prof ORDER BY patient_id LIMIT 300)) "
    "WHERE (ever_positive = 1 AND rank <= 2) OR (ever_positive = 0 AND rank <= 3)"))
def cohort_pick(spark, d):
    return eda.cohort_pick(_rw(spark, d), KEY, LABEL, 2, 3, 300)


MISS_CTE = "mr AS (SELECT * FROM (" + _union([
    f"SELECT '{c}' AS channel, {i} AS pos, 100.0 * count(*) FILTER (WHERE {q(c)} IS NULL) / count(*) AS pct FROM rw"
    for i, c in enumerate(CH)]) + "))"


@register("eda_summary", S.with_(*S.RW, PROFILE, MISS_CTE, CORR_CTE, TOP_CTE) + (
    "SELECT 'n_rows' AS metric, CAST(sum(n_rows) AS DOUBLE) AS num, CAST(NULL AS VARCHAR) AS text FROM prof "
    "UNION ALL SELECT 'n_patients', CAST(count(*) AS DOUBLE), NULL FROM prof "
    "UNION ALL SELECT 'positive_rate', round(avg(ever_positive), 6), NULL FROM prof "
    "UNION ALL (SELECT 'top_missing_channel', round(pct, 6), channel FROM mr ORDER BY pct DESC, pos LIMIT 1) "
    "UNION ALL (SELECT 'top_correlated_pair', correlation, feature_a || ' / ' || feature_b FROM tp "
    "ORDER BY abs(correlation) DESC, " + POS.format(x='feature_a') + ", " + POS.format(x='feature_b') + " LIMIT 1) "
    "UNION ALL (SELECT 'top_important_channel', m, channel FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS channel, {i} AS pos, round(avg({S.q(c)}), 6) AS m FROM rw" for i, c in enumerate(CH))
    + ") ORDER BY m DESC, pos LIMIT 1)"))
def eda_summary(spark, d):
    """F25 as a tall table (metric, num, text); the importance row ranks channels by their mean reading."""
    rw = reliable_checkpoint(_rw(spark, d))  # four statistics read the same readings
    ranking = rw.select(F.inline(F.array(*[F.struct(F.lit(c).alias("channel"), F.col(c).alias("v")) for c in CH]))) \
        .groupBy("channel").agg(F.round(F.avg("v"), 6).alias("importance"))
    pairs = eda.top_pairs(eda.correlation_matrix(rw, CH), CH, 1)
    return round_doubles(eda.summary(rw, CH, KEY, LABEL, eda.missingness(rw, CH), pairs, ranking))
