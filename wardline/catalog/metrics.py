"""Registered evaluation queries (F13-F18, F22, F23) on the lineitem stand-in scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from wardline.catalog import sql as S
from wardline.catalog.registry import register, round_doubles
from wardline.operators import ranking
from wardline.sources import standin

THRESHOLD = 0.05

SCORED = "sc AS (SELECT CAST(l_returnflag = 'R' AS INTEGER) AS y, CAST(l_discount AS DOUBLE) AS score FROM lineitem)"
HIST = [SCORED,
        "hist AS (SELECT score, count(*) FILTER (WHERE y = 1) AS pos, count(*) FILTER (WHERE y <> 1) AS neg FROM sc GROUP BY 1)",
        "cum AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_pos, "
        "sum(neg) OVER (ORDER BY score DESC ROWS UNBOUNDED PRECEDING) AS cum_neg, "
        "CAST(sum(pos) OVER () AS DOUBLE) AS P, CAST(sum(neg) OVER () AS DOUBLE) AS N FROM hist)"]
PR = HIST + [
    "pr0 AS (SELECT score AS threshold, CASE WHEN cum_pos + cum_neg > 0 THEN cum_pos / (cum_pos + cum_neg) ELSE 0.0 END AS precision, "
    "CASE WHEN P > 0 THEN cum_pos / P ELSE 1.0 END AS recall FROM cum)",
    "pr AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM pr0)"]


def _scored(spark, d):
    return standin.scored_lineitem(spark, d)


def _cum(spark, d):
    return ranking.cumulative_desc(ranking.score_histogram(_scored(spark, d)))


@register("auroc", S.with_(*HIST) + "SELECT round(sum(neg * (cum_pos + cum_pos - pos) / 2.0) / (max(P) * max(N)), 6) AS auroc FROM cum")
def auroc(spark, d):
    return round_doubles(ranking.auroc_auprc(_cum(spark, d)).select("auroc"))


@register("auprc", S.with_(*HIST) + "SELECT round(sum(CASE WHEN pos > 0 THEN pos / P * (cum_pos / (cum_pos + cum_neg)) ELSE 0.0 END), 6) AS auprc FROM cum")
def auprc(spark, d):
    return round_doubles(ranking.auroc_auprc(_cum(spark, d)).select("auprc"))


@register("roc_points", S.with_(*HIST) + "SELECT 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr, 'inf'::DOUBLE AS threshold "
          "UNION ALL SELECT round(cum_neg / N, 6), round(cum_pos / P, 6), round(score, 6) FROM cum")
def roc_points(spark, d):
    return round_doubles(ranking.roc_points(_cum(spark, d)))


@register("best_f1", S.with_(*PR) + "SELECT round(threshold, 6) AS threshold, round(precision, 6) AS precision, "
          "round(recall, 6) AS recall, round(f1, 6) AS f1 FROM pr ORDER BY f1 DESC, threshold ASC LIMIT 1")
def best_f1(spark, d):
    return round_doubles(ranking.best_f1_threshold(_cum(spark, d)))


CONF = ("cm AS (SELECT count(*) FILTER (WHERE y <> 1 AND NOT score >= {t}) AS tn, count(*) FILTER (WHERE y <> 1 AND score >= {t}) AS fp, "
        "count(*) FILTER (WHERE y = 1 AND NOT score >= {t}) AS fn, count(*) FILTER (WHERE y = 1 AND score >= {t}) AS tp FROM sc)")
RATIOS = ("cr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, "
          "CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall, "
          "CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity FROM "
          "(SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp FROM cm))")


@register("confusion", S.with_(SCORED, CONF.format(t=THRESHOLD), RATIOS) + (
    f"SELECT {THRESHOLD}::DOUBLE AS threshold, CAST(tn AS BIGINT) AS tn, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, "
    "CAST(tp AS BIGINT) AS tp, round(precision, 6) AS precision, round(recall, 6) AS recall_sensitivity, "
    "round(specificity, 6) AS specificity, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) "
    "ELSE 0.0 END, 6) AS f1_score, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy FROM cr"))
def confusion(spark, d):
    return round_doubles(ranking.confusion_at(_scored(spark, d), THRESHOLD))


def _prf(tp, fp, fn):
    p = f"CASE WHEN {tp} + {fp} > 0 THEN {tp} / ({tp} + {fp}) ELSE 0.0 END"
    r = f"CASE WHEN {tp} + {fn} > 0 THEN {tp} / ({tp} + {fn}) ELSE 0.0 END"
    return p, r, f"CASE WHEN ({p}) + ({r}) > 0 THEN 2 * ({p}) * ({r}) / (({p}) + ({r})) ELSE 0.0 END"


_p1, _r1, _f1 = _prf("tp", "fp", "fn")
_p0, _r0, _f0 = _prf("tn", "fn", "fp")
CLASS_SQL = S.with_(SCORED, CONF.format(t=THRESHOLD),
                    "c AS (SELECT CAST(tn AS DOUBLE) AS tn, CAST(fp AS DOUBLE) AS fp, CAST(fn AS DOUBLE) AS fn, CAST(tp AS DOUBLE) AS tp FROM cm)") + (
    f"SELECT '0' AS label, round({_p0}, 6) AS precision, round({_r0}, 6) AS recall, round({_f0}, 6) AS f1_score, tn + fp AS support FROM c "
    f"UNION ALL SELECT '1', round({_p1}, 6), round({_r1}, 6), round({_f1}, 6), tp + fn FROM c "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round((tp + tn) / (tp + tn + fp + fn), 6), tp + tn + fp + fn FROM c "
    f"UNION ALL SELECT 'macro avg', round((({_p0}) + ({_p1})) / 2, 6), round((({_r0}) + ({_r1})) / 2, 6), round((({_f0}) + ({_f1})) / 2, 6), tp + tn + fp + fn FROM c "
    f"UNION ALL SELECT 'weighted avg', round((({_p0}) * (tn + fp) + ({_p1}) * (tp + fn)) / (tp + tn + fp + fn), 6), "
    f"round((({_r0}) * (tn + fp) + ({_r1}) * (tp + fn)) / (tp + tn + fp + fn), 6), "
    f"round((({_f0}) * (tn + fp) + ({_f1}) * (tp + fn)) / (tp + tn + fp + fn), 6), tp + tn + fp + fn FROM c")


@register("class_report", CLASS_SQL)
def class_report(spark, d):
    return round_doubles(ranking.classification_report(_scored(spark, d), THRESHOLD))


FOCAL_SQL = (
    "WITH fl AS (SELECT CAST(l_returnflag = 'R' AS DOUBLE) AS y, least(greatest(l_discount * 10, 1e-7), 1 - 1e-7) AS p FROM lineitem), "
    "ft AS (SELECT y, y * p + (1 - y) * (1 - p) AS pt, y * 0.25 + (1 - y) * (1 - 0.25) AS a_t FROM fl) "
    "SELECT count(*) AS n, round(avg(-a_t * pow(1 - pt, 2.0) * ln(pt)), 6) AS focal_loss FROM ft")


@register("focal_loss", FOCAL_SQL)
def focal_loss(spark, d):
    li = standin.table(spark, d, "lineitem")
    df = li.select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return round_doubles(ranking.mean_focal_loss(df, "y", "p"))


@register("class_weights", "SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight FROM "
                           "(SELECT CAST(l_returnflag = 'R' AS INTEGER) AS label, count(*) AS n FROM lineitem GROUP BY 1)")
def class_weights(spark, d):
    return round_doubles(ranking.class_weights(_scored(spark, d), "y"))


EVENT_SCORED = (S.RW[0] + ",\n" + "esc AS (SELECT CAST(r.\"SepsisLabel\" AS INTEGER) AS y, least(e.value / 500.0, 1.0) AS score FROM events e "
                "JOIN rw0 r ON r.patient_id = e.user_id AND r.hr = CAST(date_trunc('hour', e.ts) AS TIMESTAMP))")


@register("event_metrics", "WITH " + EVENT_SCORED + ",\n" + ",\n".join(h.replace("FROM sc GROUP BY 1", "FROM esc GROUP BY 1") for h in HIST[1:])
          + "\nSELECT count(*) AS n, round(avg(y), 6) AS positive_rate, "
            "(SELECT round(sum(neg * (cum_pos + cum_pos - pos) / 2.0) / (max(P) * max(N)), 6) FROM cum) AS auroc, "
            "(SELECT round(sum(CASE WHEN pos > 0 THEN pos / P * (cum_pos / (cum_pos + cum_neg)) ELSE 0.0 END), 6) FROM cum) AS auprc FROM esc")
def event_metrics(spark, d):
    """F14/F15 on the event stream: y = the hour's label, score = the event's probability."""
    ev = standin.table(spark, d, "events").select("user_id", "ts", "value")
    rw = standin.readings_wide(spark, d).select("patient_id", "hr", "SepsisLabel")
    j = ev.join(rw, (ev.user_id == rw.patient_id) & (F.date_trunc("hour", ev.ts).cast("timestamp_ntz") == rw.hr))
    s = j.select(F.col("SepsisLabel").cast("int").alias("y"), standin.prob_expr(F.col("value")).alias("score"))
    return round_doubles(ranking.score_summary(ranking.cumulative_desc(ranking.score_histogram(s))))
