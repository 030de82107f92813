"""Classification metrics (F13-F18, F22, F23) without a global single-task sort.

Ranking metrics start from a score histogram (one row per distinct score with
positive/negative counts; partial aggregation absorbs heavy ties). Cumulative
counts in descending score order come from a distributed prefix sum: the
histogram is range-partitioned by score and checkpointed (so partition ids
stay fixed), per-partition totals (one row per partition) become offsets, and
each partition runs its own running sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.functions import clinical
from wardline.session import reliable_checkpoint


def score_histogram(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    return df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))


def cumulative_desc(hist: DataFrame, num_partitions: int | None = None, keep_part: bool = False) -> DataFrame:
    """Adds cum_pos / cum_neg = counts at scores >= this score."""
    spark = hist.sparkSession
    n = num_partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = hist.repartitionByRange(n, F.col("score").desc()).withColumn("_part", F.spark_partition_id())
    ranged = reliable_checkpoint(ranged)
    # one row per partition: bounded by the partition count
    totals = sorted((r["_part"], r["p"], r["q"]) for r in
                    ranged.groupBy("_part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q")).collect())
    offsets, acc_p, acc_n = [], 0, 0
    for part, p, q in totals:
        offsets.append((part, acc_p, acc_n))
        acc_p += p
        acc_n += q
    off = spark.createDataFrame(offsets or [(0, 0, 0)], "_part int, _op long, _on long")
    j = ranged.join(F.broadcast(off), "_part")
    w = Window.partitionBy("_part").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return j.select("score", "pos", "neg",
                    (F.col("_op") + F.sum("pos").over(w)).alias("cum_pos"),
                    (F.col("_on") + F.sum("neg").over(w)).alias("cum_neg"),
                    F.lit(acc_p).alias("P"), F.lit(acc_n).alias("N"), *(["_part"] if keep_part else []))


def auroc_auprc(cum: DataFrame) -> DataFrame:
    """F14 + F15 in one pass: trapezoid AUROC (ties as half) and step average precision."""
    prev_pos = F.col("cum_pos") - F.col("pos")
    area = F.col("neg") * (F.col("cum_pos") + prev_pos) / 2.0
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ap = F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * prec).otherwise(F.lit(0.0))
    pn = F.first("P").cast("double") * F.first("N").cast("double")
    return cum.agg((F.sum(area) / pn).alias("auroc"), F.sum(ap).alias("auprc"))


def score_summary(cum: DataFrame) -> DataFrame:
    """n, positive rate, AUROC and average precision in one pass over the cumulative histogram."""
    prev_pos = F.col("cum_pos") - F.col("pos")
    area = F.col("neg") * (F.col("cum_pos") + prev_pos) / 2.0
    prec = F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    ap = F.when(F.col("pos") > 0, F.col("pos") / F.col("P") * prec).otherwise(F.lit(0.0))
    p, n = F.first("P").cast("double"), F.first("N").cast("double")
    return cum.agg((F.first("P") + F.first("N")).alias("n"), (p / (p + n)).alias("positive_rate"),
                   (F.sum(area) / (p * n)).alias("auroc"), F.sum(ap).alias("auprc"))


def roc_points(cum: DataFrame) -> DataFrame:
    """F16: (fpr, tpr, threshold) for every distinct score plus the (0, 0, +inf) start."""
    pts = cum.select((F.col("cum_neg") / F.col("N")).alias("fpr"), (F.col("cum_pos") / F.col("P")).alias("tpr"),
                     F.col("score").alias("threshold"))
    spark = cum.sparkSession
    start = spark.createDataFrame([(0.0, 0.0, float("inf"))], "fpr double, tpr double, threshold double")
    return start.unionByName(pts)


def sparse_roc_points(hist: DataFrame, num_partitions: int | None = None) -> DataFrame:
    """F16 without the points whose step equals the next one's (Q11): a point goes when the next threshold adds as many
    positives and negatives as its own did; the first and the last stay.

    Thresholds are range-partitioned; a partition learns the first step of the next one from a table of
    one row a partition.
    """
    cum = cumulative_desc(hist, num_partitions, keep_part=True)
    step = F.struct("pos", "neg")
    heads = sorted((r["_part"], r["h"]["pos"], r["h"]["neg"]) for r in cum.groupBy("_part").agg(F.max_by(step, "score").alias("h")).collect())
    after = [(a[0], *b[1:]) for a, b in zip(heads, heads[1:], strict=False)]
    follow = hist.sparkSession.createDataFrame(after, "_part int, _next_pos long, _next_neg long")
    w = Window.partitionBy("_part").orderBy(F.col("score").desc())
    rows = cum.withColumns({"_n": F.lead(step).over(w), "_first": F.row_number().over(w) == 1}).join(F.broadcast(follow), "_part", "left")
    pos, neg = F.coalesce("_n.pos", "_next_pos"), F.coalesce("_n.neg", "_next_neg")
    first = F.col("_first") & (F.col("_part") == F.lit(heads[0][0] if heads else 0))
    return roc_points(rows.filter(first | pos.isNull() | (pos != F.col("pos")) | (neg != F.col("neg"))))


def pr_points(cum: DataFrame) -> DataFrame:
    """Precision / recall / F1 at every distinct threshold (zero division → 0)."""
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    precision = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(F.lit(0.0))
    recall = F.when(F.col("P") > 0, tp / F.col("P")).otherwise(F.lit(1.0))
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(F.lit(0.0))
    return cum.select(F.col("score").alias("threshold"), precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def best_f1_threshold(cum: DataFrame) -> DataFrame:
    """threshold with the highest F1; the lowest threshold wins ties; 0.5 when no threshold."""
    pr = pr_points(cum)
    best = pr.agg(F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                           F.struct(F.col("f1"), -F.col("threshold"))).alias("b"), F.count(F.lit(1)).alias("_n"))
    return best.select(F.coalesce(F.col("b.threshold"), F.lit(0.5)).alias("threshold"),
                       F.col("b.precision").alias("precision"), F.col("b.recall").alias("recall"), F.col("b.f1").alias("f1"))


def confusion_at(df: DataFrame, threshold: float | Column, y: str = "y", score: str = "score") -> DataFrame:
    """confusion counts and guarded ratios at a threshold (p >= t is positive)."""
    t = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    pred = F.col(score) >= t
    pos = F.col(y) == 1
    c = df.agg(F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"),
               F.count_if(pos & ~pred).alias("fn"), F.count_if(pos & pred).alias("tp"))
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))
    prec = F.when(tp + fp > 0, tp / (tp + fp)).otherwise(0.0)
    rec = F.when(tp + fn > 0, tp / (tp + fn)).otherwise(0.0)
    spec = F.when(tn + fp > 0, tn / (tn + fp)).otherwise(0.0)
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(0.0)
    acc = (tp + tn) / (tp + tn + fp + fn)
    return c.select(t.cast("double").alias("threshold"), "tn", "fp", "fn", "tp", prec.alias("precision"),
                    rec.alias("recall_sensitivity"), spec.alias("specificity"), f1.alias("f1_score"), acc.alias("accuracy"))


def classification_report(df: DataFrame, threshold: float, y: str = "y", score: str = "score") -> DataFrame:
    """per-class precision/recall/F1/support, accuracy, macro and weighted averages."""
    cm = confusion_at(df, threshold, y, score)
    tp, fp, fn, tn = (F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn"))

    def prf(tp_, fp_, fn_):
        p = F.when(tp_ + fp_ > 0, tp_ / (tp_ + fp_)).otherwise(0.0)
        r = F.when(tp_ + fn_ > 0, tp_ / (tp_ + fn_)).otherwise(0.0)
        f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)
        return p, r, f

    p1, r1, f1 = prf(tp, fp, fn)
    p0, r0, f0 = prf(tn, fn, fp)
    s1, s0 = tp + fn, tn + fp
    tot = s0 + s1
    row = lambda lab, p, r, f, s: F.struct(F.lit(lab).alias("label"), p.alias("precision"), r.alias("recall"),
                                           f.alias("f1_score"), s.alias("support"))
    nul = F.lit(None).cast("double")
    return cm.select(F.inline(F.array(
        row("0", p0, r0, f0, s0), row("1", p1, r1, f1, s1),
        row("accuracy", nul, nul, (tp + tn) / tot, tot),
        row("macro avg", (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, tot),
        row("weighted avg", (p0 * s0 + p1 * s1) / tot, (r0 * s0 + r1 * s1) / tot, (f0 * s0 + f1 * s1) / tot, tot))))


def mean_focal_loss(df: DataFrame, y: str = "y", p: str = "score", **kw) -> DataFrame:
    """mean of the per-row focal loss (C17)."""
    return df.agg(F.count(F.lit(1)).alias("n"), F.avg(clinical.focal_loss(F.col(y), F.col(p), **kw)).alias("focal_loss"))


def class_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """balanced class weights n / (k * n_c); the class table has one row per class."""
    counts = df.groupBy(y).agg(F.count(F.lit(1)).alias("n"))
    # one array holding one entry per class (bounded by the number of classes)
    arr = counts.agg(F.collect_list(F.struct(F.col(y).alias("label"), "n")).alias("_a"))
    tot = F.aggregate("_a", F.lit(0).cast("long"), lambda acc, x: acc + x["n"])
    k = F.size("_a")
    return arr.select(F.inline(F.transform("_a", lambda x: F.struct(
        x["label"].alias("label"), x["n"].alias("n"), (tot / (k * x["n"])).alias("weight")))))
