"""Entity-level stratified split (G11, F9, E5, I4) without a single-task ranking window."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.session import reliable_checkpoint


def ever_positive(df: DataFrame, key: str = "patient_id", label: str = "SepsisLabel") -> DataFrame:
    """one row per entity with max(label) (partial aggregation, skew-safe)."""
    return df.groupBy(key).agg(F.max(label).cast("int").alias("ever_positive"))


def split_hash(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def _round_half_up(n: int, frac: float) -> int:
    return int((Decimal(n) * Decimal(str(frac))).quantize(Decimal(1), rounding=ROUND_HALF_UP))


def exact_rank(df: DataFrame, group: str, hash_col: str, tie: str, hex_digits: int = 4) -> DataFrame:
    """Exact 1-based rank of each row inside ``group`` by (hash, tie).

    Rows are bucketed by the hash prefix; bucket counts (at most
    groups x 16^hex_digits rows) get a running offset, and the final
    row_number runs per (group, bucket). A uniform hash keeps buckets
    balanced, so no task ever holds a whole group.
    """
    bucket = F.substring(F.col(hash_col), 1, hex_digits)
    b = df.withColumn("_bucket", bucket)
    counts = b.groupBy(group, "_bucket").agg(F.count(F.lit(1)).alias("_cnt"))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(group, "_bucket", F.coalesce(F.sum("_cnt").over(before), F.lit(0)).alias("_off"))
    # offsets has at most (#groups x 16^hex_digits) rows: a proven bound.
    joined = b.join(F.broadcast(offsets), [group, "_bucket"])
    inner = Window.partitionBy(group, "_bucket").orderBy(hash_col, tie)
    return joined.withColumn("_rank", F.col("_off") + F.row_number().over(inner)).drop("_bucket", "_off")


def split_entities(df: DataFrame, key: str = "patient_id", label: str = "SepsisLabel",
                   val_size: float = 0.15, test_size: float = 0.15, seed: int = 42) -> DataFrame:
    """Entity → train/val/test, stratified on ever-positive.

    Inside each stratum entities are ordered by md5(id ':' seed); the first
    round(n*test) go to test, the next round(n*val) to val, the rest to
    train. If a class has fewer than two members the split is unstratified.
    The only driver round trip is the per-class entity count (two numbers).
    """
    # one row per entity; cut lineage so the readings are not recomputed by the later jobs
    per = reliable_checkpoint(ever_positive(df, key, label))
    class_counts = {r["ever_positive"]: r["n"] for r in per.groupBy("ever_positive").agg(F.count(F.lit(1)).alias("n")).collect()}
    stratified = bool(class_counts) and min(class_counts.values()) >= 2
    if stratified:
        per = per.withColumn("_stratum", F.col("ever_positive"))
        sizes = class_counts
    else:
        per = per.withColumn("_stratum", F.lit(0))
        sizes = {0: sum(class_counts.values())}
    per = per.withColumn("_h", split_hash(F.col(key), seed))
    ranked = exact_rank(per, "_stratum", "_h", key)
    n_test = {s: _round_half_up(n, test_size) for s, n in sizes.items()}
    n_val = {s: _round_half_up(n, val_size) for s, n in sizes.items()}
    test_cut = F.create_map(*[x for s in sizes for x in (F.lit(s), F.lit(n_test[s]))])
    val_cut = F.create_map(*[x for s in sizes for x in (F.lit(s), F.lit(n_test[s] + n_val[s]))])
    k = F.col("_rank")
    split = (F.when(k <= test_cut[F.col("_stratum")], "test")
             .when(k <= val_cut[F.col("_stratum")], "val").otherwise("train"))
    return ranked.select(key, "ever_positive", split.alias("split"))


def attach_split(df: DataFrame, split: DataFrame, key: str = "patient_id") -> DataFrame:
    """E5: attach the split to every row; an entity missing from the split fails the job."""
    j = df.join(split.select(key, "split"), key, "left")
    return j.withColumn("split", F.when(F.col("split").isNull(),
                                        F.raise_error(F.concat(F.lit("entity was not part of this split: "), F.col(key).cast("string"))))
                        .otherwise(F.col("split")))


def split_violations(split: DataFrame, key: str = "patient_id") -> DataFrame:
    """I4: entities assigned to more than one split (must be empty)."""
    return split.groupBy(key).agg(F.countDistinct("split").alias("n_splits")).filter(F.col("n_splits") > 1)
