"""Conforming a coded-event source to the canonical channels (M2: A4, C2, C3, D5, D6, E2-E4, F1, F26, G7, I2, I3).

Dictionaries and the resolved mapping are small (bounded by the item
dictionary and the channel vocabulary); events are the large side and are
only ever joined against the mapping (broadcast: at most one row per channel).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline import vocab
from wardline.session import reliable_checkpoint


def candidates_frame(spark: SparkSession, candidates: Mapping[str, Sequence[str]], source: str) -> DataFrame:
    """(channel, source, cand) with lower-cased candidate labels (C3); bounded by the vocabulary."""
    rows = [(ch, source, c.lower()) for ch, labels in candidates.items() for c in labels]
    return spark.createDataFrame(rows, "channel string, source string, cand string")


def item_counts(events: DataFrame, item: str = "itemid") -> DataFrame:
    """events per item (only the item column is read)."""
    return events.groupBy(item).agg(F.count(F.lit(1)).alias("n"))


def resolve_mapping(dictionary: DataFrame, counts: DataFrame, cands: DataFrame, priority: Sequence[str],
                    fahrenheit: dict[str, Sequence[str]] | None = None) -> DataFrame:
    """G7 + E2 + E4 in one pass: ``dictionary`` (itemid, label, kind) against candidates
    (channel, source, cand) with ``kind == source``; one event count for all sources, or one
    for each (``counts`` with a column ``kind``); per channel the earliest source in ``priority`` wins. The result (at most one row per
    channel) is checkpointed so every consumer reads it instead of recomputing it.
    """
    m = dictionary.join(F.broadcast(cands), (F.col("kind") == F.col("source")) & (F.lower(F.col("label")) == F.col("cand"))) \
        .join(counts, ["itemid", "kind"] if "kind" in counts.columns else "itemid", "left").withColumn("n", F.coalesce(F.col("n"), F.lit(0)))
    best = m.groupBy("channel", "source").agg(
        F.max_by(F.struct("itemid", "label", "n"), F.struct(F.col("n"), -F.col("itemid"))).alias("b")) \
        .filter(F.col("b.n") > 0)
    rank = F.create_map(*[x for i, src in enumerate(priority) for x in (F.lit(src), F.lit(-i))])
    pick = best.groupBy("channel").agg(F.max_by(F.struct("source", "b"), rank[F.col("source")]).alias("p"))
    fahr = F.lit(False)
    for src, labels in (fahrenheit or {}).items():
        fahr = fahr | ((F.col("p.source") == src) & F.col("p.b.label").isin(list(labels)))
    out = pick.select("channel", F.col("p.source").alias("source"), F.col("p.b.itemid").alias("itemid"),
                      F.col("p.b.label").alias("label"), F.col("p.b.n").alias("n_events"), fahr.alias("is_fahrenheit"))
    return reliable_checkpoint(out)


def conform_events(events: DataFrame, mapping: DataFrame, subject: str = "subject_id", time: str = "charttime",
                   item: str = "itemid", value: str = "valuenum", dataset: str = vocab.CODED_DATASET) -> DataFrame:
    """E3 + C2 + D5: tall canonical readings; Fahrenheit items converted to Celsius, time text parsed,
    ``source`` the data set on all rows.

    The mapping has at most one row per channel, a proven bound for the broadcast.
    """
    j = events.filter(F.col(value).isNotNull()).join(
        F.broadcast(mapping.select(F.col("itemid").alias(item), "channel", "is_fahrenheit")), item)
    at = F.col(time).cast("timestamp") if events.schema[time].dataType.simpleString() == "string" else F.col(time)
    v = F.when(F.col("is_fahrenheit"), (F.col(value) - 32) * 5 / 9).otherwise(F.col(value))
    return j.select(F.col(subject).cast("string").alias("patient_id"), at.alias("charttime"),
                    "channel", v.alias("value"), F.lit(dataset).alias("source"))


def join_stays(stays: DataFrame, admissions: DataFrame, patients: DataFrame, dataset: str = vocab.CODED_DATASET) -> DataFrame:
    """Stays with their admission (subject_id, hadm_id) and patient (subject_id), renamed to the patient table."""
    j = stays.join(admissions.select("subject_id", "hadm_id"), ["subject_id", "hadm_id"], "left") \
        .join(patients.select("subject_id", "gender", "anchor_age"), "subject_id", "left")
    return j.select(F.col("subject_id").cast("string").alias("patient_id"), "stay_id", F.col("anchor_age").alias("age"),
                    F.col("gender").alias("sex"), F.col("first_careunit").alias("unit_admitted"),
                    F.col("intime").alias("admission_time"), "outtime", "los", F.lit(dataset).alias("source_dataset"))


def unresolved(mapping: DataFrame, vocabulary: Sequence[str] = vocab.CLINICAL_CHANNELS) -> DataFrame:
    """Vocabulary channels without a resolved item."""
    spark = mapping.sparkSession
    voc = spark.createDataFrame([(c, i) for i, c in enumerate(vocabulary)], "channel string, position int")
    return voc.join(mapping.select("channel"), "channel", "left_anti")


def mapping_report(readings: DataFrame, mapping: DataFrame, vocabulary: Sequence[str] = vocab.CLINICAL_CHANNELS) -> DataFrame:
    """n_patients, n_rows, resolved and unresolved channel counts (one row)."""
    r = readings.agg(F.countDistinct("patient_id").alias("n_patients"), F.count(F.lit(1)).alias("n_rows"))
    m = mapping.agg(F.count(F.lit(1)).alias("n_resolved"))
    u = unresolved(mapping, vocabulary).agg(F.count(F.lit(1)).alias("n_unresolved"))
    return r.select(F.inline(F.array(F.struct(F.lit("n_patients").alias("metric"), F.col("n_patients").alias("value")),
                                      F.struct(F.lit("n_rows").alias("metric"), F.col("n_rows").alias("value"))))) \
        .unionByName(m.select(F.lit("n_resolved").alias("metric"), F.col("n_resolved").alias("value"))) \
        .unionByName(u.select(F.lit("n_unresolved").alias("metric"), F.col("n_unresolved").alias("value")))


def mapping_lists(mapping: DataFrame, vocabulary: Sequence[str] = vocab.CLINICAL_CHANNELS) -> DataFrame:
    """every vocabulary channel with its resolved item, or none (one row per channel)."""
    voc = mapping.sparkSession.createDataFrame([(c,) for c in vocabulary], "channel string")
    return voc.join(mapping.select("channel", "itemid", "label", "is_fahrenheit"), "channel", "left") \
        .withColumn("resolved", F.col("itemid").isNotNull())
