"""Corpus pipeline: language ID, exact dedup, SimHash near-dedup, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it back as the next
stage's documents. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import Landed, crc32_mod3
from wardline.llm.decontaminate import drop_contaminated
from wardline.llm.exact_dedup import drop_exact_copies
from wardline.llm.language_id import UNDETERMINED, language, train
from wardline.llm.piece_nbest import encode_pieces
from wardline.llm.simhash import keep_one_of_near
from wardline.sources.tables import table

# Texts whose best language is less likely than this are rejected (no language of the four stands out).
LEAST_SCORE = 0.4
MODEL = "piece_bpe_32k.model"


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with an identified language; the network learns from two thirds of the labelled rows."""
    net = train(docs.filter(crc32_mod3(F.col("doc_id")) != 1))
    scored = language(docs, net, out="__lang_pred", score_out="__lang_score")
    if net is None:
        return scored.filter(F.lit(False)).select(*docs.columns)
    kept = (F.col("__lang_pred") != UNDETERMINED) & (F.col("__lang_score") >= LEAST_SCORE)
    return scored.filter(kept).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return drop_exact_copies(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash group the smallest doc_id stays."""
    return keep_one_of_near(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window stay."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece ids of the best segmentation, n-best scores, and whether decoding gives the text back."""
    with open(public_tokenizers.path(MODEL), "rb") as f:
        model = f.read()
    decoded = encode_pieces(docs.select("doc_id", "text"), model, with_text=True).select("doc_id", "text", "pieces.*")
    text = F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" "))
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "scores",
                          (F.col("decoded") == text).alias("round_trip"))


STAGES = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_dedup", near_stage),
    ("decontamination", decontamination_stage),
    ("piece_encoding", encoding_stage),
]

# The language network, the fingerprints' components and the n-best search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the ``documents`` table."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        landed = Landed(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            before.drop()
        docs, before = landed.df, landed
    return docs
