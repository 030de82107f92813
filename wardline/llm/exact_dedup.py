"""Exact dedup by progressive refinement (DataFrame functions only).

1. rows are grouped by text length;
2. rows of shared lengths are grouped by a hash of their first characters;
3. only rows that still share (length, prefix) with another row have their
   whole text hashed (SHA-256), and equal hashes form a group.

The first two levels move three numbers per row. The surviving (length,
prefix) keys are written once; they are broadcast when their counted size is
below the bound, else the third level is a shuffled join. A hot group is never
gathered: groups are aggregates with map-side combine, and the join back is an
equi-join that adaptive execution can split.

Defined results: a null text counts as empty; empty texts equal each other;
repeated rows (same id and text) are one document; a null id is an id of its
own and is kept only when no other id shares the text; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Landed, ascii_lower, broadcast_if_small

PREFIX_CHARS = 64


def _keyed(docs: DataFrame, text: Column) -> tuple[DataFrame, Landed]:
    """``docs`` with length and prefix hash (__n, __p), and the written keys that two rows or more share."""
    rows = docs.withColumns({"__n": F.octet_length(text), "__p": F.xxhash64(ascii_lower(F.substring(text, 1, PREFIX_CHARS)))})
    slim = rows.select("__n", "__p")
    lengths = slim.groupBy("__n").count().filter("count > 1").select("__n")
    return rows, Landed(slim.join(lengths, "__n", "left_semi").groupBy("__n", "__p").count().filter("count > 1")
                        .select("__n", "__p", F.lit(True).alias("__shared")), "dedup-keys")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 digest_all: bool = False) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256.

    ``text_sha256`` is null for documents that no other can equal, whose content
    is then never read in full; ``digest_all`` fills it in for every document.
    """
    keyed, keys = _keyed(docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")), F.col("t"))
    # 32 bytes: two longs, a flag and the row header
    marked = keyed.join(broadcast_if_small(keys.df, 32), ["__n", "__p"], "left")
    shared = F.coalesce("__shared", F.lit(False))
    digest = F.sha2(ascii_lower("t"), 256)
    marked = Landed(marked.select("id", shared.alias("shared"),
                                  (digest if digest_all else F.when(shared, digest)).alias("text_sha256")),
                    "dedup-marked")
    keys.drop()
    rows = marked.df.filter("shared").select("id", "text_sha256").distinct()
    groups = rows.groupBy("text_sha256").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = rows.join(groups, "text_sha256").select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
    single = marked.df.filter("not shared").select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "text_sha256")
    return many.unionByName(single).withColumnRenamed("id", id_col)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns; repeated rows stay once.

    Only rows that share (length, prefix) with another have their text hashed; the others stay as they are.
    """
    found = exact_groups(docs, id_col, text_col)
    gone = found.filter("not kept").select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed, keys = _keyed(docs, text)
    rows = keyed.join(broadcast_if_small(keys.df, 32), ["__n", "__p"], "left")
    rows = rows.withColumn("__own", F.when(F.col("__shared"), F.sha2(ascii_lower(text), 256)))
    rows = rows.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")), "left_anti")
    # a row without a digest is alone with its length and prefix
    return rows.dropDuplicates([id_col, "__n", "__p", "__own"]).select(*docs.columns)
