"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashed words, word pairs and pairs with one
word between (DIMENSIONS buckets, value 1). Per-coordinate learning rates and
L1 leave few weights other than zero; only those are broadcast (bounded by
DIMENSIONS). Every whole text is scored in numpy batches.

Training takes a bounded sample, by smallest id hash: at most SAMPLE_TOXIC
documents of label 1 and CLEAN_PER_TOXIC times as many of label 0, of at most
SAMPLE_BYTES bytes each.

Defined results: null and empty texts have no features and get the score of
the intercept; an id labelled twice counts as its largest label; without any
labelled row of both labels every score is 0; repeated rows give a row each;
an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import string_buffers
from wardline.llm.words_np import hashed_blocks, mix

BITS = 22
DIMENSIONS = 1 << BITS
SAMPLE_TOXIC = 3_000
CLEAN_PER_TOXIC = 2
SAMPLE_BYTES = 20_000
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.0
_PAIR, _SKIP = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def features(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and row of every word, pair and skip-pair (pairs stay within a row)."""
    shift = np.uint64(64 - BITS)
    parts, owners = [hashes >> shift], [rows]
    for gap, salt in ((1, _PAIR), (2, _SKIP)):
        same = rows[gap:] == rows[:-gap] if len(rows) > gap else np.zeros(0, bool)
        if len(same):
            pair = mix(hashes[:-gap] * salt + hashes[gap:])
            parts.append(pair[same] >> shift)
            owners.append(rows[gap:][same])
    return np.concatenate(parts).astype(np.int64), np.concatenate(owners)


@dataclass
class Weights:
    """Non-zero weights, ascending by bucket, and the intercept."""

    bucket: np.ndarray
    weight: np.ndarray
    intercept: float

    def dense(self) -> np.ndarray:
        out = np.zeros(DIMENSIONS, np.float32)
        out[self.bucket] = self.weight
        return out


def fit(examples: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, alpha: float = ALPHA,
        beta: float = BETA, l1: float = L1, l2: float = L2) -> Weights:
    """FTRL-proximal: one update per example; the last coordinate is the intercept (no L1)."""
    z, n = np.zeros(DIMENSIONS + 1), np.zeros(DIMENSIONS + 1)

    def weight(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        penalty = np.where(i == DIMENSIONS, 0.0, l1)
        return np.where(np.abs(zi) <= penalty, 0.0,
                        -(zi - np.sign(zi) * penalty) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        for x, y in zip(examples, labels, strict=True):
            i = np.append(x, DIMENSIONS).astype(np.int64)
            w = weight(i)
            g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            ni = n[i]
            sigma = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[i] += g - sigma * w
            n[i] = ni + g * g
    w = weight(np.arange(DIMENSIONS + 1))
    bucket = np.flatnonzero(w[:-1])
    return Weights(bucket.astype(np.int32), w[bucket].astype(np.float32), float(w[-1]))


def score_batch(texts: pa.Array, table: np.ndarray, intercept: float) -> np.ndarray:
    """Scores (0 to 1) of an Arrow string array; each feature counts once per text."""
    data, offsets = string_buffers(texts)
    total = np.full(len(offsets) - 1, intercept)
    for _, _, hashes, rows in hashed_blocks(data, offsets):
        bucket, owner = features(hashes, rows)
        live = table[bucket] != 0
        pairs = np.unique(owner[live] * DIMENSIONS + bucket[live])
        np.add.at(total, pairs // DIMENSIONS, table[pairs % DIMENSIONS])
    return 1.0 / (1.0 + np.exp(-np.clip(total, -500, 500)))


def _bucket_lists(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        data, offsets = string_buffers(texts)
        out = [np.zeros(0, np.int64)] * (len(offsets) - 1)
        for lo, hi, hashes, rows in hashed_blocks(data, offsets):
            bucket, owner = features(hashes, rows)
            pairs = np.unique(owner * DIMENSIONS + bucket)
            cuts = np.searchsorted(pairs, np.arange(lo, hi + 1) * DIMENSIONS)
            for row in range(lo, hi):
                out[row] = pairs[cuts[row - lo]:cuts[row - lo + 1]] % DIMENSIONS
        yield pa.array(out, pa.list_(pa.int32()))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic") -> Weights | None:
    """Fit on a bounded sample of labelled documents; None when a label is missing."""
    known = (labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull())
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("y")))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), F.xxhash64(text_col).alias("th"))
    texts = texts.filter(F.octet_length("t").between(1, SAMPLE_BYTES))
    # repeated rows of an id are one document: its least text hash
    ids = texts.select("id", "th").join(known, "id").groupBy("id", "y").agg(F.min("th").alias("th"))
    ids = ids.withColumn("order", F.xxhash64("id"))
    first = [ids.filter(F.col("y") == y).orderBy("order", "id") for y in (0, 1)]
    toxic = first[1].limit(SAMPLE_TOXIC).toArrow()
    clean = first[0].limit(CLEAN_PER_TOXIC * toxic.num_rows).toArrow()
    if not (toxic.num_rows and clean.num_rows):
        return None
    # at most (1 + CLEAN_PER_TOXIC) x SAMPLE_TOXIC rows of four numbers
    chosen = docs.sparkSession.createDataFrame(pa.concat_tables([toxic, clean]))
    sample = texts.join(F.broadcast(chosen), ["id", "th"]).dropDuplicates(["id"])
    _bucket_lists.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    rows = sample.select("order", "id", "y", F.arrow_udf(_bucket_lists, "array<int>")("t").alias("x")).toArrow()
    rows = rows.sort_by([("order", "ascending"), ("id", "ascending")])
    y = rows["y"].to_numpy().astype(float)
    lists = rows["x"].combine_chunks()
    values, cuts = lists.values.to_numpy(), lists.offsets.to_numpy()
    return fit([values[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], y)


def toxicity(docs: DataFrame, weights: Weights | None, text_col: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the toxicity score of each whole text."""
    if weights is None:
        return docs.withColumn(out, F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table, intercept = shared.value.dense(), shared.value.intercept
        for texts in batches:
            yield pa.array(score_batch(texts, table, intercept), pa.float64())

    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(score, "double")(F.col(text_col)))
