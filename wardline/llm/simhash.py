"""SimHash near-dedup by anchor-point covering.

Fingerprints (64 bits, XXH64 of word shingles) are linked when they differ in
at most two bits. Anchors are the codewords of a covering code: the direct
product of two perfect binary Golay codes [23, 12] on bits 0-22 and 23-45. Each
block has covering radius 3, so every fingerprint has one anchor within radius
3 in either block: its home. A fingerprint two bits away lies within 3 + e1 and
3 + e2 of that anchor with e1 + e2 <= 2. So every fingerprint is sent to all
anchors within covering radius plus threshold (61 on average, at most
MAX_REPLICAS), and at each anchor the residents are compared with the visitors
over all 64 bits, by an equi-join on the anchor that adaptive execution can
split. No link is missed and each is found once (at the smaller one's home).

Only distinct fingerprints take part, so a group of equal ones is one row. The
graph of links is closed by label propagation with pointer jumping; each round
is a written table.

Defined results: null, empty and blank texts have fingerprint zero, which links
like any other; a text of fewer words than a shingle is one shingle; repeated
rows give a row each; a null id never names a component (a component of such
rows only has a null id); an empty table gives an empty table; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Landed

SHINGLE = 3
MAX_BITS = 2
SEED = 42
_HASHES_AT_ONCE = 1 << 15

# The perfect Golay code: length 23, dimension 12, generator polynomial
# x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 (fixed value).
LENGTH, CHECKS = 23, 11
GENERATOR = 0b101011100011
RADIUS = 3
MASK = (1 << LENGTH) - 1


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders modulo the generator polynomial."""
    r = words.astype(np.int64).copy()
    for bit in range(LENGTH - 1, CHECKS - 1, -1):
        r ^= np.where((r >> bit) & 1, GENERATOR << (bit - CHECKS), 0)
    return r


def _patterns() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All error patterns of weight up to radius + threshold, by syndrome.

    Returns (patterns, weights beyond the radius, start of each syndrome's run);
    within a run the lightest pattern (weight <= 3, unique) comes first.
    """
    masks, weights = [], []
    for weight in range(RADIUS + MAX_BITS + 1):
        for bits in combinations(range(LENGTH), weight):
            masks.append(sum(1 << b for b in bits))
            weights.append(weight)
    masks, weights = np.array(masks, np.int64), np.array(weights)
    order = np.lexsort((masks, weights, _syndromes(masks)))
    masks, weights = masks[order], weights[order]
    cuts = np.searchsorted(_syndromes(masks), np.arange((1 << CHECKS) + 1))
    return masks, np.maximum(weights - RADIUS, 0), cuts


PATTERNS, BEYOND, CUTS = _patterns()
MAX_REPLICAS = int(np.diff(CUTS).max()) ** 2


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned integer."""
    data = text.encode() if isinstance(text, str) else text or b""
    words = data.lower().split()  # bytes: folds A-Z only and splits at ASCII white space
    if not words:
        return 0
    if len(words) < shingle:
        shingles = iter([b" ".join(words)])
        n = 1
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        n = len(words) - shingle + 1
    ones = np.zeros(64, np.int64)
    left = n
    while left:
        k = min(left, _HASHES_AT_ONCE)
        h = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for _, s in zip(range(k), shingles, strict=False)), ">u8", k)
        ones += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1).sum(axis=0, dtype=np.int64)
        left -= k
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def _fingerprints(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        raw = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else None) for t in texts.cast(pa.binary())]
        yield pa.array(np.array(raw, np.uint64).view(np.int64))


_fingerprints.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def anchor_lists(fps: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Home anchor and all anchors within radius plus threshold of each fingerprint (int64)."""
    home = np.zeros(len(fps), np.int64)
    runs = []
    for block in (0, 1):
        word = (fps >> (LENGTH * block)) & MASK
        s = _syndromes(word)
        # the codeword is fixed by its upper 12 bits
        home |= ((word ^ PATTERNS[CUTS[s]]) >> CHECKS) << (12 * block)
        runs.append((word, CUTS[s], CUTS[s + 1]))
    out = []
    for i in range(len(fps)):
        (w0, a0, b0), (w1, a1, b1) = ((w[i], a[i], b[i]) for w, a, b in runs)
        near = BEYOND[a0:b0, None] + BEYOND[None, a1:b1] <= MAX_BITS
        both = ((w0 ^ PATTERNS[a0:b0]) >> CHECKS)[:, None] | (((w1 ^ PATTERNS[a1:b1]) >> CHECKS) << 12)[None]
        out.append(both[near])
    return home, out


def _anchors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for fps in batches:
        home, near = anchor_lists(fps.to_numpy(zero_copy_only=False).astype(np.int64))
        yield pa.StructArray.from_arrays([pa.array(home), pa.array(near, pa.list_(pa.int64()))], ["home", "near"])


_anchors.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}


def links(fps: DataFrame) -> DataFrame:
    """Pairs (a < b) of the distinct fingerprints in column ``fp`` that differ in at most MAX_BITS bits."""
    anchors = F.arrow_udf(_anchors, "home long, near array<long>")("fp")
    placed = Landed(fps.select("fp", anchors.alias("at")).select("fp", "at.home", "at.near"), "simhash-anchors").df
    residents = placed.select(F.col("home").alias("anchor"), F.col("fp").alias("a"))
    visitors = placed.select(F.explode("near").alias("anchor"), F.col("fp").alias("b"))
    close = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS
    return residents.join(visitors, "anchor").filter((F.col("a") < F.col("b")) & close).select("a", "b")


def components(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the pairs can reach."""
    both = Landed(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))), "links-both").df
    now = Landed(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                 .select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        label = now.df
        best = (both.join(label.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("label").alias("near")))
        hop = label.select(F.col("node").alias("label"), F.col("label").alias("far"))
        step = label.join(best, "node").join(hop, "label").select(
            "node", F.least("label", "near", "far").alias("next"), "label")
        after = Landed(step.select("node", F.col("next").alias("label"), (F.col("next") < F.col("label")).alias("moved")),
                       "labels")
        now.drop()
        now = after
        if not now.df.filter("moved").limit(1).count():
            return now.df.select("node", "label")


def _labelled(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``near_groups`` as id, fp, component_id, text_hash, and the component's label (its smallest fp)."""
    hashed = docs.select(F.col(id_col).alias("id"), F.arrow_udf(_fingerprints, "long")(F.col(text_col)).alias("fp"),
                         F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"))
    rows = Landed(hashed, "simhash-rows").df
    first = rows.groupBy("fp").agg(F.min("id").alias("first"))
    first = Landed(first, "simhash-distinct").df
    label = components(links(first.select("fp")))
    linked = first.join(label.withColumnRenamed("node", "fp"), "fp", "left")
    linked = linked.select("fp", "first", F.coalesce("label", "fp").alias("label"))
    smallest = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    by_print = Landed(linked.join(smallest, "label").select("fp", "component_id", "label"), "simhash-components").df
    return rows.join(by_print, "fp").select("id", "fp", "component_id", "text_hash", "label")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: id, fp (long), component_id (smallest id reachable), text_hash."""
    return _labelled(docs, id_col, text_col).select(F.col("id").alias(id_col), "fp", "component_id", "text_hash")


def hex_fingerprint(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def keep_one_of_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` of which one stays per group of near copies (the smallest id), with all columns.

    Groups go by their label: a component_id is null for all components without
    an id, and one id with several texts may name several. Rows with a null id
    never win over others; rows of one id and several texts in a group stay once.
    """
    groups = _labelled(docs, id_col, text_col)
    best = groups.groupBy("label").agg(F.min_by(F.struct(F.col("id").alias("__id"), F.col("text_hash").alias("__th")),
                                                F.struct(F.col("id").isNull(), "id", "text_hash")).alias("k"))
    best = best.select("k.*")
    rows = docs.withColumn("__own", F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__th"))
    return rows.join(best, same, "left_semi").dropDuplicates([id_col, "__own"]).select(*docs.columns)
