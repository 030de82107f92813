"""Benchmark decontamination by winnowing (DataFrame functions only).

Texts are word sequences. A window of WINDOW words has WINDOW - GRAM + 1
word GRAM-grams; the smallest of their hashes is its fingerprint. Equal windows
have equal fingerprints, so every shared span of WINDOW words is found:

1. the distinct fingerprints of documents are joined with those of benchmark
   items (plain equi-join: Catalyst broadcasts the item side when it is small);
2. hits bring the item's words to the document, where equal fingerprints give
   the alignments and each alignment is extended: words are compared one by one
   and runs of WINDOW equal words are occurrences.

Items of fewer than WINDOW words are one window of their own length; their
fingerprint is that of a window of that many words (GRAM words, or fewer when
the item is shorter), searched for among all grams of that size.

Defined results: null and empty texts have no words and are never hit; an item
without words never occurs; repeated item rows (same id and text) count once,
items of one id but other texts all count for that id, and an item without an
id marks words but is not listed; a repeated document row gives a row each; an
empty benchmark gives no hits; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import Landed, ascii_lower, broadcast_if_small, let

WINDOW = 10
GRAM = 6
# Fixed pattern: everything but ASCII letters, digits and non-ASCII characters separates words.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The same on text that is not lower-cased yet.
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a lower-cased text (null: no words)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def loose_lower(text: Column) -> Column:
    """A cheap fold for hashing: texts equal after lower-casing A-Z stay equal under it.

    Capital sigma is folded first, because its lower case depends on its neighbours.
    """
    return F.lower(F.replace(text, F.lit("Σ"), F.lit("σ")))


def _with_shifted(a: Column, by: int, combine) -> Column:
    """Combine each entry with the one ``by`` places on (null past the end)."""
    return let(a, lambda g: F.zip_with(g, F.slice(g, by + 1, F.lit(1 << 30)), combine))


def grams(hashes: Column, size: int) -> Column:
    """Hashes of ``size`` consecutive word hashes; the last size - 1 entries are partial."""
    out, have = hashes, 1
    while have < size:
        step = min(have, size - have)
        # overlapping halves cover the gram: (have words) + (have words, shifted by step)
        out = _with_shifted(out, step, lambda x, y: F.xxhash64(x, y))
        have += step
    return out


def window_min(values: Column, width: int) -> Column:
    """Smallest value of each run of ``width`` entries (runs at the end are shorter)."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = _with_shifted(out, step, lambda x, y: F.least(x, y))
        have += step
    return out


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def fingerprints(w: Column) -> Column:
    """Distinct winnowed fingerprints of a word array (partial windows at the end included)."""
    return F.array_distinct(window_min(grams(word_hashes(w), GRAM), WINDOW - GRAM + 1))


def _of_kind(kind: int, values: Column) -> Column:
    return F.transform(values, lambda h: F.struct(F.lit(kind).alias("kind"), h.alias("fp")))


def _items(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct items with words: ikey, item_id, exact words (iw), loosely folded words (lw)."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = (benchmark.select(F.col(id_col).cast("string").alias("item_id"), t.alias("it")).distinct()
            .select(F.xxhash64("item_id", "it").alias("ikey"), "item_id", words(ascii_lower("it")).alias("iw"),
                    words(loose_lower(F.col("it"))).alias("lw")))
    return rows.withColumn("size", F.size("iw")).filter("size > 0")


def _aligned(dw: Column, dh: Column, hit: Column) -> Column:
    """Starts (0-based, in the document) of occurring windows of one item."""
    m = F.least(F.size(hit["iw"]), F.lit(WINDOW))
    last = F.size(hit["iw"]) - m

    def starts_at(off: Column) -> Column:
        equal = F.transform(hit["iw"], lambda w, i: F.when((off + i >= 0) & (off + i < F.size(dw)),
                                                           F.get(dw, off + i) == w).otherwise(F.lit(False)))
        return let(equal, lambda eq: F.transform(
            F.filter(F.sequence(F.lit(0), last), lambda j: F.forall(F.slice(eq, j + 1, m), lambda e: e)),
            lambda j: j + off))

    # places in the document that hold a gram of the item, then the offsets that put it there
    places = F.filter(F.sequence(F.lit(0), F.size(dh) - 1), lambda p: F.array_contains(hit["ig"], F.get(dh, p)))
    offsets = F.flatten(F.transform(places, lambda p: F.filter(
        F.transform(hit["ig"], lambda g, i: F.when(g == F.get(dh, p), p - i)), lambda o: o.isNotNull())))
    return F.array_distinct(F.flatten(F.transform(F.array_distinct(offsets), starts_at)))


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document row: id, n_words, n_hit, item_ids (sorted strings), hit_words (word positions)."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    base = base.select("id", "t", F.xxhash64("id").alias("k1"), F.xxhash64("t").alias("k2"))
    loose = words(loose_lower(F.col("t")))
    items = Landed(_items(benchmark, item_col, item_text_col), "bench-items")
    short = [r[0] for r in items.df.filter(F.col("size") < WINDOW).select("size").distinct().collect()]

    # kind 0: winnowed fingerprints; kind g: plain grams of g words, for items shorter than a window
    hashes = word_hashes(F.col("lw"))
    in_full = F.slice(window_min(grams(hashes, GRAM), WINDOW - GRAM + 1), F.lit(1), F.col("size") - WINDOW + 1)
    wanted = [items.df.filter(F.col("size") >= WINDOW).select(
        F.lit(0).alias("kind"), "ikey", F.explode(F.array_distinct(in_full)).alias("fp"))]
    prints = [_of_kind(0, fingerprints(loose))]
    for g in sorted({min(s, GRAM) for s in short}):
        part = items.df.filter((F.col("size") < WINDOW) & (F.least(F.col("size"), F.lit(GRAM)) == g))
        wanted.append(part.select(F.lit(g).alias("kind"), "ikey", F.get(grams(hashes, g), F.lit(0)).alias("fp")))
        prints.append(_of_kind(g, F.array_distinct(grams(word_hashes(loose), g))))
    wanted = Landed(reduce(DataFrame.unionByName, wanted).distinct(), "bench-prints")
    hits = (base.select("k1", "k2", F.explode(prints[0] if len(prints) == 1 else F.concat(*prints)).alias("f"))
            .select("k1", "k2", "f.kind", "f.fp")
            .join(broadcast_if_small(wanted.df, 48), ["kind", "fp"]).select("k1", "k2", "ikey").distinct())
    hits = Landed(hits, "bench-hits")
    wanted.drop()

    size = F.least(F.col("size"), F.lit(GRAM))
    item_grams = reduce(lambda acc, g: F.when(size == g, F.slice(grams(hashes, g), F.lit(1), F.col("size") - g + 1))
                        .otherwise(acc), range(1, GRAM + 1), F.lit(None).cast("array<bigint>"))
    known = items.df.select("ikey", "item_id", "iw", item_grams.alias("ig"), size.alias("g"))
    per_doc = (hits.df.join(known, "ikey").groupBy("k1", "k2")
               .agg(F.collect_list(F.struct("item_id", "iw", "ig", "g")).alias("hits")))
    # only texts with a hit go on to the word-by-word comparison
    hit_keys = broadcast_if_small(hits.df.select("k1", "k2"), 32)
    hit_docs = base.join(hit_keys, ["k1", "k2"], "left_semi").join(per_doc, ["k1", "k2"])

    # every array is bound once: named inside a lambda it would be computed anew for each element
    def occurrences(doc: Column) -> Column:
        found = F.transform("hits", lambda h: F.struct(
            h["item_id"].alias("item_id"), F.least(F.size(h["iw"]), F.lit(WINDOW)).alias("m"),
            _aligned(doc["dw"], F.get(doc["gs"], h["g"] - 1), h).alias("starts")))
        return F.filter(found, lambda f: F.size(f["starts"]) > 0)

    def digest(found: Column) -> Column:
        covered = F.flatten(F.transform(found, lambda f: F.flatten(
            F.transform(f["starts"], lambda s: F.sequence(s, s + f["m"] - 1)))))
        names = F.array_compact(F.transform(found, lambda f: f["item_id"]))
        return F.struct(F.array_sort(F.array_distinct(covered)).alias("hit_words"),
                        F.array_sort(F.array_distinct(names)).alias("item_ids"))

    gram_sets = let(word_hashes(loose), lambda wh: F.array(*[grams(wh, g) for g in range(1, GRAM + 1)]))
    doc = F.struct(words(ascii_lower("t")).alias("dw"), gram_sets.alias("gs"))
    marks = hit_docs.select("k1", "k2", let(let(doc, occurrences), digest).alias("m")).select("k1", "k2", "m.*")
    marks = marks.dropDuplicates(["k1", "k2"])
    count = F.size(F.array_remove(F.split("t", GAP_ANY_CASE), ""))
    out = base.select("id", "k1", "k2", count.cast("long").alias("n_words")).join(marks, ["k1", "k2"], "left")
    hit_words = F.coalesce("hit_words", F.array().cast("array<int>"))
    return out.select(F.col("id").alias(id_col), "n_words", F.size(hit_words).cast("long").alias("n_hit"),
                      F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"),
                      hit_words.alias("hit_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` without any word of a benchmark window, with all their columns."""
    marked = docs.select("*", F.xxhash64(id_col).alias("__k1"),
                         F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__k2"))
    slim = marked.select("__k1", "__k2", F.col(text_col).alias("t"))
    hit = contamination(slim.select(F.struct("__k1", "__k2").alias("k"), "t"), benchmark, "k", "t")
    hit = Landed(hit.filter("n_hit > 0").select("k.__k1", "k.__k2").distinct(), "contaminated")
    return marked.join(broadcast_if_small(hit.df, 32), ["__k1", "__k2"], "left_anti").select(*docs.columns)
