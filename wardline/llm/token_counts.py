"""Token counts by map-side two-tier lookup.

No piece of the vocabulary has a space inside (only in front), nor a newline,
so the tokens of a text are the tokens of its segments: a run of spaces with
the characters that follow it, or a newline with the characters that follow.

Tier 1 is a table of frequent segments and their token counts. The frequent
ones are found by ``approx_top_k`` sketches over all documents (one sketch per
hash bucket of words, merged bucket by bucket; no pre-token is shuffled). It
has at most BUCKETS x TOP entries of at most MAX_KEY characters (about 2 MB)
and is broadcast. Tier 2 is a cache in each Python worker: a segment that
tier 1 lacks is encoded once by the library and remembered; the cache starts
anew when it holds CACHE_ENTRIES. Either tier only saves work: counts are the
library's in any case.

Defined results: null and empty texts have no tokens; repeated rows give a row
each; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEGMENT = re.compile(r" +[^ \n]*|\n[^ \n]*")
# Fewer buckets than the number of groups at which hash aggregation of sketches turns to sorting its input.
BUCKETS = 64
TOP = 256
TRACKED = 2048
MAX_KEY = 24
CACHE_ENTRIES = 300_000


class SegmentCounts(dict):
    """Token count by segment; a missing segment is encoded and remembered."""

    def __init__(self, model: bytes, frequent: dict[str, int]):
        import sentencepiece
        super().__init__(frequent)
        self.frequent = frequent
        self.processor = sentencepiece.SentencePieceProcessor(model_proto=model)

    def encode_length(self, segment: str) -> int:
        if segment == " ":
            return 1
        # the library puts one space in front: it stands for the segment's own, or is taken off again
        if segment[0] == " ":
            return len(self.processor.encode(segment[1:], num_threads=1))
        return len(self.processor.encode(segment, num_threads=1)) - 1

    def __missing__(self, segment: str) -> int:
        n = self.encode_length(segment)
        if len(self) >= len(self.frequent) + CACHE_ENTRIES:
            self.clear()
            self.update(self.frequent)
        if len(segment) <= 256:
            self[segment] = n
        return n

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(map(self.__getitem__, SEGMENT.findall(" " + text.replace("▁", " "))))


_WORKER: dict[str, SegmentCounts] = {}


def _counts(model: bytes, frequent: dict[str, int]) -> SegmentCounts:
    """The worker's cache for this model, kept from task to task."""
    key = hashlib.md5(model).hexdigest()
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = SegmentCounts(model, frequent)
    return _WORKER[key]


def check_vocabulary(model: bytes) -> None:
    """The segment rule holds only when no piece crosses a segment's edge."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    crossing = re.compile("[^▁]▁|\n")
    if any(crossing.search(sp.id_to_piece(i)) for i in range(sp.vocab_size())):
        raise ValueError("a piece of the vocabulary crosses a space or a newline")


def frequent_words(docs: DataFrame, text_col: str = "text") -> list[str]:
    """At most BUCKETS x TOP frequent words of all documents."""
    word = docs.select(F.explode(F.split(F.col(text_col), "[ \n]+")).alias("w"))
    word = word.filter(F.length("w").between(1, MAX_KEY))
    tops = (word.groupBy(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).alias("b"))
            .agg(F.expr(f"approx_top_k(w, {TOP}, {TRACKED})").alias("top")))
    return [r[0] for r in tops.select(F.explode("top.item")).collect()]


def token_counts(docs: DataFrame, model: bytes, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens that the library gives each whole text."""
    check_vocabulary(model)
    spark = docs.sparkSession
    seed = SegmentCounts(model, {})
    frequent = {" " + w: seed.encode_length(" " + w) for w in frequent_words(docs, text_col)}
    shared = spark.sparkContext.broadcast((model, frequent))

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counts = _counts(*shared.value)
        for texts in batches:
            yield pa.array([counts.count(t.as_py()) for t in texts], pa.int64())

    count.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return docs.withColumn(out, F.arrow_udf(count, "long")(F.col(text_col)))
