"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import scratch_path, track_scratch

# Numpy temporaries are about 60 times the bytes worked on at once, so a task
# works through its Arrow batches in pieces of this many bytes.
PIECE_BYTES = 1 << 20

# A side of a join is broadcast only when its counted rows times its row width
# stay below this many bytes; beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

FILE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ascii_lower(c: Column | str) -> Column:
    """Lower-case A-Z only. Pure ASCII text takes the fast path of ``lower``."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.when(F.octet_length(c) == F.char_length(c), F.lower(c))
            .otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@contextmanager
def _shuffle_cleanup(spark: SparkSession):
    old = spark.conf.get(FILE_CLEANUP, "false")
    spark.conf.set(FILE_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(FILE_CLEANUP, old)


class Landed:
    """A written intermediate table in the shared folder; ``drop()`` deletes its files (else the driver's exit does)."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        self.path = scratch_path(self.spark, name)
        schema = df.schema
        with _shuffle_cleanup(self.spark):
            df.write.mode("overwrite").parquet(self.path)
        track_scratch(self.path)
        self.df = self.spark.read.schema(schema).parquet(self.path)

    def drop(self) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint for a landed (cheap to count) table when its size is below the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def string_buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (int64, n + 1) of an Arrow string array; null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    if len(arr) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = arr.buffers()
    offsets = np.frombuffer(off, np.int64)[arr.offset:arr.offset + len(arr) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``limit`` bytes; a longer row stands alone."""
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), n)
        yield lo, hi
        lo = hi


def blocks_of(limit: int, texts: pa.Array, *others: pa.Array) -> Iterator[tuple[pa.Array, ...]]:
    """Slices of an Arrow batch with at most ``limit`` bytes of text each, so that what is made of them stays small."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for lo, hi in row_blocks(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), limit):
        yield tuple(a.slice(lo, hi - lo) for a in (texts, *others))


def crc32_mod3(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3 (null id: 0, that of no text at all)."""
    return F.coalesce(F.crc32(doc_id.cast("string")), F.lit(0)) % 3
