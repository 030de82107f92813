"""Once-only landing of a stream with bounded state.

Two memories tell whether a row was delivered before:

1. Recent keys stand in the state store, by arrival: a key is forgotten once the clock of
   arrivals is ``horizon`` past it. No row is too late for this clock, however old its own time is.
2. What was forgotten stands in the landed table itself. A micro-batch that the
   state lets through is anti-joined, by key alone, with the earlier rows of its own buckets: the table
   is laid out by micro-batch and by bucket of the key, so other buckets are not read.

Each micro-batch writes its own folder, and only folders of earlier ones count, so a replayed
micro-batch lands the same rows again in place of its own.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.session import scratch_path
from wardline.sources import files
from wardline.streaming.state import state_conf

BUCKETS = 16


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def new_rows(batch: DataFrame, path: str, batch_id: int, keys: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """Rows of ``batch`` (with its ``_bucket``) whose key no earlier micro-batch has landed."""
    spark = batch.sparkSession
    if not files.path_exists(spark, path):
        return batch
    touched = [r[0] for r in batch.select("_bucket").distinct().collect()]  # at most ``buckets`` numbers
    # the schema is given: after micro-batches without rows (an empty file) the table has folders but no files
    columns = [f"`{k}` {batch.schema[k].dataType.simpleString()}" for k in keys]
    landed = (spark.read.schema(", ".join([*columns, "_batch long", "_bucket int"])).parquet(path)
              .filter((F.col("_batch") < batch_id) & F.col("_bucket").isin(touched)))
    known = landed.select(F.col("_bucket").alias("_b"), *[F.col(k).alias(f"_k_{k}") for k in keys])
    same = F.col("_bucket") == F.col("_b")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return batch.join(known, same, "left_anti")


def land_once(stream: DataFrame, keys: Sequence[str], path: str, ckpt: str, arrival: str | None = None, horizon: str = "1 hour",
              buckets: int = BUCKETS) -> DataFrame:
    """Land what is available of ``stream``, each key once; returns the landed table.

    ``arrival`` names the column with the time a row arrived, which must not go back by more than ``horizon``
    from one micro-batch to the next; by default it is the time of the micro-batch.
    """
    clocked = stream.withColumn("_arrival", F.col(arrival).cast("timestamp") if arrival else F.current_timestamp())
    fresh = (clocked.withWatermark("_arrival", horizon).dropDuplicatesWithinWatermark(list(keys))
             .drop("_arrival").withColumn("_bucket", _bucket(keys, buckets)))

    def sink(batch: DataFrame, batch_id: int) -> None:
        staged = scratch_path(batch.sparkSession, "once")
        batch.write.mode("overwrite").parquet(staged)
        rows = batch.sparkSession.read.schema(batch.schema).parquet(staged)
        (new_rows(rows, path, batch_id, keys, buckets).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket")
         .parquet(os.path.join(path, f"_batch={batch_id}")))
        files.delete_path(batch.sparkSession, staged)

    with state_conf(stream.sparkSession):
        q = fresh.writeStream.foreachBatch(sink).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
        q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    spark = stream.sparkSession
    if not files.path_exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return spark.read.schema(f"{columns}, _batch long, _bucket int").parquet(path).drop("_batch", "_bucket")
