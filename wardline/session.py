"""Session construction and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC clock, adaptive execution (partition
# coalescing and skew-join splitting), Arrow for the few pandas paths.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, app: str = "wardline",
                shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = dict(BASE_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must be present (a shared filesystem path).
    Only a local-mode session without the setting (tests, laptop runs) gets
    a private folder under the system temp directory.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        configured = tempfile.mkdtemp(prefix="wardline-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark)
    return os.path.join(base, "tables", f"{name}-{os.getpid()}-{next(_counter)}")


def _counter_gen():
    i = 0
    while True:
        i += 1
        yield i


_counter = _counter_gen()


_written: list[str] = []


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage with a Parquet table in the shared folder (survives executor loss, reads prune columns).

    ``drop_scratch`` deletes the tables written so far; it also runs when the driver exits.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    track_scratch(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def track_scratch(path: str) -> None:
    """Have ``drop_scratch`` delete this folder too."""
    if not _written:
        atexit.register(drop_scratch)
    _written.append(path)


def drop_scratch() -> None:
    """Delete every table of ``write_scratch`` whose session still lives."""
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _written:
        path = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(conf).delete(path, True)


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a written table, without a name of its own."""
    return write_scratch(df, "step")
