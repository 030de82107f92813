"""File sources (A1-A4, A6, A8) and sinks.

Per-patient pipe-separated files are read as whole texts (one row per file,
small files packed into partitions by the file scan) and bound to columns by
each file's own header, never by position: a plain multi-path CSV read binds
every file by the first file's header (Q3).
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline import vocab
from wardline.session import write_scratch


def _cell(m: Column, name: str, dtype: str) -> Column:
    """Text cell → typed value; empty text and 'NaN' become NULL."""
    raw = F.trim(m[name])
    return F.when(raw.isNull() | (raw == "") | (F.lower(raw) == "nan"), F.lit(None).cast(dtype)).otherwise(raw.try_cast(dtype))


def read_patient_files(spark: SparkSession, root: str, set_names: Sequence[str], limit: int | None = None,
                       columns: Sequence[str] = vocab.ALL_COLUMNS, key: str = vocab.PATIENT_ID_COLUMN,
                       time: str = vocab.TIME_COLUMN, label: str = vocab.LABEL_COLUMN, suffix: str = ".psv",
                       key_pattern: str | None = None) -> DataFrame:
    """A1-A3 + I1: every ``root/<set>/*.psv`` file, bound by header name, sorted by patient and time.

    The patient id is the file's stem, or what ``key_pattern`` finds in its path. A missing set folder or an
    empty input is an error; so is an expected column absent from every file. ``limit`` keeps the first N files
    in the order of their full paths (A2); no other file is opened. NaN text becomes NULL (C1).
    """
    with _small_files(spark):
        return _read_patient_files(spark, [os.path.join(root, s) for s in set_names], limit, columns, key, time, label, suffix, key_pattern)


@contextmanager
def _small_files(spark: SparkSession):
    """Scans inside take some thousand small files a task, not some dozens, and a task lists many folders, not one."""
    new = {"spark.sql.files.openCostInBytes": "65536",
           "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def _read_patient_files(spark, paths, limit, columns, key, time, label, suffix, key_pattern) -> DataFrame:
    if limit is not None:  # a listing, without contents
        listed = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", True).load(paths)
        paths = [r[0] for r in listed.select("path").orderBy("path").limit(limit).collect()] or paths
    raw = spark.read.text(paths, wholetext=True, pathGlobFilter=f"*{suffix}", recursiveFileLookup=True) \
        .select(F.col("value"), F.col("_metadata.file_path").alias("_path"))
    stem = F.regexp_extract(F.col("_path"), key_pattern or r"([^/]+)" + suffix.replace(".", r"\.") + "$", 1)
    lines = F.filter(F.split(F.regexp_replace(F.col("value"), "\r", ""), "\n"), lambda s: F.trim(s) != "")
    files = raw.select(stem.alias(key), F.split(lines[0], r"\|").alias("_header"), F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))).alias("_rows"))
    files = write_scratch(files, "patient-rows")  # each file is opened once, not by every job
    present = files.agg(F.array_distinct(F.flatten(F.collect_set("_header"))).alias("h")).collect()
    if not present or present[0]["h"] is None:
        raise FileNotFoundError(f"no {suffix} files under {paths}")
    header = set(present[0]["h"])
    missing = [c for c in columns if c != key and c not in header]
    if missing:
        raise ValueError(f"missing expected columns: {missing}")
    rows = files.select(key, "_header", F.explode("_rows").alias("_line"))
    m = F.map_from_arrays(F.col("_header"), F.split(F.col("_line"), r"\|"))
    out = rows.select(key, m.alias("_m"))
    cols = []
    for c in columns:
        if c == key:
            cols.append(F.col(key))
        elif c in (time, label):
            cols.append(_cell(F.col("_m"), c, "double").cast("int").alias(c))
        else:
            cols.append(_cell(F.col("_m"), c, "double").alias(c))
    out = out.select(*cols)
    return out.orderBy(*[c for c in (key, time) if c in out.columns])


def write_patient_files(df: DataFrame, root: str, columns: Sequence[str], set_col: str = "set", key: str = vocab.PATIENT_ID_COLUMN,
                        time: str = vocab.TIME_COLUMN) -> None:
    """One pipe-separated file with a header for each patient, below ``root/<set_col>=<set>/<key>=<patient>``; NULL as NaN.

    A file holds one patient's stay, which bounds the text made for it. In a folder that is mounted (``file:``) the
    tasks write the files themselves: Hadoop's local file system starts a process for every file and folder it makes.
    """
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("NaN")) for c in columns])
    rows = F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), line.alias("line")))).alias("rows")
    text = F.concat_ws("\n", F.lit("|".join(columns)), F.transform("rows", lambda r: r["line"])).alias("value")
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = fs.makeQualified(path).toUri()
    if uri.getScheme() != "file":
        stays = df.groupBy(set_col, key).agg(rows)
        # tasks put their files in place themselves: version 1 has the driver move one after the other
        (stays.select(set_col, key, text).write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
         .partitionBy(set_col, key).text(root))
        return
    fs.delete(path, True)
    fs.mkdirs(path)
    # null and empty keys share a folder, and so a file
    folders = [F.nullif(F.col(c).cast("string"), F.lit("")).alias(f"_folder{k}") for k, c in enumerate((set_col, key))]
    stays = df.groupBy(*folders).agg(rows).select("_folder0", "_folder1", text)
    stays.mapInArrow(_stay_writer(uri.getPath(), set_col, key), "n long").agg(F.sum("n")).collect()
    fs.create(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")).close()


def _folder(column: str, value: str | None) -> str:
    """Name of a partition folder as Spark writes it."""
    if value is None:
        return f"{column}=__HIVE_DEFAULT_PARTITION__"
    return f"{column}=" + re.sub(r"[\x01-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", value)


def _stay_writer(root: str, set_col: str, key: str):
    """Writes a file a row (set, key, text). Each is put in place whole under one name, so a task that runs again changes nothing."""
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, patient, text in zip(*batch.columns, strict=True):
                folder = os.path.join(root, _folder(set_col, part.as_py()), _folder(key, patient.as_py()))
                os.makedirs(folder, exist_ok=True)
                hidden = os.path.join(folder, f".{uuid.uuid4().hex}")
                with open(hidden, "wb") as f:
                    f.write(text.as_buffer())
                    f.write(b"\n")
                os.replace(hidden, os.path.join(folder, "part-00000.txt"))
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    return write


def read_csv_table(spark: SparkSession, path: str, schema: T.StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """A4: CSV with an explicit schema; the projection is pruned by Catalyst."""
    df = spark.read.option("header", True).schema(schema).csv(path)
    return df.select(*columns) if columns else df


def read_windows(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Window dataset; a split filter prunes to one partition folder."""
    df = spark.read.parquet(path)
    return df.filter(F.col("split") == split) if split else df


def load_threshold(spark: SparkSession, path: str, fallback: float = vocab.FALLBACK_THRESHOLD) -> float:
    """Best-F1 threshold from a metrics sidecar, else the fallback constant."""
    if not path_exists(spark, path):
        return fallback
    # a sidecar that is no JSON, or has another shape, gives a null field
    schema = "metrics_at_best_f1_threshold struct<threshold: double>"
    row = spark.read.option("multiLine", True).schema(schema).json(path).select("metrics_at_best_f1_threshold.threshold").first()
    return float(row[0]) if row is not None and row[0] is not None else fallback


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there, on any file system that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p))


def is_folder(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isDirectory())


def delete_path(spark: SparkSession, path: str) -> None:
    """Delete a folder or file, if it is there."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def topic_source(spark: SparkSession, path: str, schema: str = "topic string, value string, arrival_ts timestamp",
                 fmt: str = "json", max_files: int = 100) -> DataFrame:
    """A (topic, value, arrival time) stream from files; Kafka gives the same columns in production."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
            .filter(F.col("topic").rlike(vocab.VITALS_TOPIC_FILTER_REGEX)))


# --- sinks ----------------------------------------------------------------------------

def write_sorted(df: DataFrame, path: str, keys: Sequence[str], partitions: int | None = None, mode: str = "overwrite",
                 partition_by: Sequence[str] = ()) -> None:
    """H1: range-partition and sort within files on the canonical key (no global single-task sort)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def append_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """Append-only event table; a replayed batch overwrites its own folder (idempotent)."""
    df.write.mode("overwrite").parquet(os.path.join(path, f"batch_id={batch_id}"))


def write_csv(df: DataFrame, path: str) -> None:
    """Statistics as CSV with a header (small results: one file)."""
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """One-row summaries as JSON."""
    df.coalesce(1).write.mode("overwrite").json(path)
