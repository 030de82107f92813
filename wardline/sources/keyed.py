"""Keyed tables that change (L1-L4): bucketed Parquet with a manifest per version.

A table is a folder with ``data`` (one folder for each change, in it one for each bucket of the key
that the change wrote) and ``_versions`` (``<n>.json``: which folder holds each
bucket). A change reads and writes the buckets of its keys only; all
other buckets stay the files they are. A version appears by one rename of its
manifest, which fails if another writer has taken the number, so readers see whole
versions and of two writers at once one is told to try again. Older versions can be read
until ``vacuum``.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.operators import tables
from wardline.sources import files


class KeyedTable:
    """A table with one row per key, laid out by ``buckets`` buckets of the key's hash."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def create(cls, df: DataFrame, path: str, key: str, buckets: int = 64) -> KeyedTable:
        table = cls(df.sparkSession, path)
        if table.versions():
            raise FileExistsError(f"{path} holds a table")
        table._commit(0, df.schema, key, buckets, table._write(df, key, buckets))
        return table

    # --- versions -------------------------------------------------------------------------

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        p, fs = self._fs(os.path.join(self.path, "_versions"))
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known or (version is not None and version not in known):
            raise FileNotFoundError(f"{self.path} has no version {version if version is not None else ''}")
        path = os.path.join(self.path, "_versions", f"{known[-1] if version is None else version}.json")
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _commit(self, version: int, schema: T.StructType, key: str, buckets: int, parts: dict[str, str]) -> int:
        text = json.dumps({"version": version, "key": key, "buckets": buckets, "schema": schema.jsonValue(), "parts": parts})
        folder = os.path.join(self.path, "_versions")
        draft, fs = self._fs(os.path.join(folder, f".draft-{uuid.uuid4().hex}"))
        out = fs.create(draft, False)
        out.write(text.encode())
        out.close()
        target, _ = self._fs(os.path.join(folder, f"{version}.json"))
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        none = self.spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
        context = hadoop.FileContext.getFileContext(fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        try:
            context.rename(fs.makeQualified(draft), fs.makeQualified(target), none)
        except Exception as exc:  # noqa: BLE001 - py4j wraps the file system's error
            fs.delete(draft, False)
            raise RuntimeError(f"version {version} of {self.path} was written by another change; try again") from exc
        return version

    # --- rows -----------------------------------------------------------------------------

    def _write(self, df: DataFrame, key: str, buckets: int) -> dict[str, str]:
        """Write rows by bucket; the folder of each bucket that has rows."""
        name = uuid.uuid4().hex
        target = os.path.join(self.path, "data", name)
        df.withColumn("_bucket", bucket_of(key, buckets)).repartition("_bucket").write.partitionBy("_bucket").parquet(target)
        p, fs = self._fs(target)
        found = [s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()]
        return {f.split("=")[1]: name for f in found if f.startswith("_bucket=")}

    def _rows(self, manifest: dict, buckets: Sequence[int] | None = None) -> DataFrame:
        schema = T.StructType.fromJson(manifest["schema"])
        wanted = None if buckets is None else {str(b) for b in buckets}
        paths = [os.path.join(self.path, "data", name, f"_bucket={b}") for b, name in manifest["parts"].items() if wanted is None or b in wanted]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the newest or a given version."""
        return self._rows(self.manifest(version))

    def change(self, keys: DataFrame, to: Callable[[DataFrame], DataFrame]) -> int:
        """Replace the rows of the buckets that ``keys`` touch by ``to`` of them; returns the new version."""
        m = self.manifest()
        touched = [r[0] for r in keys.select(bucket_of(m["key"], m["buckets"]).alias("b")).distinct().collect()]  # at most ``buckets`` numbers
        old = self._rows(m, touched)
        written = self._write(to(old).select(*old.columns), m["key"], m["buckets"])
        parts = {b: name for b, name in m["parts"].items() if int(b) not in set(touched)} | written
        return self._commit(m["version"] + 1, old.schema, m["key"], m["buckets"], parts)

    def insert(self, rows: DataFrame, order: Sequence[str]) -> int:
        """L1: rows whose key is new (of several with one key the first by ``order``)."""
        key = self.manifest()["key"]
        return self.change(rows, lambda old: old.unionByName(tables.insert_if_absent(rows, old, key, order).inserted.select(*old.columns)))

    def patch(self, changes: DataFrame, fields: Sequence[str], set_fields: str = "set_fields", updated_at: Column | None = None,
              order: Sequence[str] = ()) -> int:
        """L2: see ``tables.apply_patch``."""
        key = self.manifest()["key"]
        return self.change(changes, lambda old: tables.apply_patch(old, changes, key, fields, set_fields, updated_at, order))

    def delete(self, keys: DataFrame) -> int:
        """L3."""
        key = self.manifest()["key"]
        return self.change(keys, lambda old: tables.delete_by_key(old, keys, key))

    def acknowledge(self, acks: DataFrame) -> int:
        """L4: see ``tables.acknowledge``; the table has the acknowledgement's columns."""
        key = self.manifest()["key"]
        return self.change(acks, lambda old: tables.acknowledge(old, acks, key))

    def vacuum(self, keep: int = 1) -> int:
        """Forget all versions but the newest ``keep`` and delete what no other one holds; returns the number of folders deleted."""
        known = self.versions()
        kept = known[-keep:]
        used = {(name, b) for v in kept for b, name in self.manifest(v)["parts"].items()}
        gone = 0
        for v in known[:-keep]:
            for b, name in self.manifest(v)["parts"].items():
                if (name, b) not in used:
                    files.delete_path(self.spark, os.path.join(self.path, "data", name, f"_bucket={b}"))
                    used.add((name, b))
                    gone += 1
            files.delete_path(self.spark, os.path.join(self.path, "_versions", f"{v}.json"))
        return gone


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
