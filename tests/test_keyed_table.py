import os
import tempfile

import pytest
from pyspark.sql import functions as F

from wardline.sources.keyed import KeyedTable


def _files(path):
    return {os.path.join(d, f) for d, _, names in os.walk(os.path.join(path, "data")) for f in names if f.endswith(".parquet")}


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_changes_touch_their_buckets_only_and_versions_stay_readable(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wl-keyed-"), "patients")
    base = spark.createDataFrame([(f"p{i}", "active", i) for i in range(40)], "patient_id string, status string, n long")
    t = KeyedTable.create(base, path, "patient_id", 8)
    with pytest.raises(FileExistsError):
        KeyedTable.create(base, path, "patient_id", 8)
    before = _files(path)
    patch = spark.createDataFrame([("p3", "discharged", ["status"]), ("nobody", "x", ["status"])], "patient_id string, status string, set_fields array<string>")
    assert t.patch(patch.filter("patient_id = 'p3'"), ["status"]) == 1
    old, new = t.manifest(0)["parts"], t.manifest()["parts"]
    assert sum(old[b] != new[b] for b in old) == 1 and before <= _files(path)  # one bucket is new, no file was changed
    assert _rows(t.read(0)) == _rows(base)
    want = {r[0]: r for r in _rows(base)}
    want["p3"] = ("p3", "discharged", 3)
    assert _rows(t.read()) == sorted(want.values())
    t.patch(patch.filter("patient_id = 'nobody'"), ["status"])  # an unknown key changes no row
    assert _rows(t.read()) == sorted(want.values())

    t.delete(spark.createDataFrame([("p3",), ("p7",), ("nobody",)], "patient_id string"))
    t.insert(spark.createDataFrame([("p7", "new", 1, 1), ("p7", "newer", 2, 2), ("p8", "new", 3, 3)], "patient_id string, status string, n long, o int")
             .drop("o"), ["n"])
    want.pop("p3")
    want["p7"] = ("p7", "new", 1)
    assert _rows(t.read()) == sorted(want.values()) and t.versions() == [0, 1, 2, 3, 4]
    t.delete(t.read().select("patient_id"))
    assert t.read().count() == 0 and t.manifest()["parts"] == {}
    t.insert(base.limit(1), ["n"])
    assert t.read().count() == 1
    assert t.vacuum() > 0 and t.versions() == [6] and t.read().count() == 1


def test_of_two_writers_one_is_told(spark):
    path = os.path.join(tempfile.mkdtemp(prefix="wl-keyed-"), "alerts")
    alerts = spark.createDataFrame([(1, False, None, None), (2, False, None, None)],
                                   "id long, acknowledged boolean, acknowledged_by string, acknowledged_at long")
    t = KeyedTable.create(alerts, path, "id", 4)
    acks = spark.createDataFrame([(1, "ann", 10), (1, "bob", 5), (9, "eve", 1)], "id long, acknowledged_by string, acknowledged_at long")

    def meanwhile(rows):
        t.acknowledge(acks)  # another writer takes the version first
        return rows.withColumn("acknowledged", F.lit(True))

    with pytest.raises(RuntimeError, match="another change"):
        t.change(alerts, meanwhile)
    assert _rows(t.read().select("id", "acknowledged")) == [(1, True), (2, False)]
    assert t.read().filter("id = 1").first().acknowledged_by == "bob"
