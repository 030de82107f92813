import datetime as dt

from pyspark.sql import functions as F

from wardline.functions import clinical
from wardline.operators import series


def test_display_helpers(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("2024-01-02T03:04:05.123456",), ("not a time",), (None,)], "t string")
    got = [r[0] for r in df.select(clinical.display_time(F.col("t"))).collect()]
    assert got == ["2024-01-02 03:04 UTC", "2024-01-02 03:04 UTC", "not a time", "--"]
    values = [82.25, 82.35, 36.45, 0.15, 98.65, 7.0, 0.25, 0.35, -0.05, -12.34, 0.0, 99.95, 1e18, 123456789.25]
    values += [k / 100 for k in range(3500, 4300)]
    nums = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    got = [r[0] for r in nums.select(clinical.one_decimal(F.col("x"))).collect()]
    assert got == [f"{v:.1f}" for v in values] + ["--"]


def test_topics_window_start_and_channels(spark):
    df = spark.createDataFrame([("p7", dt.datetime(2024, 1, 1, 10))], "pid string, end timestamp")
    r = df.select(clinical.vitals_topic(F.col("pid")).alias("t"), clinical.alert_topic(F.col("pid")).alias("a"),
                  clinical.window_start(F.col("end"), 8).alias("s")).first()
    assert r.t == "icu/p7/vitals" and r.a == "icu/p7/alert" and r.s == dt.datetime(2024, 1, 1, 3)
    assert df.select(clinical.topic_patient(F.lit("icu/p7/vitals"))).first()[0] == "p7"
    st = spark.createDataFrame([({"telegram": "skipped", "email": "sent", "mqtt": "sent"},)], "m map<string,string>")
    assert sorted(st.select(clinical.dispatched_channels(F.col("m"))).first()[0]) == ["email", "mqtt"]


def test_public_id_and_channel_map(spark):
    df = spark.createDataFrame([(5, 80.0, None)], "_id long, HR double, Temp double")
    out = series.with_public_id(df)
    assert out.columns[0] == "id" and out.first().id == "5"
    assert df.select(series.channels_map(["HR", "Temp"])).first()[0] == {"HR": 80.0}
    tall = series.wide_to_tall(df, ["_id"], ["HR", "Temp"]).collect()
    assert [(r.channel, r.value) for r in tall] == [("HR", 80.0)]
