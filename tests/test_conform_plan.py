import datetime as dt

from wardline.plans.conform import run_conform

T = dt.datetime(2150, 1, 1)


def test_item_mapping_by_volume_with_precedence_and_fahrenheit(spark):
    d_items = spark.createDataFrame([(220045, "Heart Rate", "chartevents"), (220046, "heart rate", "chartevents"),
                                     (223761, "Temperature Fahrenheit", "chartevents"), (220277, "O2 saturation pulseoxymetry", "chartevents"),
                                     (999, "Heart Rate", "datetimeevents")], "itemid long, label string, linksto string")
    d_lab = spark.createDataFrame([(50931, "Glucose", "Blood"), (50809, "Glucose", "Blood"), (50813, "Lactate", "Blood"),
                                   (50813, "Lactate", "Blood"), (51000, "Troponin I", "Urine"), (52000, "Heart Rate", "Blood")],
                                  "itemid long, label string, fluid string")
    chart = spark.createDataFrame([(1, T, 220045, 80.0), (1, T, 220045, 85.0), (2, T, 220046, 70.0), (1, T, 223761, 98.6),
                                   (2, T, 220277, None), (1, T, 999, 1.0)], "subject_id long, charttime timestamp, itemid long, valuenum double")
    lab = spark.createDataFrame([(1, T, 50931, 110.0), (1, T, 50931, 120.0), (2, T, 50809, 90.0), (1, T, 50813, 2.0), (1, T, 52000, 5.0)],
                                "subject_id long, charttime timestamp, itemid long, valuenum double")
    out = run_conform(spark, d_items, d_lab, chart, lab)
    m = {r.channel: r for r in out["mapping"].collect()}
    assert m["HR"].itemid == 220045 and m["HR"].source == "chartevents"  # volume wins; chart beats lab
    assert m["Glucose"].itemid == 50931 and m["Lactate"].itemid == 50813
    assert m["Temp"].is_fahrenheit and "TroponinI" not in m  # urine item filtered out; no volume → unresolved
    assert "O2Sat" in m and not [x for x in out["readings"].collect() if x.channel == "O2Sat"]  # counted, but null values dropped
    r = {(x.patient_id, x.channel): x.value for x in out["readings"].collect() if x.channel in ("Temp",)}
    assert abs(r[("1", "Temp")] - 37.0) < 1e-9
    hr = sorted(x.value for x in out["readings"].collect() if x.channel == "HR" and x.patient_id == "1")
    assert hr == [80.0, 85.0]
    un = {x.channel for x in out["unresolved"].collect()}
    assert "TroponinI" in un and "HR" not in un
