"""Files read by their own headers, and what can't be read."""

from __future__ import annotations

import pytest

from driftline.sources import headers, series


def write(folder, **files):
    folder.mkdir(exist_ok=True)
    for name, text in files.items():
        (folder / f"{name}.csv").write_text(text, encoding="utf-8")
    return str(folder)


def name_of(path):
    return path.rpartition("/")[2].removesuffix(".csv")


def test_headers_of_each_file(spark, tmp_path):
    path = write(tmp_path / "x", a="﻿time,value\n1,2\n", b='\n"when", "a,b" ,\n1,2,3\n', c="", d="time,value\n" + "1,2\n" * 50_000)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        found = {name_of(r.file_path): list(r.names) for r in headers.file_headers(spark, path).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found["a"] == found["d"] == ["time", "value"] and set(found) == {"a", "b", "d"} and found["b"][0] == "when" and len(found["b"]) == 3


def test_labels_with_columns_in_any_order(spark, tmp_path):
    path = write(tmp_path / "l", a="time,is_anomaly,is_train\n2026-01-01,1,0\n", b="time,is_train,is_anomaly\n2026-01-01,1,0\n", c="t,anomaly_type,is_anomaly\n2026-01-01,burst,1.0\n")
    found = series.read_labels(spark, path)
    assert set(found.columns) == {"series_id", "pos", "time", "is_anomaly", "is_train", "anomaly_type"}
    rows = {name_of(r.series_id): (r.is_anomaly, r.is_train, r.anomaly_type) for r in found.collect()}
    assert rows == {"a": (1, 0, None), "b": (0, 1, None), "c": (1, None, "burst")}


def test_a_second_value_column_in_one_of_many_files(spark, tmp_path):
    path = write(tmp_path / "s", a="time,value\n" + "".join(f"2026-01-01 00:00:{k:02d},{k}\n" for k in range(60)), b="time,other,value\n2026-01-01,7,1\n", c="when,x\n2026-01-01,5\n")
    with pytest.raises(ValueError, match=r"b\.csv: a series file has a time and one further column, not time, other, value"):
        series.read_series(spark, path)
    found = series.read_series(spark, path, on_error="skip")
    assert {(name_of(r.series_id), r["sum(value)"]) for r in found.groupBy("series_id").sum("value").collect()} == {("a", 1770.0), ("c", 5.0)}
    assert {name_of(r.series_id): r.reason for r in series.series_file_status(spark, path).collect()} == {"a": None, "b": "value_columns", "c": None}


def test_errors_name_the_file(spark, tmp_path):
    path = write(tmp_path / "s", a="time,value\n2026-01-01,1\n", b="time,value\nyesterday,1\n", c="time,value\n2026-01-01,x\n", d="time,value\n,1\n")
    with pytest.raises(Exception, match=r"[bd]\.csv: not a time: (yesterday|no time)"):
        series.read_series(spark, path).collect()
    assert {name_of(r.series_id): r.reason for r in series.series_file_status(spark, path, coerce=False).collect()} == {"a": None, "b": "time", "c": "number", "d": "time"}
    assert {name_of(r.series_id) for r in series.read_series(spark, path, on_error="skip").collect()} == {"a", "c"}
    assert {name_of(r.series_id) for r in series.read_series(spark, path, coerce=False, on_error="skip").collect()} == {"a"}
    labels = write(tmp_path / "l", a="time,is_anomaly\n2026-01-01,1\n", b="time,is_anomaly\n2026-01-01,yes\n", c="time,kind\n2026-01-01,q\n", d="time,is_anomaly\n2026-01-01,\n")
    with pytest.raises(Exception, match=r"b\.csv: not a number \(is_anomaly\): yes"):
        series.read_labels(spark, labels).collect()
    assert {name_of(r.series_id): r.reason for r in series.label_file_status(spark, labels).collect()} == {"a": None, "b": "number", "c": "no_is_anomaly", "d": None}
    assert {name_of(r.series_id): r.is_anomaly for r in series.read_labels(spark, labels, on_error="skip").collect()} == {"a": 1, "d": None}
    with pytest.raises(ValueError, match="on_error"):
        series.read_series(spark, path, on_error="ignore")
