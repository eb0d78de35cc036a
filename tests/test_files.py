"""File sources, corpus preparation and sinks, on small files."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.plans import corpus as plans
from driftline.plans.scoring import Parameters, corpus_metrics, single_series
from driftline.sources import corpus, series


def test_series_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("when,value\n2026-01-01 00:00:00,1.5\n2026-01-01 00:00:01,bad\n2026-01-01 00:00:02,NaN\n")
    found = series.read_series(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r.pos, r.value) for r in found] == [(0, 1.5), (1, None), (2, None)]
    with pytest.raises(Exception, match="(?i)cast|bad"):
        series.read_series(spark, str(tmp_path), coerce=False).collect()
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b.csv").write_text("when,x,y\n2026-01-01,1,2\n")
    with pytest.raises(ValueError, match="one further column"):
        series.read_series(spark, str(tmp_path / "two"))


def test_optional_labels(spark, tmp_path):
    assert series.read_labels(spark, None) is None
    assert series.read_labels(spark, str(tmp_path / "nothing")) is None
    (tmp_path / "l.csv").write_text("time,is_anomaly,anomaly_type,is_train\n2026-01-01,1,x,0\n")
    assert series.read_labels(spark, str(tmp_path / "l.csv")).first().is_anomaly == 1
    (tmp_path / "m.csv").write_text("time,other\n2026-01-01,1\n")
    plain = series.read_labels(spark, str(tmp_path / "m.csv"))
    assert plain.columns == ["series_id", "time", "other", "pos"]
    start = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", k, start + dt.timedelta(seconds=k), float(k * k % 17)) for k in range(80)], "series_id string, pos long, time timestamp_ntz, value double")
    results, metric = single_series(rows, plain, Parameters(order=(0, 1, 0), window_size=50, stride=12))
    assert metric is None and {r.actual_anomaly for r in results.collect()} == {0}


def test_periods_file_with_a_byte_order_mark(spark, tmp_path):
    (tmp_path / "p.csv").write_bytes(b"\xef\xbb\xbfdataset_idx,period,remarks\n1,23,\n2,166,ambiguous\n")
    assert [tuple(r) for r in series.read_periods(spark, str(tmp_path / "p.csv")).collect()] == [(1, 23, None), (2, 166, "ambiguous")]


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw" / "deep"
    folder.mkdir(parents=True)
    for k, (name, sep) in enumerate((("one", "\n"), ("two words+x", "  "), ("three", "\n"))):
        values = [(t * 7919 % 113) / 10 + (40 if 150 <= t < 170 and t % 2 else 0) for t in range(300)]
        (folder / f"00{k + 1}_UCR_Anomaly_{name}_100_150_169.txt").write_text(sep.join(map(str, values)) + "\n")
    (tmp_path / "types.csv").write_text("name;anomaly_type_2\n001_UCR_Anomaly_one_100_150_169.txt;old\n001_UCR_Anomaly_one_100_150_169.txt;local peak\n")
    return tmp_path


def test_prepare_and_score(spark, raw):
    catalog = plans.prepare_corpus(spark, str(raw / "raw"), str(raw / "types.csv"), str(raw / "out"))
    known = {r.series_id: (r.category, r.folder, r.dataset_name, r.train_end) for r in catalog.collect()}
    assert known["ucr_001_one"] == ("local peak", "local_peak", "one", 100)
    assert known["ucr_002_two_words_x"] == ("unknown", "unknown", "two words+x", 100)
    rows, labels = corpus.read_prepared(spark, str(raw / "out"))
    assert rows.groupBy("series_id").count().where("count = 300").count() == 3
    assert labels.where("is_anomaly = 1").groupBy("series_id").count().where("count = 20").count() == 3
    metrics = corpus_metrics(rows, labels, catalog.select("series_id", F.col("folder").alias("category"), F.col("series_id").alias("dataset_name")), Parameters(order=(0, 1, 0), window_size=50, stride=12))
    found = metrics.collect()
    assert [r.ucr_correct for r in found] == [1, 1, 1] and all(r.n_points == 300 for r in found)
    plans.write_metrics(metrics, str(raw / "metrics"))
    assert sorted(str(p.relative_to(raw / "metrics")) for p in (raw / "metrics").rglob("*.csv")) == ["local_peak/local_peak_evaluation.csv", "unknown/unknown_evaluation.csv"]
    assert spark.read.csv(str(raw / "metrics" / "*" / "*.csv"), header=True).count() == 3
    plans.write_summary(metrics, str(raw / "summary.csv"))
    assert (raw / "summary.csv").read_text().splitlines()[-1] == "overall,3,3,1.0"
    results, metric = single_series(rows.where("series_id = 'ucr_001_one'").select("series_id", "pos", "time", "value"), labels, Parameters(order=(0, 1, 0), window_size=50, stride=12))
    assert metric.where("series_id = 'ucr_001_one'").first().ucr_correct == 1
    plans.write_window_results(results.withColumns({"category": F.lit("c"), "dataset_name": F.col("series_id")}), str(raw / "windows"))
    assert spark.read.csv(str(raw / "windows"), header=True).count() == results.count()


def test_limit_and_missing_input(spark, raw):
    catalog = plans.prepare_corpus(spark, str(raw / "raw"), str(raw / "types.csv"), str(raw / "out"), limit=2)
    assert sorted(r.dataset_id for r in catalog.collect()) == [1, 2]
    (raw / "empty").mkdir()
    (raw / "empty" / "other.txt").write_text("1")
    with pytest.raises(FileNotFoundError):
        corpus.read_raw_files(spark, str(raw / "empty"))
    (raw / "bad.csv").write_text("name;kind\nx;y\n")
    with pytest.raises(ValueError, match="lacks anomaly_type_2"):
        corpus.read_category_map(spark, str(raw / "bad.csv"))


def test_labels_without_anomalies_are_an_error(spark):
    start = dt.datetime(2026, 1, 1)
    rows = spark.createDataFrame([("a", k, start + dt.timedelta(seconds=k), float(k * k % 17)) for k in range(80)], "series_id string, pos long, time timestamp_ntz, value double")
    labels = rows.select("series_id", "pos", "time", F.lit(0).alias("is_anomaly"), F.lit("normal").alias("anomaly_type"))
    catalog = spark.createDataFrame([("a", "c", "d")], "series_id string, category string, dataset_name string")
    with pytest.raises(Exception, match="no labelled row in the labels of a"):
        corpus_metrics(rows, labels, catalog, Parameters(order=(0, 1, 0), window_size=50, stride=12)).collect()
    with pytest.raises(Exception, match="no labelled row in the labels of a"):
        single_series(rows, labels, Parameters(order=(0, 1, 0), window_size=50, stride=12))[1].collect()


def test_prepared_corpus_as_csv(spark, raw):
    catalog = plans.prepare_corpus(spark, str(raw / "raw"), str(raw / "types.csv"), str(raw / "csv"), layout="csv")
    names = sorted(str(p.relative_to(raw / "csv")) for p in (raw / "csv").rglob("*.csv"))
    assert names[:2] == ["by_category/local_peak/ucr_001_one/labels.csv", "by_category/local_peak/ucr_001_one/timeseries.csv"] and len(names) == 6
    text = (raw / "csv" / names[1]).read_text().splitlines()
    assert text[0] == "time,value" and len(text) == 301
    plans.prepare_corpus(spark, str(raw / "raw"), str(raw / "types.csv"), str(raw / "parquet"))
    one, two = corpus.read_prepared(spark, str(raw / "csv")), corpus.read_prepared(spark, str(raw / "parquet"))
    for a, b, value in zip(one, two, ("value", "is_anomaly"), strict=True):
        assert sorted((r.dataset_name, r.pos, r.time, r[value]) for r in a.collect()) == sorted((r.dataset_name, r.pos, r.time, r[value]) for r in b.collect())
    (raw / "csv" / "by_category" / "unknown" / "ucr_003_three" / "labels.csv").unlink()
    assert corpus.read_prepared(spark, str(raw / "csv"))[0].select("dataset_name").distinct().count() == 2 and catalog.count() == 3
    (raw / "none" / "by_category").mkdir(parents=True)
    with pytest.raises(FileNotFoundError, match="no prepared dataset"):
        corpus.read_prepared(spark, str(raw / "none"))


def test_output_paths():
    assert plans.output_paths("r")["overall"] == "results/r/overall_evaluation.csv"
    assert plans.output_paths("r", "o", "x.CSV")["overall"] == "x.CSV"
    assert plans.output_paths("r", "o", "x")["overall"] == "x/r/overall_evaluation.csv"


@pytest.mark.parametrize("size", ["100", "1000", "1000000"])
def test_raw_files_in_ranges(spark, tmp_path, size):
    numbers = [f"{k * 7919 % 100003 / 7:.5e}" if k % 3 else str(k) for k in range(2000)]
    marks = {"lines": "\n", "spaces": "  ", "one space": " ", "tabs": "\t", "both": " \n"}
    for k, (name, mark) in enumerate(marks.items()):
        (tmp_path / f"00{k}_UCR_Anomaly_{name}_1_2_3.txt").write_text((" " if k % 2 else "") + mark.join(numbers) + ("\n" if k < 3 else ""))
    (tmp_path / "009_UCR_Anomaly_empty_1_2_3.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        found = corpus.read_raw_values(spark, str(tmp_path))
        assert size != "1000" or found.count() and spark.read.option("lineSep", " ").text(str(tmp_path)).rdd.getNumPartitions() > 50
        rows = found.collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len(rows) == 2000 * len(marks)
    for name in marks:
        own = sorted((r.pos, r.value) for r in rows if f"_{name}_" in r.file_name)
        assert own == [(k, float(v)) for k, v in enumerate(numbers)]
