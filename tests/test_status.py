"""What is wrong with the series of a corpus, as rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.plans import corpus as plans
from driftline.plans.scoring import Parameters, corpus_metrics, corpus_status, scored_corpus
from driftline.sources.corpus import prepared_status, read_prepared

SHORT = {"window_size": 50, "stride": 12}


@pytest.fixture
def corpus(spark):
    start = dt.datetime(2026, 1, 1)
    sizes = {"good": 80, "short": 40, "unlabelled": 80, "flat": 80, "columnless": 80}
    rows = [(s, k, start + dt.timedelta(seconds=k), float(k * k % 17)) for s, n in sizes.items() for k in range(n)]
    series = spark.createDataFrame(rows, "series_id string, pos long, time timestamp_ntz, value double")
    flag = F.when(F.col("series_id") == "flat", F.lit(0)).when(F.col("series_id") != "columnless", (F.col("pos") == 30).cast("int"))
    labels = series.where("series_id != 'unlabelled'").select("series_id", "pos", "time", flag.alias("is_anomaly"))
    catalog = spark.createDataFrame([(s, "c", f"d_{s}") for s in [*sizes, "absent"]], "series_id string, category string, dataset_name string")
    return series, labels, catalog


REASONS = {"good": None, "short": "short", "unlabelled": "no_labels", "flat": "no_labelled_row", "columnless": "no_is_anomaly", "absent": "no_series"}


@pytest.mark.parametrize("how", [{"mode": "raw"}, {"method": "autocorr"}, {"branches": ("both",)}])
def test_each_fault_has_its_reason(corpus, how):
    found = corpus_status(*corpus, Parameters(order=(0, 1, 0), on_error="skip", **SHORT, **how))
    assert {r.series_id: r.reason for r in found.collect()} == REASONS


def test_the_others_are_scored(spark, corpus, tmp_path):
    how = Parameters(order=(0, 1, 0), mode="raw", on_error="skip", **SHORT)
    metrics, status = scored_corpus(*corpus, how)
    assert [r.dataset_name for r in metrics.collect()] == ["d_good"] and len(metrics.columns) == 22
    assert {(r.dataset_name, r.status, r.reason) for r in status.collect()} == {(f"d_{s}", "skipped" if why else "scored", why) for s, why in REASONS.items()}
    assert corpus_metrics(*corpus, how).count() == 1
    with pytest.raises(Exception, match="no labelled row|shorter than its window"):
        corpus_metrics(*corpus, Parameters(order=(0, 1, 0), mode="raw", **SHORT)).collect()
    told = spark.createDataFrame([("good", "time"), ("short", None)], "series_id string, reason string")
    assert {r.series_id: r.reason for r in corpus_status(*corpus, how, told).collect()} == REASONS | {"good": "time"}
    plans.write_status(status, str(tmp_path / "status.csv"))
    assert (tmp_path / "status.csv").read_text().splitlines()[0] == "category,dataset_name,status,reason"
    with pytest.raises(ValueError, match="on_error"):
        corpus_metrics(*corpus, Parameters(on_error="never"))


def test_labels_without_the_column(corpus):
    series, labels, catalog = corpus
    metrics, status = scored_corpus(series, labels.drop("is_anomaly"), catalog, Parameters(order=(0, 1, 0), mode="raw", on_error="skip", **SHORT))
    assert metrics.collect() == [] and {r.reason for r in status.collect()} == {"no_is_anomaly", "no_labels", "no_series"}


def test_status_of_a_parquet_corpus(spark, tmp_path):
    rows = spark.createDataFrame([("s", "c", "d"), ("t", "c", "e")], "series_id string, category string, dataset_name string")
    rows.write.parquet(str(tmp_path / "timeseries"))
    rows.where("series_id = 's'").write.parquet(str(tmp_path / "labels"))
    assert {(r.dataset_name, r.reason) for r in prepared_status(spark, str(tmp_path)).collect()} == {("d", None), ("e", "no_labels")}
    assert read_prepared(spark, str(tmp_path), on_error="skip")[0].count() == 1


def test_each_file_of_a_prepared_corpus_is_parsed_once(spark, tmp_path):
    base = tmp_path / "by_category" / "c+d e"
    times = [f"2026-01-01 00:00:{k:02d}" for k in (2, 0, 1)]
    texts = {
        "good": ("time,value\n" + "".join(f"{t},{k}\n" for k, t in enumerate(times)), "time,_file x,is_anomaly\n" + "".join(f"{t},{k}0,1\n" for k, t in enumerate(times))),
        "wide": ("time,a,b\n2026-01-01,1,2\n", "time,is_anomaly\n2026-01-01,1\n"),
        "late": ("time,value\nyesterday,1\n", "time,is_anomaly\n2026-01-01,yes\n"),
        "bare": ("time,value\n2026-01-01,1\n", "time,kind\n2026-01-01,x\n"),
        "lone": ("time,value\n2026-01-01,1\n", None),
    }
    for name, (rows, marks) in texts.items():
        (base / name).mkdir(parents=True)
        (base / name / "timeseries.csv").write_text(rows)
        if marks is not None:
            (base / name / "labels.csv").write_text(marks)
    series, labels = read_prepared(spark, str(tmp_path), on_error="skip")
    assert [r for r in (series, labels) if "csv" in r._jdf.queryExecution().executedPlan().toString().lower()] == []
    assert sorted((r.series_id, r.category, r.dataset_name, r.pos, r.value) for r in series.collect()) == [("c+d e/good", "c+d e", "good", k, v) for k, v in enumerate((1.0, 2.0, 0.0))]
    own = labels.where("dataset_name = 'good'").orderBy("pos").collect()
    assert [(r.pos, r["_file x"], r.is_anomaly) for r in own] == [(0, "10", 1), (1, "20", 1), (2, "00", 1)] and labels.count() == 4
    assert dict(labels.dtypes)["is_anomaly"] == "int"
    told = corpus_of(spark, tmp_path)
    assert told == {"good": None, "wide": "value_columns", "late": "time", "bare": "no_is_anomaly", "lone": "no_labels"}
    assert told == {r.dataset_name: r.reason for r in prepared_status(spark, str(tmp_path)).collect()}


def corpus_of(spark, folder):
    from driftline.sources.corpus import read_prepared_status

    return {r.dataset_name: r.reason for r in read_prepared_status(spark, str(folder))[2].collect()}
