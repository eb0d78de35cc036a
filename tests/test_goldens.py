"""Hand-worked cases."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from driftline.functions import scalar
from driftline.operators import augment, evaluate, periods, preprocess, scoring, windows, zoom

START = dt.datetime(2026, 1, 1)
SERIES = "series_id string, pos long, time timestamp_ntz, value double"


def series_of(spark, values, name="a"):
    return spark.createDataFrame([(name, k, START + dt.timedelta(seconds=k), None if v is None else float(v)) for k, v in enumerate(values)], SERIES)


def settings_of(spark, w, s, name="a"):
    return spark.createDataFrame([(name, w, s)], "series_id string, window_size int, stride int")


@pytest.mark.parametrize(("m", "w", "s", "ends"), [(10, 4, 3, [3, 6, 9]), (11, 4, 3, [3, 6, 9, 10]), (4, 4, 9, [3]), (12, 2, 5, [1, 6, 11])])
def test_window_ends(spark, m, w, s, ends):
    found = windows.trailing_windows(series_of(spark, range(m)), settings_of(spark, w, s)).orderBy("window_no").collect()
    assert [r.window_end_pos for r in found] == ends
    assert [r.window_no for r in found] == list(range(len(ends)))
    assert all(len(r.points) == w for r in found)


def test_windows_skip_missing_rows(spark):
    found = windows.trailing_windows(series_of(spark, [1, None, 2, None, 3, 4]), settings_of(spark, 3, 1)).orderBy("window_no").collect()
    assert [[p.pos for p in r.points] for r in found] == [[0, 2, 4], [2, 4, 5]]


def test_short_series(spark):
    series, settings = series_of(spark, range(3)), settings_of(spark, 4, 1)
    with pytest.raises(Exception, match="shorter than its window: series a"):
        windows.trailing_windows(series, settings).collect()
    assert windows.trailing_windows(series, settings, "skip").count() == 0


def test_window_and_stride_from_period(spark):
    found = spark.createDataFrame([(51,), (53,), (10,)], "p int").select(scalar.window_size_for(F.col("p")).alias("w")).select("w", scalar.stride_for(F.col("w")).alias("s")).collect()
    assert [tuple(r) for r in found] == [(102, 26), (106, 26), (50, 12)]


def test_midpoint_rounds_down(spark):
    rows = spark.createDataFrame([(START, START + dt.timedelta(seconds=49))], "a timestamp_ntz, b timestamp_ntz")
    assert rows.select(scalar.midpoint_time(F.col("a"), F.col("b"))).first()[0] == START + dt.timedelta(seconds=24)


def test_correct_interval_is_inclusive(spark):
    rows = spark.createDataFrame([(400,), (399,), (699,), (700,), (None,)], "i int")
    assert [r[0] for r in rows.select(scalar.is_correct(F.col("i"), F.lit(500), F.lit(599))).collect()] == [1, 0, 1, 0, 0]


def scored(spark, sigmas):
    rows = [("a", "raw", k, START + dt.timedelta(seconds=10 * k), START + dt.timedelta(seconds=10 * k + 9), s) for k, s in enumerate(sigmas)]
    return spark.createDataFrame(rows, "series_id string, branch string, window_no long, window_start timestamp_ntz, window_end timestamp_ntz, sigma2 double")


def test_first_of_equal_scores_is_flagged(spark):
    found = scoring.flag_best(scored(spark, [3.0, 7.0, 7.0, None])).orderBy("window_no").collect()
    assert [r.predicted_anomaly for r in found] == [0, 1, 0, 0]


def test_no_valid_score(spark):
    results = scoring.window_results(scored(spark, [None, None]), None)
    assert results.agg(F.sum("predicted_anomaly")).first()[0] == 0
    bounds = spark.createDataFrame([("a", 5, 9)], "series_id string, anomaly_start long, anomaly_end long")
    found = evaluate.localisation(results, bounds).first()
    assert (found.ucr_prediction_index, found.ucr_prediction_score, found.ucr_correct_start, found.ucr_correct_end, found.ucr_correct) == (None, None, None, None, 0)


def test_labels_are_clamped(spark):
    series = series_of(spark, range(10))
    catalog = spark.createDataFrame([("a", 5, 99, "kind")], "series_id string, anomaly_start int, anomaly_end int, category string")
    found = evaluate.point_labels(series, catalog).where("is_anomaly = 1").orderBy("pos").collect()
    assert [r.pos for r in found] == [5, 6, 7, 8, 9]


def test_labels_without_anomalies_and_gaps(spark):
    labels = spark.createDataFrame([("a", START + dt.timedelta(seconds=12), 1), ("a", START + dt.timedelta(seconds=39), 1)], "series_id string, time timestamp_ntz, is_anomaly int")
    found = scoring.overlaps(scored(spark, [1.0] * 5), labels).orderBy("window_no").collect()
    assert [r.actual_anomaly for r in found] == [0, 1, 0, 1, 0]
    none = scoring.overlaps(scored(spark, [1.0] * 3), labels.where("is_anomaly = 0")).agg(F.sum("actual_anomaly")).first()[0]
    assert none == 0


def test_train_flag_only_with_training_rows(spark):
    labels = spark.createDataFrame([("a", START + dt.timedelta(seconds=19), 0, 1)], "series_id string, time timestamp_ntz, is_anomaly int, is_train int")
    assert [r.is_train for r in scoring.train_flags(scored(spark, [1.0] * 3), labels).orderBy("window_no").collect()] == [1, 1, 0]
    assert "is_train" not in scoring.train_flags(scored(spark, [1.0]), labels.drop("is_train")).columns


@pytest.mark.parametrize("values", [list(range(11)), [5.0] * 40, [1.0, 2.0] * 20 + [float("inf")], []])
def test_no_period(spark, values):
    series = series_of(spark, values)
    for method in ("autocorr", "fft"):
        assert [r.estimated_period for r in periods.periods(series, method).collect()] == ([None] if values else [])


def test_period_of_a_square_wave(spark):
    values = [1.0 if k % 20 < 10 else -1.0 for k in range(400)]
    assert periods.autocorr_periods(series_of(spark, values)).first().estimated_period == 20
    assert periods.fft_periods(series_of(spark, values)).first().estimated_period == 20


def test_acf_does_not_depend_on_blocks(spark):
    series = series_of(spark, [(k * 37 % 101) + 3.0 * (k % 7) for k in range(300)])
    found = [{r.lag: round(r.acf, 10) for r in periods.acf(series, block=b).collect()} for b in (10_000, 17, 64)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 76


def test_unknown_choices():
    with pytest.raises(ValueError, match="no method of period"):
        periods.periods(None, "wavelet")
    with pytest.raises(ValueError, match="are scored in mode"):
        preprocess.window_settings(None, mode="other")
    with pytest.raises(ValueError, match="stride is too small"):
        preprocess.window_settings(None, stride=0)


def test_raw_mode_reports_no_method(spark):
    found = preprocess.window_settings(series_of(spark, range(20)), mode="raw").first()
    assert (found.period_method, found.estimated_period, found.seasonal_adjustment, found.window_size, found.stride) == ("none", None, False, 200, 50)


def test_safe_names(spark):
    rows = spark.createDataFrame([("a b(c)",), ("***",), ("x-y.z_1",)], "n string")
    assert [r[0] for r in rows.select(scalar.safe_name(F.col("n"))).collect()] == ["a_b_c", "unknown", "x-y.z_1"]
    ids = spark.createDataFrame([(7, "q r"), (1234, "s")], "i int, n string")
    assert [r[0] for r in ids.select(scalar.dataset_folder(F.col("i"), F.col("n"))).collect()] == ["ucr_007_q_r", "ucr_1234_s"]


def test_file_fields(spark):
    names = ["001_UCR_Anomaly_a_b_10_20_30.txt", "1234_UCR_Anomaly_x y+z_1_2_3.txt"]
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in rows.select(scalar.file_field(F.col("n"), 2)).collect()] == ["a_b", "x y+z"]
    with pytest.raises(Exception, match="not the name of a corpus file"):
        spark.createDataFrame([("other.txt",)], "n string").select(scalar.file_field(F.col("n"), 1)).collect()


def test_zoom(spark):
    series = series_of(spark, range(2000))
    def ends(a, z):
        bounds = spark.createDataFrame([("a", START + dt.timedelta(seconds=a), START + dt.timedelta(seconds=z))], "series_id string, first_time timestamp_ntz, last_time timestamp_ntz")
        r = zoom.zoom_bounds(series, bounds).first()
        return ((r.zoom_start - START).seconds, (r.zoom_end - START).seconds)
    assert ends(300, 350) == (0, 850)
    assert ends(900, 1800) == (400, 1999)
    bounds = spark.createDataFrame([("a", None, None)], "series_id string, first_time timestamp_ntz, last_time timestamp_ntz")
    assert zoom.zoom_bounds(series, bounds).count() == 0


@pytest.mark.parametrize(("start", "duration", "said"), [(-1, 3, "starts before"), (0, 0, "lasts no row"), (8, 3, "after the end")])
def test_burst_must_fit(spark, start, duration, said):
    bursts = spark.createDataFrame([("a", start, duration)], "series_id string, start long, duration long")
    with pytest.raises(Exception, match=said):
        augment.variance_burst(series_of(spark, range(10)), bursts).collect()


def test_burst_is_found(spark):
    series = series_of(spark, [(k * 7919 % 113) / 10 for k in range(600)])
    bursts = spark.createDataFrame([("a", 300, 60)], "series_id string, start long, duration long")
    burst = augment.variance_burst(series, bursts, 8.0, 3)
    assert burst.repartition(7).orderBy("pos").collect() == burst.orderBy("pos").collect()
    noisy = burst.select("series_id", "pos", "time", "value")
    found = scoring.scores(scoring.score_series(noisy, settings_of(spark, 50, 12), (0, 1, 0)))
    best = scoring.window_results(found, burst).where("predicted_anomaly = 1").first()
    assert best.actual_anomaly == 1


def test_summaries_keep_a_null_category(spark):
    rows = [("a", 1), ("a", 0), ("b", 1), (None, 0), (None, 1), ("b", 1)]
    metrics = spark.createDataFrame(rows, "category string, ucr_correct int")
    found = [tuple(r) for r in evaluate.overall_summary(metrics).collect()]
    assert found == [("a", 2, 1, 0.5), ("b", 2, 2, 1.0), (None, 2, 1, 0.5), ("overall", 6, 4, 4 / 6)]
    assert [tuple(r) for r in evaluate.category_summary(metrics).collect()] == found[:-1]


def test_run_names():
    assert scalar.run_name((1, 1, 1), "seasonal_diff", "fft", 200, 50) == "ucr_preproc-fft_arima111"
    assert scalar.run_name((1, 0, 1), "raw", "fft", 100, 25, "x") == "x_preproc-raw-w100-s25_arima101"
    assert scalar.run_name((1, 0, 1), "seasonal_diff", "autocorr", 1, 1, single=True) == "simulation_period-autocorr_arima101"


def test_period_accuracy(spark):
    settings = spark.createDataFrame([(1, 24), (2, 48), (3, None), (4, 31)], "dataset_idx int, estimated_period int")
    curated = spark.createDataFrame([(1, 25), (2, 24), (3, 10), (4, 24)], "dataset_idx int, period int")
    found = evaluate.period_accuracy(settings, curated).orderBy("dataset_idx").collect()
    assert [(r.is_match, r.is_multiple) for r in found] == [(1, 1), (0, 1), (0, 0), (0, 0)]
