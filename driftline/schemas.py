"""Schemas of the tables that operators exchange."""

from __future__ import annotations

SERIES = "series_id string, pos bigint, time timestamp_ntz, value double"
LABELS = "series_id string, pos bigint, time timestamp_ntz, is_anomaly int, anomaly_type string"
CATALOG = "file_name string, dataset_id int, dataset_name string, train_end int, anomaly_start int, anomaly_end int, category string"
SETTINGS = "series_id string, preprocessing_mode string, period_method string, estimated_period int, seasonal_adjustment boolean, window_size int, stride int"
SCORES = "series_id string, branch string, window_no bigint, window_start timestamp_ntz, window_end timestamp_ntz, sigma2 double"
PERIODS = "dataset_idx int, period int, remarks string"

#: The columns of a row of metrics, in their order.
METRICS = (
    "preprocessing_mode", "category", "dataset_name", "timeseries_path", "labels_path", "sigma2_path", "figure_path",
    "period_method", "estimated_period", "seasonal_adjustment", "window_size", "stride", "order", "n_points", "n_windows",
    "anomaly_start", "anomaly_end", "ucr_prediction_index", "ucr_prediction_score", "ucr_correct_start", "ucr_correct_end", "ucr_correct",
)
