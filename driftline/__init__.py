"""Anomaly scoring of many time series, and corpus preparation, as Spark DataFrame operators."""
