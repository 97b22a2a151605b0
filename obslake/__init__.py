"""Observability analytics on Spark: logs, metrics, traces and cluster metadata as DataFrames."""
