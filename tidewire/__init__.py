"""Telemetry analytics on Spark: decode, ingest, read back, measure and maintain sensor time series."""

from .session import configure, shared_dir

__all__ = ["configure", "shared_dir"]
