"""Streaming operators."""

from .dedupe import dedupe_stream, first_arrivals, read_first_rows, write_first_rows
from .metrics import BatchLog, BatchMetrics, observed

__all__ = ["BatchLog", "BatchMetrics", "dedupe_stream", "first_arrivals", "observed", "read_first_rows", "write_first_rows"]
