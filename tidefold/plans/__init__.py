"""Registered queries over the driver's tables."""

from . import event_queries, metric_queries, recurrence_queries, source_queries, text_queries, vector_queries  # noqa: F401
