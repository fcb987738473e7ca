"""Imports every query module, so that the registry is complete."""

from corpus_spark.testbed import (  # noqa: F401
    core_queries,
    document_queries,
    merge_queries,
    streaming_queries,
    telemetry_queries,
    triage_queries,
    validation_queries,
)
from corpus_spark.testbed.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
