"""All registered queries."""

from __future__ import annotations

from tablewright.plans import file_queries, governed_queries, oplog_queries, transform_queries  # noqa: F401

QUERIES = transform_queries.QUERIES
ORACLES = transform_queries.ORACLES
