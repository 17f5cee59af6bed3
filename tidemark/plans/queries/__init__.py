"""Registered queries over the given tables, each with its SQL where SQL can say it."""

from tidemark.plans.queries import chunk_queries, document_queries, ingest_queries, stream_queries, sync_queries
from tidemark.plans.queries.base import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "chunk_queries",
    "document_queries",
    "ingest_queries",
    "stream_queries",
    "sync_queries",
]
