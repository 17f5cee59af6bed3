"""tidemark: the life of a time-series table, written as Spark jobs."""

from tidemark.session import build_session, shared_folder
from tidemark.spec import Dimension, IngestSpec, Metric, Rule

__all__ = ["Dimension", "IngestSpec", "Metric", "Rule", "build_session", "shared_folder"]
