"""Imports every query module of this folder, which registers the queries."""

from tessera.llm import corpus_queries, label_queries, near_queries, scan_queries, text_queries  # noqa: F401
from tessera.llm.registry import ORACLES, QUERIES  # noqa: F401
