"""Imports every module that registers queries."""

from . import graph_queries, more_queries, relational, retrieval_queries, text_queries  # noqa: F401
