"""Registered queries and their oracle SQL."""

from __future__ import annotations

from statelens.plans import file_queries, graph_queries, rating_queries, report_queries, sample_queries, text_queries

MODULES = (graph_queries, rating_queries, sample_queries, text_queries, report_queries, file_queries)
QUERIES: dict = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES: dict = {k: s for m in MODULES for k, s in m.ORACLES.items()}


def flagship(spark, sf_dir):
    """The query that entry() runs: scores of every predicted graph against its case's gold graph."""
    return QUERIES["d13_score_runs"](spark, sf_dir)
