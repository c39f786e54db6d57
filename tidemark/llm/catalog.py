"""Registered queries of the training-data operators, the pipeline, and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from tidemark.llm import queries

QUERIES = {**queries.QUERIES, "pipeline": corpus_pipeline.run}
ORACLES = dict(queries.ORACLES)
if corpus_pipeline.ORACLE_SQL:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
