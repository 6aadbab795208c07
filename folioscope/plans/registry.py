"""Queries over the reference tables and their oracles."""

from folioscope.plans import answer_queries, catalogue_queries, evaluation_queries, file_queries, retrieval_queries, session_queries, text_queries

_ALL = {k: v for m in (answer_queries, catalogue_queries, evaluation_queries, file_queries, retrieval_queries, session_queries, text_queries) for k, v in m.QUERIES.items()}

QUERIES = {k: f for k, (f, _) in _ALL.items()}
ORACLES = {k: sql for k, (_, sql) in _ALL.items() if sql}
