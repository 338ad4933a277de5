"""Importing this module registers every query."""

from clausewright.plans import asof_queries, build_queries, clause_queries, clause_view_queries, corpus_queries, file_queries, log_queries, matching_queries, retrieval_queries, review_queries, search_queries, stream_queries, wording_queries  # noqa: F401
