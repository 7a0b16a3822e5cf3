"""All queries of the core and their SQL."""

from __future__ import annotations

from evidex.plans import aggregate_queries, core_queries, document_queries, io_queries, join_queries, link_queries, relational_queries, scalar_queries, stream_queries

_BOOKS = [scalar_queries.book, relational_queries.book, join_queries.book, aggregate_queries.book, document_queries.book, link_queries.book, io_queries.book, stream_queries.book]
QUERIES = dict(core_queries.QUERIES)
ORACLE = dict(core_queries.ORACLE)
for _b in _BOOKS:
    QUERIES |= _b.queries
    ORACLE |= _b.oracle
