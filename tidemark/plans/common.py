"""SQL of the derived view that the oracle queries share, and a small registration helper."""

from __future__ import annotations

from collections.abc import Callable

#: The same derivation as :func:`tidemark.schema.points`.
POINTS = """points AS (SELECT d.doc_id AS id, d.text, d.source, d.lang AS profile_id, TIMESTAMP '2024-01-01 00:00:00' + to_hours(d.doc_id) AS created_at,
  CAST(1 + d.doc_id % 10 AS INTEGER) AS importance, CAST(d.doc_id % 3 AS INTEGER) AS access_count, (d.doc_id % 10) / 10.0::DOUBLE AS confidence,
  d.doc_id % 7 = 0 AS stale, d.doc_id % 11 = 0 AS requires_review,
  CASE d.doc_id % 6 WHEN 1 THEN 'active' WHEN 2 THEN 'stale' WHEN 3 THEN 'superseded' WHEN 4 THEN 'disputed' WHEN 5 THEN 'deprecated' END AS fact_status,
  coalesce(l.quality = 1, false) AS canonical, coalesce(l.toxic = 1, false) AS consolidation_quarantined, 'fact-' || CAST(d.doc_id % 97 AS VARCHAR) AS fact_key
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""
VISIBLE = "visible AS (SELECT * FROM points WHERE NOT consolidation_quarantined AND coalesce(fact_status NOT IN ('deprecated', 'superseded'), true))"
#: The pool of the search queries: the 20 visible points most similar to vector 0.
POOL = f"""{POINTS}, {VISIBLE}, q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0),
scored AS (SELECT p.*, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), q.v) AS similarity FROM visible p JOIN embeddings e ON e.vec_id = p.id, q),
pool AS (SELECT * FROM scored ORDER BY similarity DESC, id LIMIT 20)"""


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable:
        def register(query: Callable) -> Callable:
            self.queries[query.__name__] = query
            if sql is not None:
                self.sql[query.__name__] = sql
            return query

        return register
