"""Schemas of the tables that the retrieval operators pass on."""

from __future__ import annotations

CANDIDATES = "query_id bigint, source string, doc_id string, chunk_id string, score double, rank bigint"
HITS = "query_id bigint, doc_id string, chunk_id string, score double, fts_score double, vector_score double, in_rank bigint"
CHUNK_EMBEDDINGS = "doc_id string, chunk_id string, chunk_idx int, embedding array<float>"
QUERIES = "query_id bigint, query string"
HIT_JSON = "doc_id string, chunk_id string, score double, source_scores map<string,double>"
