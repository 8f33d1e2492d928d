"""Hybrid retrieval end to end: candidates of both sources, fusion, one hit a document, reranking, the final cut."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdigris.config import Hybrid, Recency
from verdigris.operators import aggregate, fulltext, fusion, rerank, vectors


def candidates(queries: DataFrame, docs: DataFrame, vecs: DataFrame, query_vecs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", phrases: Callable[[DataFrame], DataFrame] = fulltext.phrases) -> DataFrame:
    """queries (query_id, query), docs, vecs (id, v), query_vecs (query_id, v) -> candidates: the best 3 * limit of each source. `phrases` says what a query asks for; by default it is in the query language."""
    top_n = 3 * limit
    scores = fulltext.bm25(phrases(queries), fulltext.tokenized(docs, id_col, text_col))
    text = fulltext.ranked(scores, "fts", top_n, F.asc(F.round("score", 9)))
    near = vectors.knn(vecs, query_vecs, top_n).select("query_id", F.lit("vector").alias("source"), F.col("id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("chunk_id"), "score", "rank")
    return text.unionByName(near)


def search(
    queries: DataFrame,
    docs: DataFrame,
    vecs: DataFrame,
    query_vecs: DataFrame,
    limit: int = 10,
    cfg: Hybrid = Hybrid(),
    ages: DataFrame | None = None,
    recency: Recency = Recency(),
    aggregator: aggregate.Aggregator = aggregate.max_chunk,
    scorer: rerank.ScorerFactory | None = None,
    merge: Callable[[DataFrame], DataFrame] | None = None,
    phrases: Callable[[DataFrame], DataFrame] = fulltext.phrases,
) -> DataFrame:
    """(query_id, doc_id, score, fts_score, vector_score, reranker_score, original_rank, rank): the first `limit` hits of each query."""
    found = candidates(queries, docs, vecs, query_vecs, limit, phrases=phrases)
    merged = merge(found) if merge else fusion.rrf(found, cfg) if ages is None else fusion.rrf_with_recency(found, ages, recency, cfg)
    hits = rerank.rerank(aggregator(merged), queries, docs, scorer)
    return rerank.top_k(hits, limit).select("query_id", "doc_id", "score", "fts_score", "vector_score", "reranker_score", "original_rank", "rank")
