"""Reranking of hits by scores of (query, document) pairs, and the final cut."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.sources.shared import written

#: So many ids of hits go to where the texts are, and only those texts are moved; with more, texts and hits meet by a shuffle.
BROADCAST_IDS = 1 << 18

#: Makes a scorer: two columns of texts to logits. Called once in each Python worker, and only if there are pairs.
ScorerFactory = Callable[[], Callable[[pd.Series, pd.Series], np.ndarray]]


class Lazy:
    """A value made at its first use; that it could not be made is remembered too."""

    def __init__(self, make: Callable):
        self.make, self.done = make, None

    def __call__(self):
        if self.done is None:
            try:
                self.done = (self.make(), None)
            except Exception as error:
                self.done = (None, error)
        value, error = self.done
        if error is not None:
            raise error
        return value


def overlap_scorer() -> Callable[[pd.Series, pd.Series], np.ndarray]:
    """A scorer without a model: the share of the query's distinct words that the document has, as a logit in [-2, 2]."""

    def score(queries: pd.Series, documents: pd.Series) -> np.ndarray:
        asked = [set((q or "").lower().split()) for q in queries]
        return np.array([4.0 * len(a & set((d or "").lower().split())) / max(1, len(a)) - 2.0 for a, d in zip(asked, documents)])

    return score


def score_pairs(pairs: DataFrame, make: ScorerFactory, query_col: str = "query", text_col: str = "text") -> DataFrame:
    """pairs with reranker_score in [0, 1]; a score that isn't finite is an error."""
    lazy = Lazy(make)

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, d in batches:
            if not len(q):
                yield pd.Series([], dtype="float64")
                continue
            score = 1.0 / (1.0 + np.exp(-np.asarray(lazy()(q, d), dtype=np.float64)))
            if not np.isfinite(score).all():
                raise ValueError("a reranker score isn't finite")
            yield pd.Series(score)

    return pairs.withColumn("reranker_score", run(query_col, text_col))


def sort_results(scores: DataFrame, score_col: str = "score", index_col: str = "index") -> DataFrame:
    """(query_id, index, score) with rank from 0: best first, NaN before all, equal ones by index."""
    order = Window.partitionBy("query_id").orderBy(F.desc(score_col), index_col)
    return scores.withColumn("rank", (F.row_number().over(order) - 1).cast("bigint"))


def rerank(hits: DataFrame, queries: DataFrame, corpus: DataFrame, make: ScorerFactory | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hits with reranker_score and original_rank, in the reranker's order; without a reranker in their own, and no score."""
    kept = hits.withColumn("original_rank", F.col("in_rank"))
    if make is None:
        return kept.withColumn("reranker_score", F.lit(None).cast("double")).withColumn("rank", F.col("in_rank"))
    bodies = corpus.select(F.col(id_col).cast("string").alias("doc_id"), F.col(text_col).alias("body"))
    kept = written(kept, "hits")  # found once, for both uses
    ids = kept.select("doc_id").distinct()
    if ids.count() <= BROADCAST_IDS:
        bodies = bodies.join(F.broadcast(ids), "doc_id", "left_semi")
    pairs = kept.join(queries.select("query_id", "query"), "query_id").join(bodies, "doc_id", "left")
    scored = score_pairs(pairs, make, "query", "body").drop("query", "body")
    return sort_results(scored, "reranker_score", "original_rank")


def top_k(hits: DataFrame, k: int, rank_col: str = "rank") -> DataFrame:
    return hits.filter(F.col(rank_col) < k)
