"""From hits of chunks to hits of documents."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigris.operators.fusion import order_hits


class Aggregator(Protocol):
    """Hits to hits, for df.transform."""

    def __call__(self, hits: DataFrame) -> DataFrame: ...


def _of_document(hits: DataFrame) -> DataFrame:
    return hits.withColumn("chunk_id", F.lit(None).cast("string"))


def identity(hits: DataFrame) -> DataFrame:
    return hits


def max_chunk(hits: DataFrame) -> DataFrame:
    """The best chunk of each document, the first of equals, as the document's hit. A score that is NaN is beaten by any number, unless it is the first."""
    document = Window.partitionBy("query_id", "doc_id")
    leads = F.col("in_rank") == F.min("in_rank").over(document)
    best = document.orderBy(F.when(F.isnan("score"), F.when(leads, 0).otherwise(2)).otherwise(1), F.desc("score"), "in_rank")
    return order_hits(_of_document(hits.withColumn("nth", F.row_number().over(best)).filter("nth = 1").drop("nth", "in_rank")))


def dedupe(hits: DataFrame) -> DataFrame:
    """The first hit of each document, in the order given."""
    first = Window.partitionBy("query_id", "doc_id").orderBy("in_rank")
    return order_hits(_of_document(hits.withColumn("nth", F.row_number().over(first)).filter("nth = 1").drop("nth")), F.asc("in_rank"))


def top_k_average(k: int):
    """The mean of each document's k best hits, of all if it has fewer. A source's scores are summed and divided by as many hits, lacking ones counting as 0; k = 0 gives no hits."""

    def run(hits: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "in_rank")
        some = hits.withColumn("nth", F.row_number().over(best)).filter(F.col("nth") <= k)
        mean = some.groupBy("query_id", "doc_id").agg(*[(F.sum(c) / F.count("*")).alias(c) for c in ("score", "fts_score", "vector_score")])
        return order_hits(_of_document(mean).select("query_id", "doc_id", "chunk_id", "score", "fts_score", "vector_score"))

    return run


def group_by_parent(hits: DataFrame) -> DataFrame:
    """(query_id, doc_id, hits): each document's hits, in the order given."""
    return hits.groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct("in_rank", "chunk_id", "score", "fts_score", "vector_score"))).alias("hits"))
