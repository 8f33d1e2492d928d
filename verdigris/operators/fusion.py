"""Weighted reciprocal-rank fusion, with and without recency."""

from __future__ import annotations

import math
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.config import SOURCES, Hybrid, Recency
from verdigris.functions.ranking import is_finite, recency_decay


class MergeStrategy(Protocol):
    """Candidates to hits, for df.transform."""

    def __call__(self, candidates: DataFrame) -> DataFrame: ...


def order_hits(hits: DataFrame, *order: Column) -> DataFrame:
    """hits with in_rank, their place in their query's list, from 0. By default best score first, then by document and chunk."""
    by = order or (F.desc("score"), F.asc("doc_id"), F.asc_nulls_first("chunk_id"))
    return hits.withColumn("in_rank", (F.row_number().over(Window.partitionBy("query_id").orderBy(*by)) - 1).cast("bigint"))


def rrf(candidates: DataFrame, cfg: Hybrid = Hybrid()) -> DataFrame:
    """candidates -> hits: each adds weight / (k + rank) to its document and chunk. A weight of 0 or not finite, and a k + rank that is not a finite positive number, add nothing; what gets nothing isn't a hit."""
    known = F.when(F.col("source").isin(*SOURCES), F.col("source")).otherwise(F.raise_error(F.concat(F.lit("no such source: "), F.coalesce("source", F.lit("null")))))
    usable = {s: float(w) for s, w in cfg.weights.items() if w != 0 and math.isfinite(w)}
    weight = F.lit(None).cast("double")
    for s, w in usable.items():
        weight = F.when(F.col("src") == s, F.lit(w)).otherwise(weight)
    den = F.lit(float(cfg.k)) + F.col("rank")
    rows = candidates.withColumn("src", known).withColumn("w", weight).withColumn("den", den).filter(F.col("w").isNotNull() & is_finite(F.col("den")) & (F.col("den") > 0)).withColumn("c", F.col("w") / F.col("den"))
    of = lambda s: F.sum(F.when(F.col("src") == s, F.col("c")))
    merged = rows.groupBy("query_id", "doc_id", "chunk_id").agg(F.sum("c").alias("score"), of("fts").alias("fts_score"), of("vector").alias("vector_score"))
    return order_hits(merged)


def rrf_with_recency(candidates: DataFrame, ages: DataFrame, recency: Recency, cfg: Hybrid = Hybrid()) -> DataFrame:
    """rrf(), then weight * decay(age) is added for documents with an age in ages (doc_id, age_days). Each source's score stays. Of equal scores of a document's chunks, the one that was ahead stays ahead."""
    hits = rrf(candidates, cfg)
    if not recency.active:
        return hits
    boost = F.lit(float(recency.weight)) * recency_decay(F.col("age_days"), F.lit(float(recency.half_life_days)))
    boosted = hits.join(ages.select("doc_id", "age_days"), "doc_id", "left").withColumn("boost", F.when(F.col("age_days").isNotNull() & is_finite(boost), boost).otherwise(0.0))
    boosted = boosted.withColumn("was", F.col("in_rank")).withColumn("score", F.col("score") + F.col("boost"))
    return order_hits(boosted, F.desc("score"), F.asc("doc_id"), F.asc("was")).select(*hits.columns)
