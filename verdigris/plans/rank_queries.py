"""Queries of fusion, aggregation and reranking, over conversations (a conversation is a document, its turns are chunks)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.config import Hybrid, Recency
from verdigris.functions import ranking as R
from verdigris.operators import aggregate, fusion, rerank
from verdigris.plans.registry import query
from verdigris.plans.text_queries import _values
from verdigris.schemas import CANDIDATES
from verdigris.sources.tables import hits_from_json, hits_to_json, read

RECENCY = Recency(weight=0.01, half_life_days=7.0)
LAST_DAY = "2024-01-31"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each role as a query: its turns by length as one source's list, the same turns in a scrambled order as the other's."""
    c = read(spark, sf_dir, "conversations").select(
        F.when(F.col("role") == "user", 1).otherwise(0).cast("bigint").alias("query_id"), F.col("conv_id").cast("string").alias("doc_id"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("chunk_id"), F.char_length("text").cast("double").alias("len"), ((F.col("conv_id") * 7919 + F.col("turn") * 104729) % 10007).alias("mix")
    )
    text = Window.partitionBy("query_id").orderBy(F.desc("len"), "doc_id", "chunk_id")
    near = Window.partitionBy("query_id").orderBy("mix", "doc_id", "chunk_id")
    return c.select("query_id", F.lit("fts").alias("source"), "doc_id", "chunk_id", (-F.col("len")).alias("score"), (F.row_number().over(text) - 1).cast("bigint").alias("rank")).unionByName(
        c.select("query_id", F.lit("vector").alias("source"), "doc_id", "chunk_id", F.col("mix").cast("double").alias("score"), (F.row_number().over(near) - 1).cast("bigint").alias("rank"))
    )


CAND_CTE = """
t AS (SELECT CASE WHEN role = 'user' THEN 1 ELSE 0 END AS query_id, CAST(conv_id AS VARCHAR) AS doc_id, 'c' || turn AS chunk_id, length(text) AS len, (conv_id * 7919 + turn * 104729) % 10007 AS mix FROM conversations),
cand AS (SELECT query_id, 'fts' AS source, doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY len DESC, doc_id, chunk_id) - 1 AS rank FROM t
  UNION ALL SELECT query_id, 'vector', doc_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY mix, doc_id, chunk_id) - 1 FROM t)"""


def _rrf_cte(fts: float = 1.0, vector: float = 1.0, k: float = 60.0) -> str:
    return f"""{CAND_CTE},
f AS (SELECT query_id, doc_id, chunk_id, sum(c) AS score, sum(CASE WHEN source = 'fts' THEN c END) AS fts_score, sum(CASE WHEN source = 'vector' THEN c END) AS vector_score
  FROM (SELECT *, (CASE source WHEN 'fts' THEN {fts!r}::DOUBLE ELSE {vector!r}::DOUBLE END) / ({k!r}::DOUBLE + rank) AS c FROM cand) WHERE c <> 0 GROUP BY ALL),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id, chunk_id NULLS FIRST) - 1 AS in_rank FROM f)"""


_CELLS = "round(score, 9) AS score, round(fts_score, 9) AS fts_score, round(vector_score, 9) AS vector_score"


def _out(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "doc_id", "chunk_id", *[F.round(c, 9).alias(c) for c in ("score", "fts_score", "vector_score")], "in_rank")


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rrf(candidates(spark, sf_dir))


def _sql(cte: str, table: str) -> str:
    return f"WITH {cte} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, CAST(chunk_id AS VARCHAR) AS chunk_id, {_CELLS}, in_rank FROM {table}"


@query(_sql(_rrf_cte(), "hits"))
def rrf_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(hits(spark, sf_dir))


@query(_sql(_rrf_cte(5.0, 1.0, 10.0), "hits"))
def rrf_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fusion.rrf(candidates(spark, sf_dir), Hybrid(10.0, {"fts": 5.0, "vector": 1.0})))


@query(_sql(_rrf_cte(1.0, 0.0), "hits"))
def rrf_zero_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source without weight gives no hits; one that weights don't name has none."""
    return _out(fusion.rrf(candidates(spark, sf_dir), Hybrid(60.0, {"fts": 1.0})))


_GUARDED = [(0, "fts", "d1", None, 0.0, 0), (0, "vector", "d1", None, 0.0, 1), (0, "fts", "d2", None, 0.0, 1), (0, "fts", "d1", None, 0.0, 4), (1, "vector", "d3", "c0", 0.0, 0)]


@query(f"""SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, round(CAST(score AS DOUBLE), 9) AS score FROM {_values([(0, "d2", -1.0), (0, "d1", -0.25)], 'query_id, doc_id, score')}""")
def rrf_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k = 0 leaves out rank 0, an infinite weight its source; negative weights count, and repeated candidates add up."""
    rows = spark.createDataFrame(_GUARDED, CANDIDATES)
    return fusion.rrf(rows, Hybrid(0.0, {"fts": -1.0, "vector": float("inf")})).select("query_id", "doc_id", F.round("score", 9).alias("score"))


def ages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days since each user's last event, taken as the age of the document of that number."""
    last = read(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last"))
    seconds = F.unix_timestamp(F.lit(f"{LAST_DAY} 00:00:00").cast("timestamp_ntz").cast("timestamp")) - F.unix_timestamp(F.date_trunc("second", "last").cast("timestamp"))
    return last.select(F.col("user_id").cast("string").alias("doc_id"), (seconds / 86400.0).alias("age_days"))


_AGES = f"ages AS (SELECT CAST(user_id AS VARCHAR) AS doc_id, (epoch(TIMESTAMP '{LAST_DAY}') - epoch(date_trunc('second', max(ts)))) / 86400.0 AS age_days FROM events GROUP BY user_id)"


@query(f"WITH {_AGES} SELECT doc_id, round(age_days, 6) AS age_days, round(exp(-ln(2) * greatest(age_days, 0) / 7), 9) AS decay FROM ages")
def recency_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ages(spark, sf_dir).select("doc_id", F.round("age_days", 6).alias("age_days"), F.round(R.recency_decay(F.col("age_days"), F.lit(7.0)), 9).alias("decay"))


@query(
    f"""WITH {_rrf_cte()}, {_AGES},
b AS (SELECT query_id, doc_id, chunk_id, score + coalesce({RECENCY.weight} * exp(-ln(2) * greatest(age_days, 0) / {RECENCY.half_life_days}), 0) AS score, fts_score, vector_score, in_rank AS was FROM hits LEFT JOIN ages USING (doc_id))
SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, chunk_id, {_CELLS}, row_number() OVER (PARTITION BY query_id ORDER BY b.score DESC, doc_id, was) - 1 AS in_rank FROM b"""
)
def rrf_recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(fusion.rrf_with_recency(candidates(spark, sf_dir), ages(spark, sf_dir), RECENCY))


@query(_sql(_rrf_cte(), "hits"))
def agg_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(aggregate.identity(hits(spark, sf_dir)))


@query(
    _sql(
        _rrf_cte()
        + """, m AS (SELECT query_id, doc_id, NULL AS chunk_id, score, fts_score, vector_score FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, hits.in_rank) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS in_rank FROM m)""",
        "o",
    )
)
def agg_max_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(aggregate.max_chunk(hits(spark, sf_dir)))


@query(
    _sql(
        _rrf_cte()
        + """, m AS (SELECT query_id, doc_id, NULL AS chunk_id, score, fts_score, vector_score, hits.in_rank AS was FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY hits.in_rank) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY was) - 1 AS in_rank FROM m)""",
        "o",
    )
)
def agg_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(aggregate.dedupe(hits(spark, sf_dir)))


@query(
    _sql(
        _rrf_cte()
        + """, m AS (SELECT query_id, doc_id, NULL AS chunk_id, sum(score) / count(*) AS score, sum(fts_score) / count(*) AS fts_score, sum(vector_score) / count(*) AS vector_score
  FROM (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, hits.in_rank) <= 3) GROUP BY query_id, doc_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS in_rank FROM m)""",
        "o",
    )
)
def agg_topk_avg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _out(aggregate.top_k_average(3)(hits(spark, sf_dir)))


@query(f"WITH {_rrf_cte()} SELECT CAST(query_id AS BIGINT) AS query_id, doc_id, count(*) AS n, string_agg(chunk_id, ',' ORDER BY in_rank) AS chunks FROM hits GROUP BY query_id, doc_id")
def group_by_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = aggregate.group_by_parent(hits(spark, sf_dir))
    return g.select("query_id", "doc_id", F.size("hits").cast("bigint").alias("n"), F.array_join(F.transform("hits", lambda h: h.chunk_id), ",").alias("chunks"))


@query(_sql(_rrf_cte(), "hits"))
def hit_json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits written as JSON and read again."""
    text = hits_to_json(hits(spark, sf_dir)).select("query_id", "in_rank", "json")
    return _out(hits_from_json(text))


@query("SELECT event_id, round(1 / (1 + exp(-value)), 9) AS s FROM events")
def sigmoid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", F.round(R.sigmoid(F.col("value")), 9).alias("s"))


@query("SELECT user_id AS query_id, event_id AS index, value AS score, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) - 1 AS rank FROM events")
def rerank_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("query_id"), F.col("event_id").alias("index"), F.col("value").alias("score"))
    return rerank.sort_results(e)
