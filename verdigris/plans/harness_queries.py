"""Queries of the measures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.operators import harness
from verdigris.plans.registry import query
from verdigris.plans.text_queries import _values
from verdigris.sources.tables import read


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"))


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def linreg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.linear_fit(_points(spark, sf_dir)).select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("SELECT round(1 - sum(pow(l_extendedprice - (1000 * l_quantity + 50), 2)) / sum(pow(l_extendedprice - (SELECT avg(l_extendedprice) FROM lineitem), 2)), 6) AS r2 FROM lineitem")
def r_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.r_squared(_points(spark, sf_dir), F.lit(1000.0), F.lit(50.0)).select(F.round("r2", 6).alias("r2"))


@query("SELECT o_orderstatus, list_sort(list(o_totalprice))[count(o_totalprice) // 2 + 1] AS upper_median FROM orders GROUP BY o_orderstatus")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.upper_median(read(spark, sf_dir, "orders"), "o_totalprice", "o_orderstatus")


@query(
    """WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS a, list_transform(embedding, lambda x: CAST(x * 2 AS DOUBLE)) AS b FROM embeddings)
SELECT round(least(1.0, min(list_dot_product(a, b) / (sqrt(list_dot_product(a, a)) * sqrt(list_dot_product(b, b))))), 6) AS cosine_min, round(max(list_max(list_transform(a, lambda x: abs(x)))), 6) AS max_abs_diff FROM e"""
)
def fixture_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors against their doubles."""
    e = read(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("doc_id"), F.lit("c0").alias("chunk_id"), "embedding")
    doubled = e.withColumn("embedding", F.transform("embedding", lambda x: (x * 2).cast("float")))
    return harness.compare_embeddings(e, doubled).select(F.round("cosine_min", 6).alias("cosine_min"), F.round("max_abs_diff", 6).alias("max_abs_diff"))


_W = {
    "w1": "SELECT CAST(i AS BIGINT) AS text_id, CASE i WHEN 0 THEN repeat('apple pie is a traditional dessert enjoyed around the world. ', 800) ELSE repeat('the rain in Spain falls mainly on the plain. ', 500) END AS text FROM range(2) r(i)",
    "w2": "SELECT CAST(i AS BIGINT) AS text_id, 'short text number ' || i || ' for benchmarking W2 workload' AS text FROM range(100) r(i)",
    "w3": "SELECT CAST(i AS BIGINT) AS text_id, CASE WHEN i % 2 = 0 THEN repeat('benchmarking long text for W3 workload. ', CAST(100 + i // 2 * 10 AS INT)) ELSE 'short text ' || i // 2 END AS text FROM range(10) r(i)",
}


@query(_W["w1"])
def workload_w1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.workload(spark, "w1")


@query(_W["w2"])
def workload_w2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.workload(spark, "w2")


@query(_W["w3"])
def workload_w3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harness.workload(spark, "w3")


_RUNS = [
    ("long", 1243.0, 1000.0, 1.474, 0, 0, 0, 3, "saturated", "saturated"),
    ("short", 94.0, 1000.0, 1.005, 100, 0, 0, 0, None, None),
    ("mixed", 1443.0, 1000.0, 2.316, 5, 0, 5, 0, "aspirational", "primary"),
    ("slow", 1100.0, 1000.0, 1.15, 9, 1, 0, 0, "primary", "aspirational"),
    ("near", 900.0, 1000.0, 1.1, 9, 1, 0, 0, "aspirational", None),
    ("none", 5.0, 0.0, 0.0, 0, 0, 0, 0, None, None),
    ("edge", 1000.0, 1000.0, 1.2, 1, 0, 0, 0, "aspirational", "aspirational"),
]


@query(f"SELECT workload, ratio_tier, padding_tier FROM {_values([(r[0], r[8], r[9]) for r in _RUNS], 'workload, ratio_tier, padding_tier')}")
def threshold_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([r[:8] for r in _RUNS], "workload string, batch_ms double, sequential_ms double, padding_ratio double, bucket_0 int, bucket_1 int, bucket_2 int, bucket_3 int")
    return harness.tiers(rows).select("workload", "ratio_tier", "padding_tier")
