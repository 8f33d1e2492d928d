"""Measures of embedding runs: regression, medians, comparison with fixtures, workloads, threshold tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.functions.ranking import cosine, ratio

RATIO_LIMITS, PADDING_LIMITS, LEAST_R2 = (1.0, 0.8), (1.2, 1.1), 0.95


def linear_fit(points: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """One row (slope, intercept) by least squares; an error without points or without variance of x."""
    fit = points.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))
    return fit.withColumn("slope", F.coalesce("slope", F.raise_error(F.lit("x has no variance")).cast("double")))


def r_squared(points: DataFrame, slope: Column, intercept: Column, x: str = "x", y: str = "y") -> DataFrame:
    """One row (r2) for the coefficients given: 1 - residuals / variance, below 0 for a bad line; 1 where y is constant."""
    mean = points.agg(F.avg(y).alias("mean_y"))
    sums = points.crossJoin(mean).agg(F.sum(F.pow(F.col(y) - (slope * F.col(x) + intercept), 2)).alias("res"), F.sum(F.pow(F.col(y) - F.col("mean_y"), 2)).alias("tot"))
    return sums.select(F.when(F.col("tot") > 0, 1 - F.col("res") / F.when(F.col("tot") > 0, F.col("tot"))).otherwise(1.0).alias("r2"))


def upper_median(rows: DataFrame, value: str, *key: str) -> DataFrame:
    """The element at place n // 2 of the sorted values of each key."""
    return rows.groupBy(*key).agg(F.get(F.array_sort(F.collect_list(value)), F.floor(F.count(value) / 2).cast("int")).alias("upper_median"))


def compare_embeddings(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row (cosine_min, max_abs_diff) of two tables (doc_id, chunk_id, embedding); a difference of shape is an error. NaN is passed over, as the least cosine begins at 1 and the largest difference at 0."""
    both = expected.select("doc_id", "chunk_id", F.col("embedding").alias("a")).join(actual.select("doc_id", "chunk_id", F.col("embedding").alias("b")), ["doc_id", "chunk_id"], "full")
    fits = F.coalesce(F.size("a") == F.size("b"), F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull()
    diffs = F.filter(F.zip_with("a", "b", lambda x, y: F.abs(x - y).cast("double")), lambda d: ~F.isnan(d))
    each = both.select(F.when(fits, F.coalesce(F.array_max(diffs), F.lit(0.0))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("shapes differ at"), "doc_id", "chunk_id")).cast("double")).alias("d"), cosine(F.col("a"), F.col("b")).alias("c"))
    return each.agg(F.least(F.lit(1.0), F.min(F.when(~F.isnan("c"), F.col("c")))).alias("cosine_min"), F.coalesce(F.max("d"), F.lit(0.0)).alias("max_abs_diff"))


def workload(spark: SparkSession, name: str) -> DataFrame:
    """(text_id, text): w1 has two long texts, w2 a hundred short ones, w3 ten, long and short in turn."""
    i = F.col("text_id")
    if name == "w1":
        text = F.when(i == 0, F.repeat(F.lit("apple pie is a traditional dessert enjoyed around the world. "), 800)).otherwise(F.repeat(F.lit("the rain in Spain falls mainly on the plain. "), 500))
        return spark.range(2).select(F.col("id").alias("text_id")).withColumn("text", text)
    if name == "w2":
        return spark.range(100).select(F.col("id").alias("text_id")).withColumn("text", F.format_string("short text number %d for benchmarking W2 workload", i))
    if name == "w3":
        k = F.floor(i / 2).cast("int")
        text = F.when(i % 2 == 0, F.repeat(F.lit("benchmarking long text for W3 workload. "), 100 + k * 10)).otherwise(F.format_string("short text %d", k))
        return spark.range(10).select(F.col("id").alias("text_id")).withColumn("text", text)
    raise ValueError(name)


def tiers(results: DataFrame) -> DataFrame:
    """results (workload, batch_ms, sequential_ms, padding_ratio, bucket_0..bucket_3) -> with saturated, amenable, ratio_tier and padding_tier.

    Saturated: all chunks in one bucket, one of the long two; amenable: none in
    the long two. A saturated workload is held against the second limit only,
    for information; the first limit is enforced on the ratio of amenable ones
    and on the padding of all that aren't saturated. A limit is passed from
    above it; null: within all.
    """
    counts = [F.col(f"bucket_{i}") for i in range(4)]
    filled = sum(((c > 0).cast("int") for c in counts[1:]), (counts[0] > 0).cast("int"))
    long = (counts[2] > 0) | (counts[3] > 0)
    out = results.withColumn("ratio", ratio(F.col("batch_ms"), F.col("sequential_ms"))).withColumn("saturated", (filled == 1) & long).withColumn("amenable", ~long)

    def tier(value: Column, limits: tuple[float, float], enforced: Column) -> Column:
        over = value > limits[1]
        return F.when(F.col("saturated"), F.when(over, "saturated")).when(enforced & (value > limits[0]), "primary").when(over, "aspirational")

    return out.withColumn("ratio_tier", tier(F.col("ratio"), RATIO_LIMITS, F.col("amenable"))).withColumn("padding_tier", tier(F.col("padding_ratio"), PADDING_LIMITS, ~F.col("saturated")))
