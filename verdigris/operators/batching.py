"""Batches of chunks of like length: buckets, sub-batches within a token budget, padding, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigris.config import BUCKET_BOUNDS, TOKEN_BUDGET
from verdigris.sources.shared import written


def bucket_of(length: Column) -> Column:
    """The first bucket whose bound a length doesn't exceed; beyond the last is an error."""
    out = F.raise_error(F.concat(F.lit("longer than the last bucket: "), length.cast("string"))).cast("int")
    for i, bound in reversed(list(enumerate(BUCKET_BOUNDS))):
        out = F.when(length <= bound, F.lit(i)).otherwise(out)
    return out


def bound_of(bucket: Column) -> Column:
    return F.get(F.array(*[F.lit(b) for b in BUCKET_BOUNDS]), bucket)


def sub_batch_size(bound: int, budget: int = TOKEN_BUDGET) -> int:
    return max(1, budget // bound)


def assign(chunks: DataFrame, budget: int = TOKEN_BUDGET, length: str = "length", order: tuple[str, ...] = ("doc_id", "chunk_idx")) -> DataFrame:
    """chunks with bucket and sub_batch: in each bucket, in order, as many as the budget allows at the bucket's bound.

    There are four buckets, so numbering them one by one would be four tasks.
    Chunks are dealt by ranges of the order and numbered within each range; the
    ranges' counts, four numbers a range, give where each begins."""
    size = F.greatest(F.lit(1), F.floor(F.lit(budget) / bound_of(F.col("bucket"))))
    placed = chunks.withColumn("bucket", bucket_of(F.col(length))).repartitionByRange("bucket", *order).withColumn("__part", F.spark_partition_id())
    within = Window.partitionBy("__part", "bucket").orderBy(*order)
    placed = written(placed.withColumn("__nth", F.row_number().over(within)), "ranges")  # the same ranges for both uses
    before = Window.partitionBy("bucket").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("__part", "bucket").agg(F.count("*").alias("n")).select("__part", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__before"))
    numbered = placed.join(F.broadcast(counts), ["__part", "bucket"])  # a row for each range and bucket
    return numbered.withColumn("sub_batch", F.floor((F.col("__before") + F.col("__nth") - 1) / size).cast("int")).select(*chunks.columns, "bucket", "sub_batch")


def histogram(chunks: DataFrame, length: str = "length") -> DataFrame:
    """One row: chunks in each bucket."""
    b = bucket_of(F.col(length))
    return chunks.select(b.alias("b")).agg(*[F.count_if(F.col("b") == i).alias(f"bucket_{i}") for i in range(len(BUCKET_BOUNDS))])


def metrics(assigned: DataFrame, length: str = "length") -> DataFrame:
    """One row: real and padded tokens (sub-batches are padded to their bucket's bound), their ratio (0 without tokens), the largest batch and length, the histogram."""
    each = assigned.groupBy("bucket", "sub_batch").agg(F.sum(length).alias("real"), F.count("*").alias("n"), F.max(length).alias("longest"))
    padded = F.col("n") * bound_of(F.col("bucket"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    total = each.agg(
        zero(F.sum("real")).alias("real_tokens"),
        zero(F.sum(padded)).alias("padded_tokens"),
        zero(F.max("n")).alias("batch_size"),
        zero(F.max("longest")).alias("max_seq_len"),
        *[zero(F.sum(F.when(F.col("bucket") == i, F.col("n")))).alias(f"bucket_{i}") for i in range(len(BUCKET_BOUNDS))],
    )
    return total.withColumn("padding_ratio", F.when(F.col("real_tokens") > 0, F.col("padded_tokens") / F.col("real_tokens")).otherwise(0.0))


def pad(ids: Column, length: Column, filler: int = 0) -> Column:
    """ids with filler up to length; longer ones stay."""
    return F.concat(ids, F.array_repeat(F.lit(filler), F.greatest(length - F.size(ids), F.lit(0)).cast("int")))


def pad_batches(rows: DataFrame, batch: list[str], target: int | None = None, ids: str = "ids", mask: str | None = None) -> DataFrame:
    """rows with padded_ids and padded_mask, as long as the longest of their batch, or target if that is more. A mask that isn't as long as its ids is an error."""
    longest = F.max(F.size(ids)).over(Window.partitionBy(*batch))
    to = F.greatest(longest, F.lit(target or 0))
    ones = F.array_repeat(F.lit(1), F.size(ids))
    given = ones if mask is None else F.when(F.size(mask) == F.size(ids), F.col(mask)).otherwise(F.raise_error(F.lit("a mask has another length than its ids")))
    out = rows.withColumn("to", to)
    return out.withColumn("padded_ids", pad(F.col(ids), F.col("to"))).withColumn("padded_mask", pad(given, F.col("to"))).drop("to")


def in_order(outputs: DataFrame, inputs: DataFrame, key: list[str]) -> DataFrame:
    """inputs with what was made of them; an input without an output is an error, as an output without an input is."""
    joined = inputs.withColumn("asked", F.lit(True)).join(outputs.withColumn("made", F.lit(True)), key, "full")
    ok = F.col("asked").isNotNull() & F.col("made").isNotNull()
    return joined.withColumn("made", F.when(ok, F.col("made")).otherwise(F.raise_error(F.lit("inputs and outputs don't match")))).filter("made").drop("asked", "made")
