"""Contiguous shards of equal bytes, from global prefix sums.

Only (id, size) of each row is moved: rows are range-partitioned by id and
sorted, each partition's total becomes an offset by a sum over the partitions'
totals (one row for each partition), and a running sum within the partition
does the rest. The ordered sizes are written to the shared folder once, as the
totals and the running sums must see the same partitions even after a loss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import documents, quoted, table

TARGET_BYTES = 64 << 20


def ordered_sizes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, int]:
    """(id, n_bytes, start_byte) in the order of (id, n_bytes), nulls first; and the sum of all sizes."""
    slim = docs.select(quoted(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(quoted(text_col).cast("string")), F.lit(0)).cast("long").alias("n_bytes"))
    cut = table(slim.repartitionByRange("id", "n_bytes").withColumn("part", F.spark_partition_id()), "sizes")
    totals = cut.groupBy("part").agg(F.sum("n_bytes").alias("in_part"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("in_part").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("part").orderBy("id", "n_bytes").rowsBetween(Window.unboundedPreceding, -1)
    summed = cut.withColumn("within", F.coalesce(F.sum("n_bytes").over(within), F.lit(0)))
    total = totals.agg(F.coalesce(F.sum("in_part"), F.lit(0)).alias("n")).first().n
    return summed.join(offsets, "part").select("id", "n_bytes", (F.col("offset") + F.col("within")).alias("start_byte")), total


def shard_by_bytes(docs: DataFrame, target_bytes: int = TARGET_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_bytes, start_byte, shard): the shard of each row.

    Rows are laid out in the order of their ids (nulls first, equal ids by
    size). Of n = ceil(total / target_bytes) shards, shard k takes the rows that
    begin in its n-th of the bytes: shards are contiguous, and no row is split,
    so a shard is larger than its share by less than one row. Null texts have
    size 0. An empty table gives an empty one; a table without bytes is shard 0.
    """
    sizes, total = ordered_sizes(docs, id_col, text_col)
    shards = max(1, -(-total // target_bytes))
    width = max(1, -(-total // shards))
    shard = F.least(F.expr(f"start_byte div {width}"), F.lit(shards - 1)).cast("long")
    return sizes.select(F.col("id").alias(id_col), "n_bytes", "start_byte", shard.alias("shard"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(documents(spark, sf_dir))


OP8_SQL = f"""
WITH s AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes FROM documents),
t AS (SELECT sum(n_bytes) AS total, greatest(1, (sum(n_bytes) + {TARGET_BYTES - 1}) // {TARGET_BYTES}) AS shards FROM s),
w AS (SELECT shards, greatest(1, (total + shards - 1) // shards) AS width FROM t),
p AS (SELECT doc_id, n_bytes, coalesce(sum(n_bytes) OVER (ORDER BY doc_id NULLS FIRST, n_bytes ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_byte FROM s)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(start_byte AS BIGINT) AS start_byte,
  CAST(least(start_byte // width, shards - 1) AS BIGINT) AS shard FROM p, w
"""
