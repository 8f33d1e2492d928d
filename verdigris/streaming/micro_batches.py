"""Retrieval over streams: postings of arriving documents, and fusion of arriving candidates batch by batch.

The operators are those for tables. Row-wise ones run on a stream as they are;
ranking needs all of a query's candidates, so it runs on each micro-batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from verdigris.operators import fulltext


def index_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Appends the postings of a stream of documents to a table."""
    return fulltext.postings(docs, **options).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").start(path)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Writes operator(batch) for each micro-batch. A batch that runs again after a loss replaces what it wrote: each has a folder of its own."""

    def write(batch: DataFrame, number: int) -> None:
        operator(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
