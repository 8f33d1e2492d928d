"""Exact dedup by skew-safe combining.

Rows of equal text are combined three times, and each time whole texts are
compared, the digest only choosing where rows go: within each input partition
(the partial half of the first aggregation), within each salted digest group
(its final half), and over the salts' winners. However often a text occurs, no
task sees more than one row of it from each input partition, shared out over
`salts` tasks, and the last step sees at most `salts` rows of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.common import documents, own, quoted, row_order

SALTS = 16


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text, with all its columns.

    The row of the smallest id stays, nulls last; of rows with equal ids the
    first by the other columns in their order (columns without an order, such
    as maps, by their JSON). Null is a text of its own, which differs from the
    empty one: one row of each stays. An empty table gives an empty one.
    """
    digest, salt, text, order, rest = own(docs, "digest", "salt", "text", "order", "rest")
    others = [c for c in docs.columns if c != text_col]
    rows = docs.select(
        F.xxhash64(quoted(text_col)).alias(digest),
        F.pmod(F.xxhash64(F.lit(1), quoted(id_col)), F.lit(salts)).alias(salt),
        quoted(text_col).alias(text),
        row_order(docs.drop(text_col), id_col).alias(order),
        F.struct(*[quoted(c) for c in others]).alias(rest),
    )
    winner = [F.min(order).alias(order), F.min_by(rest, order).alias(rest)]
    salted = rows.groupBy(digest, salt, text).agg(*winner)
    last = salted.groupBy(digest, text).agg(*winner)
    return last.select(*[quoted(text).alias(c) if c == text_col else F.col(rest).getField(c).alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


OP5_SQL = """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id NULLS LAST, lang NULLS FIRST, source NULLS FIRST, n_chars NULLS FIRST) AS nth FROM documents
) WHERE nth = 1
"""
