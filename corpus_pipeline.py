"""The corpus pipeline: from documents to the token sequences of a training mixture.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs. All but the last return the columns of documents. Every stage works
on all rows of its input; its operator's docstring says what it does with nulls,
empty texts, ties, repeated rows, empty tables and clashing names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm.bpe import encode_texts
from verdigris.llm.common import documents, quoted, table
from verdigris.llm.exact_dedup import exact_dedup
from verdigris.llm.mixing import mixture_stage
from verdigris.llm.quality import quality_filter
from verdigris.llm.simhash_dedup import simhash_dedup


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose perplexity lies outside their language's bands."""
    return quality_filter(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the order of the mixture; those of sources that fall short of their weight repeat."""
    return mixture_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's tokens in place of its text; intact says that they decode to the very text."""
    out, c = encode_texts(docs)
    others = [quoted(x) for x in docs.columns if x != "text"]
    return out.select(*others, F.col(c["n_tokens"]).alias("n_tokens"), F.col(c["intact"]).alias("intact"), F.col(c["tokens"]).alias("tokens"))


STAGES = [("quality rules", keep_quality), ("exact dedup", drop_copies), ("near dedup", drop_near_copies), ("mixing", mix), ("bpe", encode)]

#: SimHash components and exact BPE merges are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
