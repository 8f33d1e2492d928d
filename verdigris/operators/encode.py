"""Embedding: encoders as plug-ins, masks, masked mean pooling.

The reference's neural weights can't be had offline; what surrounds them is
here, and HashingEncoder stands in for the network: deterministic, and equal on
any machine.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.config import CHUNK_OVERLAP, PREFIXES, SPECIAL_TOKENS, max_content
from verdigris.functions.match import let
from verdigris.operators.batching import bucket_of
from verdigris.operators.chunking import plan_chunks
from verdigris.operators.rerank import Lazy

TINY = float(np.finfo(np.float32).tiny)


class Encoder(Protocol):
    dim: int

    def encode(self, texts: list[str]) -> np.ndarray:
        """One row for each text."""
        ...


@dataclass(frozen=True)
class HashingEncoder:
    """Sums of signed unit vectors of words, chosen by CRC, normalized. Words that cancel out are the unit vector of their whole text; a text without words is zero."""

    dim: int = 64

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.split():
                h = zlib.crc32(word.encode())
                out[i, h % self.dim] += 1.0 if h >> 31 else -1.0
            if not out[i].any() and text.strip():
                out[i, zlib.crc32(text.encode()) % self.dim] = 1.0
        return (out / np.maximum(np.sqrt((out * out).sum(1, keepdims=True)), TINY)).astype(np.float32)


@dataclass(frozen=True)
class OneHotEncoder:
    """For tests: the i-th text of a batch is the i-th unit vector."""

    dim: int = 8

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.eye(self.dim, dtype=np.float32)[np.arange(len(texts)) % self.dim]


@dataclass(frozen=True)
class EncoderConfig:
    """The shape of a transformer encoder, checked."""

    hidden_size: int
    num_layers: int
    num_heads: int
    vocab_size: int
    intermediate_size: int
    global_every: int = 3
    local_window: int = 128
    norm_eps: float = 1e-5

    def validate(self) -> EncoderConfig:
        for name in ("hidden_size", "num_layers", "num_heads", "vocab_size", "intermediate_size", "global_every", "local_window"):
            if not 0 < getattr(self, name) < 2**31:
                raise ValueError(f"{name} must be positive and fit 32 bits")
        if self.hidden_size % self.num_heads:
            raise ValueError("hidden_size must be a multiple of num_heads")
        if not (math.isfinite(np.float32(self.norm_eps)) and np.float32(self.norm_eps) > 0):
            raise ValueError("norm_eps must be finite and positive")
        return self


def embed_texts(rows: DataFrame, make: Callable[[], Encoder], prefix: str = PREFIXES["semantic"], text_col: str = "text", out: str = "embedding") -> DataFrame:
    """rows with the embedding of prefix + text. Null texts have null ones; elements that aren't finite are an error."""
    lazy = Lazy(make)

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            some = texts.notna()
            result: list = [None] * len(texts)
            if some.any():
                made = np.asarray(lazy().encode([prefix + t for t in texts[some]]))
                if made.shape[0] != int(some.sum()) or not np.isfinite(made).all():
                    raise ValueError("an encoder returned another shape, or elements that aren't finite")
                for at, vector in zip(np.flatnonzero(some), made):
                    result[at] = vector
            yield pd.Series(result, dtype=object)

    return rows.withColumn(out, run(text_col))


@dataclass(frozen=True)
class Tokenizer:
    """A tokenizer as expressions: a text to its tokens (array of strings), and tokens back to a text. length() is that of a fixed text, for prefixes."""

    split: Callable[[Column], Column]
    join: Callable[[Column], Column]
    length: Callable[[str], int]


#: Words between spaces.
WORDS = Tokenizer(lambda t: F.split(t, " "), lambda p: F.array_join(p, " "), lambda t: len(t.split()))


def embed_queries(queries: DataFrame, make: Callable[[], Encoder], tokenizer: Tokenizer = WORDS) -> DataFrame:
    """queries with embedding; what doesn't fit the model beside the prefix is cut off."""
    prefix = PREFIXES["query"]
    kept = F.slice(tokenizer.split(F.col("query")), 1, max_content(tokenizer.length(prefix)))
    return embed_texts(queries.withColumn("__cut", tokenizer.join(kept)), make, prefix, "__cut").drop("__cut")


def document_chunks(docs: DataFrame, tokenizer: Tokenizer = WORDS, prefix: str = PREFIXES["document"], content: int | None = None, overlap: int = CHUNK_OVERLAP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, chunk_id, chunk_idx, n_tokens, length, text): whole texts in chunks that fit the model beside the prefix; length has prefix and special tokens in it. A null text has none."""
    ahead = tokenizer.length(prefix)
    tokens = docs.select(F.col(id_col).alias("doc_id"), tokenizer.split(F.col(text_col)).alias("tokens")).filter("tokens IS NOT NULL")
    n = F.size("tokens")
    return plan_chunks(tokens, ahead, content, overlap).select("doc_id", "chunk_id", "chunk_idx", n.alias("n_tokens"), (n + ahead + SPECIAL_TOKENS).alias("length"), tokenizer.join(F.col("tokens")).alias("text"))


def embed_documents(docs: DataFrame, make: Callable[[], Encoder], tokenizer: Tokenizer = WORDS, **options) -> DataFrame:
    """docs (doc_id, text) -> (doc_id, chunk_id, chunk_idx, n_tokens, length, bucket, embedding), a row for each chunk. Within a partition chunks of a bucket are encoded one after another, so that batches are of like lengths; no shuffle."""
    chunks = document_chunks(docs, tokenizer, **options).withColumn("bucket", bucket_of(F.col("length")))
    return embed_texts(chunks.sortWithinPartitions("bucket"), make, PREFIXES["document"]).drop("text")


def checked_mask(mask: Column) -> Column:
    """mask, or an error unless it holds 0 and 1 only and at least one 1; an empty one is right."""
    ok = F.forall(mask, lambda x: x.isin(0, 1)) & ((F.size(mask) == 0) | F.exists(mask, lambda x: x == 1))
    return F.when(ok, mask).otherwise(F.raise_error(F.lit("a mask must hold 0 and 1, and some 1")))


def global_mask(mask: Column) -> Column:
    """What is added to attention: nothing where the mask is 1, -1e9 where it is 0."""
    return F.transform(mask, lambda m: (1 - m) * F.lit(-1e9))


def local_mask(length: Column, window: int) -> Column:
    """Row by row: 0 within window // 2 of the diagonal, else minus infinity."""
    at = F.sequence(F.lit(0), length - 1)
    half = window // 2
    return F.transform(at, lambda i: F.transform(at, lambda j: F.when(F.abs(i - j) <= half, F.lit(0.0)).otherwise(F.lit(float("-inf")))))


def mean_pool(states: Column, mask: Column) -> Column:
    """The mean of the states (array of vectors) whose mask is 1, scaled to length 1. A length under the least positive float counts as that; an all-zero mask divides by zero (NaN) and is to be refused before, by checked_mask()."""
    n = F.aggregate(mask, F.lit(0.0), lambda a, m: a + m)
    zero = F.array_repeat(F.lit(0.0), F.size(F.get(states, F.lit(0))))
    pairs = F.zip_with(states, mask, lambda s, m: F.struct(s.alias("s"), m.alias("m")))
    total = F.aggregate(pairs, zero, lambda a, p: F.zip_with(a, p["s"], lambda x, y: x + y.cast("double") * p["m"]))
    return let(n, lambda n: unit(F.transform(total, lambda x: F.when(n != 0, x / n).otherwise(F.lit(float("nan"))))))


def unit(vector: Column) -> Column:
    """The vector scaled to length 1; a length under the least positive float counts as that."""
    length = lambda v: F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(TINY))
    return let(vector, lambda v: let(length(v), lambda n: F.transform(v, lambda x: x / n)))


def pool_rows(rows: DataFrame, group: list[str], vector: str = "embedding", mask: Column | None = None) -> DataFrame:
    """rows with one state each -> (group, i, x): the mean of each group's states whose mask is 1, scaled to length 1, by element. States are added up where they are, so a group may be any share of the rows; only sums are moved. A group without a 1 in its mask has none; a null state counts as masked."""
    kept = rows if mask is None else rows.filter(mask == 1)
    sums = kept.select(*group, F.posexplode(vector).alias("i", "x")).groupBy(*group, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    keys = [f"__{g}" for g in group]
    whole = sums.groupBy(*[F.col(g).alias(k) for g, k in zip(group, keys)]).agg(F.greatest(F.sqrt(F.sum(F.col("x") * F.col("x"))), F.lit(TINY)).alias("__length"))
    on = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(group, keys)]
    return sums.join(whole, on).select(*group, "i", (F.col("x") / F.col("__length")).alias("x"))
