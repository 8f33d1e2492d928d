"""Tables, hits as JSON, and embeddings as Parquet or in the compact binary form."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.schemas import CHUNK_EMBEDDINGS, HIT_JSON


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hits_to_json(hits: DataFrame) -> DataFrame:
    """hits (doc_id, chunk_id, score, fts_score, vector_score) -> json: sources that gave nothing are left out."""
    entries = F.array(*[F.struct(F.lit(s).alias("key"), F.col(f"{s}_score").alias("value")) for s in ("fts", "vector")])
    scores = F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))
    return hits.withColumn("json", F.to_json(F.struct("doc_id", "chunk_id", "score", scores.alias("source_scores"))))


def hits_from_json(rows: DataFrame, json_col: str = "json") -> DataFrame:
    """rows with doc_id, chunk_id, score, fts_score, vector_score; what an older text lacks is null."""
    hit = F.from_json(json_col, HIT_JSON)
    return rows.withColumn("hit", hit).select("*", "hit.doc_id", "hit.chunk_id", "hit.score", F.col("hit.source_scores")["fts"].alias("fts_score"), F.col("hit.source_scores")["vector"].alias("vector_score")).drop("hit")


def pack_embeddings(docs: list[list[np.ndarray]]) -> bytes:
    """Little-endian: documents, then for each its chunks, for each its dimension and 32-bit floats."""
    out = [struct.pack("<I", len(docs))]
    for chunks in docs:
        out.append(struct.pack("<I", len(chunks)))
        out += [struct.pack("<I", len(c)) + np.asarray(c, "<f4").tobytes() for c in chunks]
    return b"".join(out)


def unpack_embeddings(data: bytes) -> list[list[np.ndarray]]:
    at = 0

    def number() -> int:
        nonlocal at
        (n,) = struct.unpack_from("<I", data, at)
        at += 4
        return n

    docs = []
    for _ in range(number()):
        chunks = []
        for _ in range(number()):
            n = number()
            chunks.append(np.frombuffer(data, "<f4", n, at))
            at += 4 * n
        docs.append(chunks)
    if at != len(data):
        raise ValueError("bytes are left over")
    return docs


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """Files in the compact form -> (path, doc_id, chunk_id, chunk_idx, embedding)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = [(name, str(d), f"c{c}", c, v.tolist()) for d, chunks in enumerate(unpack_embeddings(data)) for c, v in enumerate(chunks)]
                kinds = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.list_(pa.float32())]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["path", "doc_id", "chunk_id", "chunk_idx", "embedding"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, " + CHUNK_EMBEDDINGS)


def tensor_names(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, dtype, shape) of the tensors that safetensors files name in their headers."""
    head = spark.read.format("binaryFile").load(path).select("path", "content")
    size = F.conv(F.hex(F.reverse(F.substring("content", 1, 8))), 16, 10).cast("int")
    text = F.decode(F.substring(F.col("content"), F.lit(9), size), "UTF-8")
    tensors = F.from_json(text, "map<string,struct<dtype:string,shape:array<bigint>>>")
    return head.select("path", F.explode(tensors).alias("name", "t")).filter("name != '__metadata__'").select("path", "name", "t.dtype", "t.shape")


def model_kind(names: DataFrame) -> DataFrame:
    """(path, kind): reranker where a classification head is among the tensors, embedder where only layers are, else unknown."""
    head, layers = F.bool_or(F.col("name").startswith("head.") | F.col("name").startswith("classifier.")), F.bool_or(F.col("name").contains("layers."))
    return names.groupBy("path").agg(F.when(head, "reranker").when(layers, "embedder").otherwise("unknown").alias("kind"))
