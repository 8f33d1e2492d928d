"""Queries of chunking, batching, pooling and masks. Words between spaces stand for tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.config import BUCKET_BOUNDS, CHUNK_OVERLAP, EOS_ID, TOKEN_BUDGET, max_content
from verdigris.operators import batching, chunking, encode
from verdigris.plans.registry import query
from verdigris.sources.tables import read

FRAGMENT_BYTES, CONTENT, OVERLAP, MOST = 1000, 64, 16, 128


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("tokens"))


_TOKENS = "tok AS (SELECT doc_id, list_transform(string_split(text, ' '), lambda w: length(w)) AS tokens FROM documents)"


@query()
def text_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.split_text(read(spark, sf_dir, "documents"), FRAGMENT_BYTES)


@query("SELECT doc_id, md5(text) AS digest, strlen(text) AS n_bytes FROM documents")
def text_split_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragments of each document end to end: the document."""
    f = chunking.split_text(read(spark, sf_dir, "documents"), FRAGMENT_BYTES)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("frag_idx", "fragment"))), lambda x: x.fragment), "")
    return f.groupBy("doc_id").agg(F.md5(whole).alias("digest"), F.sum("n_bytes").cast("bigint").alias("n_bytes"))


@query(f"WITH {_TOKENS} SELECT doc_id, least(len(tokens), {MOST}) AS n, CASE WHEN len(tokens) > {MOST} THEN list_sum(tokens[1:{MOST - 1}]) + {EOS_ID} ELSE list_sum(tokens) END AS total, CASE WHEN len(tokens) > {MOST} THEN {EOS_ID} ELSE tokens[-1] END AS last FROM tok")
def tok_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _tokens(spark, sf_dir).select("doc_id", chunking.truncate_with_eos(F.col("tokens"), MOST).alias("t"))
    return cut.select("doc_id", F.size("t").cast("bigint").alias("n"), F.aggregate("t", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"), F.element_at("t", -1).cast("bigint").alias("last"))


def chunks_sql(content: int, overlap: int) -> str:
    return f"""{_TOKENS},
starts AS (SELECT doc_id, tokens, len(tokens) AS n, unnest(generate_series(0, CASE WHEN len(tokens) <= {content} THEN 0 ELSE CAST(ceil((len(tokens) - {content}) / {content - overlap}.0) AS BIGINT) END)) AS idx FROM tok),
chunks AS (SELECT doc_id, idx, idx * {content - overlap} AS start, least({content}, n - idx * {content - overlap}) AS length, list_sum(tokens[idx * {content - overlap} + 1 : idx * {content - overlap} + {content}]) AS total FROM starts)"""


@query(f"WITH {chunks_sql(CONTENT, OVERLAP)} SELECT doc_id, 'c' || idx AS chunk_id, idx AS chunk_idx, start, length AS n, total FROM chunks")
def chunk_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = chunking.plan_chunks(_tokens(spark, sf_dir), content=CONTENT, overlap=OVERLAP)
    big = lambda x: F.col(x).cast("bigint")
    return c.select("doc_id", "chunk_id", big("chunk_idx").alias("chunk_idx"), big("start").alias("start"), F.size("tokens").cast("bigint").alias("n"), F.aggregate("tokens", F.lit(0), lambda a, x: a + x).cast("bigint").alias("total"))


@query("SELECT conv_id, turn, 'c' || turn AS chunk_id FROM conversations")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", chunking.chunk_id(F.col("turn")).alias("chunk_id"))


def model_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of production size with their lengths, special tokens included."""
    c = chunking.plan_chunks(_tokens(spark, sf_dir))
    return c.select("doc_id", "chunk_idx", (F.size("tokens") + 2).alias("length"))


_BUCKET = "CASE " + " ".join(f"WHEN length <= {b} THEN {i}" for i, b in enumerate(BUCKET_BOUNDS)) + " END"
_MODEL = f"{chunks_sql(max_content(0), CHUNK_OVERLAP)}, sized AS (SELECT doc_id, idx, length + 2 AS length FROM chunks), put AS (SELECT *, {_BUCKET} AS bucket FROM sized)"
_SIZES = "[" + ", ".join(str(batching.sub_batch_size(b)) for b in BUCKET_BOUNDS) + "]"
_SUB = f"{_MODEL}, sub AS (SELECT *, (row_number() OVER (PARTITION BY bucket ORDER BY doc_id, idx) - 1) // {_SIZES}[bucket + 1] AS sub_batch FROM put)"


@query(f"WITH {_MODEL} SELECT doc_id, idx AS chunk_idx, length, CAST(bucket AS BIGINT) AS bucket FROM put")
def bucket_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = model_chunks(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("length").cast("bigint").alias("length"), batching.bucket_of(F.col("length")).cast("bigint").alias("bucket"))


@query(f"WITH {_MODEL} SELECT " + ", ".join(f"count(*) FILTER (bucket = {i}) AS bucket_{i}" for i in range(4)) + " FROM put")
def bucket_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.histogram(model_chunks(spark, sf_dir))


@query(f"WITH {_SUB} SELECT doc_id, idx AS chunk_idx, CAST(bucket AS BIGINT) AS bucket, CAST(sub_batch AS BIGINT) AS sub_batch FROM sub")
def sub_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = batching.assign(model_chunks(spark, sf_dir), TOKEN_BUDGET)
    return a.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "bucket", "sub_batch")])


@query(
    f"""WITH {_SUB}, each AS (SELECT bucket, sub_batch, sum(length) AS real, count(*) AS n, max(length) AS longest FROM sub GROUP BY ALL)
SELECT CAST(sum(real) AS BIGINT) AS real_tokens, CAST(sum(n * [128, 512, 2048, 8192][bucket + 1]) AS BIGINT) AS padded_tokens, max(n) AS batch_size, max(longest) AS max_seq_len,
{", ".join(f"CAST(coalesce(sum(n) FILTER (bucket = {i}), 0) AS BIGINT) AS bucket_{i}" for i in range(4))}, round(sum(n * [128, 512, 2048, 8192][bucket + 1]) / sum(real), 9) AS padding_ratio FROM each"""
)
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = batching.metrics(batching.assign(model_chunks(spark, sf_dir)))
    return m.withColumn("padding_ratio", F.round("padding_ratio", 9))


@query(
    """WITH t AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations), m AS (SELECT *, max(len(ids)) OVER (PARTITION BY conv_id) AS longest FROM t)
SELECT conv_id, turn, greatest(longest, 16) AS n, CAST(list_sum(ids) AS BIGINT) AS total, len(ids) AS ones FROM m"""
)
def pad_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns padded to the longest of their conversation, 16 at least."""
    t = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.split("text", " "), lambda w: F.char_length(w)).alias("ids"))
    p = batching.pad_batches(t, ["conv_id"], 16)
    total = lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x).cast("bigint")
    return p.select("conv_id", "turn", F.size("padded_ids").cast("bigint").alias("n"), total("padded_ids").alias("total"), total("padded_mask").alias("ones"))


@query(
    """WITH v AS (SELECT label, unnest(generate_series(0, 63)) AS i, unnest(CAST(embedding AS DOUBLE[])) AS x FROM embeddings),
m AS (SELECT label, i, avg(x) AS x FROM v GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS l FROM m GROUP BY label)
SELECT label, i, round(x / l, 6) + 0 AS x FROM m JOIN n USING (label)"""
)
def pool_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of each label as the states of one sequence."""
    pooled = encode.pool_rows(read(spark, sf_dir, "embeddings"), ["label"])
    return pooled.select("label", F.col("i").cast("bigint").alias("i"), (F.round("x", 6) + 0).alias("x"))


@query(
    """WITH p AS (SELECT vec_id, j, CAST(embedding[8 * j + 1 : 8 * j + 8] AS DOUBLE[]) AS s FROM embeddings, (SELECT unnest(generate_series(0, 7)) AS j)),
k AS (SELECT vec_id, unnest(s) AS x, unnest(generate_series(0, 7)) AS i FROM p WHERE j = 0 OR s[1] >= 0),
m AS (SELECT vec_id, i, avg(x) AS x FROM k GROUP BY ALL), n AS (SELECT vec_id, sqrt(sum(x * x)) AS l FROM m GROUP BY vec_id)
SELECT vec_id, i, round(x / l, 6) + 0 AS x FROM m JOIN n USING (vec_id)"""
)
def pool_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each vector cut into eight states; those that begin below zero are masked, but for the first."""
    pieces = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("embedding", 8 * j + 1, F.lit(8)))
    s = read(spark, sf_dir, "embeddings").select("vec_id", pieces.alias("s"))
    mask = F.transform("s", lambda p, j: ((j == 0) | (F.get(p, F.lit(0)) >= 0)).cast("int"))
    pooled = s.withColumn("m", mask).select("vec_id", encode.mean_pool(F.col("s"), encode.checked_mask(F.col("m"))).alias("p"))
    return pooled.select("vec_id", F.posexplode("p").alias("i", "x")).select("vec_id", F.col("i").cast("bigint").alias("i"), (F.round("x", 6) + 0).alias("x"))


@query("SELECT CAST(n AS BIGINT) AS n, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CASE WHEN abs(i - j) <= 2 THEN 0.0::DOUBLE ELSE -1.0::DOUBLE END AS m FROM (SELECT unnest(generate_series(1, 9)) AS n), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS i), LATERAL (SELECT unnest(generate_series(0, n - 1)) AS j)")
def attn_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local masks of window 4 for lengths 1 to 9; minus infinity is given as -1."""
    rows = spark.range(1, 10).select(F.col("id").alias("n"), F.posexplode(encode.local_mask(F.col("id").cast("int"), 4)).alias("i", "row"))
    cells = rows.select("n", F.col("i").cast("bigint").alias("i"), F.posexplode("row").alias("j", "x"))
    return cells.select("n", "i", F.col("j").cast("bigint").alias("j"), F.when(F.col("x") < 0, -1.0).otherwise(F.col("x")).alias("m"))


@query("SELECT doc_id, CAST(n AS BIGINT) AS n, CASE WHEN n > 0 THEN -1e9 ELSE 0.0 END AS least FROM (SELECT doc_id, len(list_filter(string_split(text, ' '), lambda w: length(w) < 3)) AS n FROM documents WHERE len(list_filter(string_split(text, ' '), lambda w: length(w) >= 3)) > 0)")
def mask_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words under three characters as masked: a checked mask of each document, made additive."""
    m = _tokens(spark, sf_dir).select("doc_id", F.transform("tokens", lambda n: (n >= 3).cast("int")).alias("mask")).filter(F.exists("mask", lambda x: x == 1))
    g = m.select("doc_id", encode.global_mask(encode.checked_mask(F.col("mask"))).alias("g"))
    return g.select("doc_id", F.size(F.filter("g", lambda x: x < 0)).cast("bigint").alias("n"), (F.array_min("g") + 0.0).alias("least"))
