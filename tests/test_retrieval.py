"""The retrieval operators on small tables, against the values that they must give."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from verdigris import config, schemas
from verdigris.functions import match as M
from verdigris.functions import ranking as R
from verdigris.functions import text as T
from verdigris.operators import aggregate, batching, chunking, encode, fulltext, fusion, harness, rerank, vectors
from verdigris.plans import pipeline
from verdigris.sources import tables
from verdigris.streaming import micro_batches

HIT = "query_id bigint, doc_id string, chunk_id string, score double, fts_score double, vector_score double, in_rank bigint"


def hits(spark, rows):
    return spark.createDataFrame([(0, d, c, float(s), f, v, i) for i, (d, c, s, f, v) in enumerate(rows)], HIT)


def listed(df, *cols, order="in_rank"):
    return [tuple(r[c] for c in cols) for r in df.orderBy("query_id", order).collect()]


def fused(spark, rows, cfg=config.Hybrid()):
    return fusion.rrf(spark.createDataFrame([(0, s, d, c, 0.0, r) for s, d, c, r in rows], schemas.CANDIDATES), cfg)


def test_normalize(spark):
    rows = [("ＡＢＣ", "abc"), ("ｱｲｳｴｵ", "アイウエオ"), ("foo　bar", "foo bar"), ("hello！", "hello!"), ("ひらがな", "ひらがな"), (" a\u0085b ", "a b"), ("a\u001cb", "a\u001cb"), ("À", "À"), ("", ""), (None, None)]
    df = spark.createDataFrame(rows, "text string, expected string").withColumn("n", T.normalize(F.col("text"))).withColumn("again", T.normalize(F.col("n")))
    for r in df.collect():
        assert r.n == r.expected and r.again == r.n
    raw = df.select("text", T.normalize(F.col("text"), config.Normalization.disabled()).alias("x")).collect()
    assert all(r.text == r.x for r in raw)
    assert config.Normalization.from_json(None) == config.Normalization.disabled()
    assert config.Normalization.from_json('{"nfkc": true, "lower": false}') == config.Normalization(True, False, True)


def test_terms_and_trigrams(spark):
    r = spark.createDataFrame([("Écran rate-limit 12x",)], "t string").select(T.terms(F.col("t")).alias("a"), T.trigrams(F.lit("abcd")).alias("b"), T.trigrams(F.lit("ab")).alias("c")).first()
    assert r.a == ["ecran", "rate", "limit", "12x"] and r.b == ["abc", "bcd"] and r.c == []


def test_prepare(spark):
    q = spark.createDataFrame([(0, "foo OR bar"), (1, "ＬＯＧＩＮ"), (2, "au login"), (3, "or"), (4, ' "x y" ')], schemas.QUERIES)
    got = {r.query_id: (r.match_query, r.error) for r in fulltext.prepare(q).collect()}
    assert got[0] == ('"foo" AND "or" AND "bar"', None) and got[1] == ('"login"', None) and got[2] == ('"au" AND "login"', None)
    assert got[3] == (None, M.NO_TERMS) and got[4][0] == '"""x" AND "y"""'
    docs = spark.createDataFrame([(1, "authentication login session"), (2, "authorization permission role"), (3, "audit logging trace audit")], "doc_id bigint, text string")
    post = fulltext.postings(docs)
    vocab = fulltext.vocabulary(post)
    expanded = {r.query_id: r.match_query for r in fulltext.prepare(q, vocab).collect()}
    assert expanded[2] == '("audit" OR "authentication" OR "authorization") AND "login"'
    found = fulltext.match_all(fulltext.phrases(q, vocab), post).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(1, 1), (2, 1)}


def test_match_phrases_and_empty_groups(spark):
    docs = spark.createDataFrame([(1, "the rate limit is low"), (2, "limit the rate"), (3, "")], "doc_id bigint, text string")
    q = spark.createDataFrame([(0, "rate-limit"), (1, "limit rate"), (2, "limit %%%"), (3, "")], schemas.QUERIES)
    found = fulltext.match_all(fulltext.phrases(q), fulltext.postings(docs)).collect()
    assert {(r.query_id, r.doc_id) for r in found} == {(0, 1), (1, 1), (1, 2)}


def test_bm25_against_sqlite(spark):
    import sqlite3

    texts = ["apple pie apple", "pie crust and more pie", "banana split", "apple", "crust apple banana pie pie pie", ""]
    db = sqlite3.connect(":memory:")
    db.execute("CREATE VIRTUAL TABLE t USING fts5(content)")
    db.executemany("INSERT INTO t(rowid, content) VALUES (?, ?)", list(enumerate(texts)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for asked in ("apple", "apple pie", "crust", "banana pie"):
        want = {i: s for i, s in db.execute("SELECT rowid, bm25(t) FROM t WHERE t MATCH ?", (" AND ".join(f'"{w}"' for w in asked.split()),))}
        q = spark.createDataFrame([(0, asked)], schemas.QUERIES)
        got = {r.doc_id: r.score for r in fulltext.bm25(fulltext.phrases(q), fulltext.tokenized(docs)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_identifier():
    for name in ("fts_chunks_vocab", "_a1"):
        assert M.check_identifier(name) == name
    for name in ("", "1a", "a-b", "a b", "é"):
        with pytest.raises(M.InvalidVocabTable):
            M.check_identifier(name)


def test_rrf(spark):
    out = fused(spark, [("fts", "d1", None, 0), ("vector", "d1", None, 1), ("fts", "d2", None, 1)])
    assert listed(out, "doc_id", "score") == [("d1", 1 / 60 + 1 / 61), ("d2", 1 / 61)]
    assert listed(fused(spark, [("fts", "d3", None, 0), ("vector", "d1", None, 0)]), "doc_id") == [("d1",), ("d3",)]
    assert listed(fused(spark, [("fts", "d1", None, 0), ("vector", "d2", None, 0)], config.Hybrid(60, {"fts": 1.0, "vector": 0.0})), "doc_id") == [("d1",)]
    assert listed(fused(spark, [("fts", "d1", None, 0)], config.Hybrid(0.0)), "doc_id") == []
    heavy = fused(spark, [("fts", "d1", None, 0), ("fts", "d2", None, 5), ("vector", "d2", None, 0)], config.Hybrid(60, {"fts": 5.0, "vector": 1.0}))
    assert listed(heavy, "doc_id", "score") == [("d2", 5 / 65 + 1 / 60), ("d1", 5 / 60)]
    assert len(listed(fused(spark, [("fts", "d1", "c0", 0), ("fts", "d1", "c1", 1)]), "chunk_id")) == 2
    assert listed(fused(spark, [("fts", "d1", None, 0)], config.Hybrid(float("nan"))), "doc_id") == []
    with pytest.raises(PySparkException):
        fused(spark, [("web", "d1", None, 0)]).collect()


def test_recency(spark):
    rows = [(0.0, 30.0, 1.0), (30.0, 30.0, 0.5), (60.0, 30.0, 0.25), (0.0, 0.0, 0.0), (5.0, -1.0, 0.0), (-5.0, 30.0, 1.0), (float("nan"), 30.0, 1.0)]
    got = spark.createDataFrame(rows, "a double, h double, e double").select("e", R.recency_decay(F.col("a"), F.col("h")).alias("d")).collect()
    assert all(abs(r.e - r.d) < 1e-12 for r in got)
    cand = spark.createDataFrame([(0, "fts", "old", None, 0.0, 0), (0, "fts", "new", None, 0.0, 1), (0, "fts", "none", None, 0.0, 2)], schemas.CANDIDATES)
    ages = spark.createDataFrame([("old", 300.0), ("new", 0.0)], "doc_id string, age_days double")
    out = fusion.rrf_with_recency(cand, ages, config.Recency(0.5, 30.0))
    assert [d for (d,) in listed(out, "doc_id")] == ["new", "old", "none"]
    off = fusion.rrf_with_recency(cand, ages, config.Recency(float("nan"), 30.0))
    assert [d for (d,) in listed(off, "doc_id")] == ["old", "new", "none"]
    chunks = spark.createDataFrame([(0, "fts", "d", "c1", 0.0, 0), (0, "fts", "d", "c0", 0.0, 1)], schemas.CANDIDATES)
    same = fusion.rrf_with_recency(chunks, spark.createDataFrame([("d", 0.0)], "doc_id string, age_days double"), config.Recency(1e17, 30.0))
    assert [c for (c,) in listed(same, "chunk_id")] == ["c1", "c0"]


def test_aggregators(spark):
    h = hits(spark, [("d1", "c0", 0.5, 0.5, None), ("d2", "c0", 0.7, None, None), ("d1", "c1", 0.9, 0.25, 0.5), ("d3", "c0", 0.6, None, None)])
    assert listed(aggregate.max_chunk(h), "doc_id", "score", "chunk_id", "vector_score") == [("d1", 0.9, None, 0.5), ("d2", 0.7, None, None), ("d3", 0.6, None, None)]
    d = hits(spark, [("d1", None, 0.9, None, None), ("d2", None, 0.7, None, None), ("d1", None, 0.5, None, None), ("d3", None, 0.6, None, None), ("d2", None, 0.4, None, None)])
    assert listed(aggregate.dedupe(d), "doc_id", "score") == [("d1", 0.9), ("d2", 0.7), ("d3", 0.6)]
    k = hits(spark, [("d1", None, 1, 1.0, None), ("d1", None, 0.5, None, 1.0), ("d1", None, 0.25, 4.0, None), ("d2", None, 0.5, None, None), ("d2", None, 0.25, None, None), ("d3", None, 0.125, None, None)])
    out = listed(aggregate.top_k_average(2)(k), "doc_id", "score", "fts_score", "vector_score")
    assert out == [("d1", 0.75, 0.5, 0.5), ("d2", 0.375, None, None), ("d3", 0.125, None, None)]
    assert aggregate.top_k_average(0)(k).count() == 0
    assert aggregate.identity(k) is k
    nan = float("nan")
    n = hits(spark, [("d1", "c0", nan, None, None), ("d1", "c1", 0.5, None, None), ("d2", "c0", 0.5, 0.25, None), ("d2", "c1", nan, None, None)])
    assert {(r.doc_id, math.isnan(r.score)) for r in aggregate.max_chunk(n).collect()} == {("d1", True), ("d2", False)}
    parents = {r.doc_id: [x.in_rank for x in r.hits] for r in aggregate.group_by_parent(h).collect()}
    assert parents == {"d1": [0, 2], "d2": [1], "d3": [3]}


def test_hits_as_json(spark):
    h = hits(spark, [("d1", "c0", 0.5, 0.5, None), ("d2", None, 0.25, None, 0.25)])
    back = tables.hits_from_json(tables.hits_to_json(h).select("query_id", "in_rank", "json"))
    cols = ("doc_id", "chunk_id", "score", "fts_score", "vector_score")
    assert listed(back, *cols) == listed(h, *cols)
    old = tables.hits_from_json(spark.createDataFrame([('{"doc_id":"d1","score":0.5,"source_scores":{"fts":0.5}}',)], "json string")).first()
    assert (old.doc_id, old.chunk_id, old.fts_score, old.vector_score) == ("d1", None, 0.5, None)


@given(st.text(alphabet="ab \nあ\U0001f600", max_size=60), st.integers(0, 20))
@settings(max_examples=200, deadline=None)
def test_fragments_are_the_text(text, most):
    parts = chunking.fragments(text, most)
    assert "".join(parts) == text and len(parts) >= 1
    if most >= 4:
        assert all(len(p.encode()) <= most for p in parts)


def test_fragments():
    assert len(chunking.fragments("a" * 20000, 16000)) == 2
    assert chunking.fragments("あいうえおか", 10)[0] == "あいう"
    assert chunking.fragments("", 10) == [""]
    assert chunking.fragments("aa\n\nbb\ncc", 8) == ["aa\n\n", "bb\ncc"]
    assert chunking.fragments("aaaa\nbbbb", 6) == ["aaaa\n", "bbbb"]


def test_split_text_keeps_ids(spark):
    df = spark.createDataFrame([("x", "a" * 9), ("y", None), ("z", "")], "doc_id string, text string")
    assert [(r.doc_id, r.frag_idx, r.n_bytes) for r in chunking.split_text(df, 4).orderBy("doc_id", "frag_idx").collect()] == [("x", 0, 4), ("x", 1, 4), ("x", 2, 1), ("z", 0, 0)]


def test_truncate_and_chunks(spark):
    one = spark.createDataFrame([(list(range(10, 20)),)], "t array<int>")
    assert one.select(chunking.truncate_with_eos(F.col("t"), 4)).first()[0] == [10, 11, 12, 2]
    assert one.select(chunking.truncate_with_eos(F.col("t"), 1)).first()[0] == [2]
    assert one.select(chunking.truncate_with_eos(F.col("t"), 0)).first()[0] == list(range(10, 20))
    for n, content, overlap in ((0, 4, 1), (4, 4, 1), (5, 4, 1), (10, 4, 2), (9, 4, 4), (11, 5, 0)):
        df = spark.createDataFrame([("d", list(range(n)))], "doc_id string, tokens array<int>")
        got = [(r.chunk_id, list(r.tokens)) for r in chunking.plan_chunks(df, content=content, overlap=overlap).orderBy("chunk_idx").collect()]
        want, start = [], 0
        while True:
            end = min(start + content, n)
            want.append((f"c{len(want)}", list(range(start, end))))
            if end >= n or end - overlap <= start:
                break
            start = end - overlap
        assert got == want
    assert config.max_content(10) == 8180 and chunking.shrink_to_fit(lambda a, b: 3 * (b - a), 0, 10, 12) == 4
    with pytest.raises(ValueError):
        chunking.shrink_to_fit(lambda a, b: 99, 0, 3, 12)


def test_batches(spark):
    edges = [(0, 0), (128, 0), (129, 1), (512, 1), (513, 2), (2048, 2), (2049, 3), (8192, 3)]
    df = spark.createDataFrame(edges, "n int, b int")
    assert all(r.b == r.x for r in df.select("b", batching.bucket_of(F.col("n")).alias("x")).collect())
    with pytest.raises(PySparkException):
        spark.createDataFrame([(8193,)], "n int").select(batching.bucket_of(F.col("n"))).collect()
    assert [batching.sub_batch_size(b) for b in config.BUCKET_BOUNDS] == [2000, 500, 125, 31] and batching.sub_batch_size(8192, 5) == 1
    chunks = spark.createDataFrame([("d", i, 100 if i % 2 else 600) for i in range(10)], "doc_id string, chunk_idx int, length int")
    assigned = batching.assign(chunks, 2048 * 2)
    m = batching.metrics(assigned).first()
    assert (m.real_tokens, m.padded_tokens, m.bucket_0, m.bucket_2, m.batch_size, m.max_seq_len) == (3500, 5 * 128 + 5 * 2048, 5, 5, 5, 600)
    assert {r.sub_batch for r in assigned.filter("bucket = 2").collect()} == {0, 1, 2}
    empty = batching.metrics(batching.assign(chunks.limit(0))).first()
    assert empty.padding_ratio == 0 and empty.real_tokens == 0
    rows = spark.createDataFrame([(0, [1, 2, 3], [1, 1, 0]), (0, [4], [1])], "b int, ids array<int>, mask array<int>")
    padded = {tuple(r.ids): (r.padded_ids, r.padded_mask) for r in batching.pad_batches(rows, ["b"], 2, mask="mask").collect()}
    assert padded == {(1, 2, 3): ([1, 2, 3], [1, 1, 0]), (4,): ([4, 0, 0], [1, 0, 0])}
    with pytest.raises(PySparkException):
        batching.pad_batches(spark.createDataFrame([(0, [1, 2], [1])], rows.schema), ["b"], mask="mask").collect()
    with pytest.raises(PySparkException):
        batching.in_order(chunks.limit(3), chunks, ["doc_id", "chunk_idx"]).collect()


def test_encoders_masks_pooling(spark):
    df = spark.createDataFrame([(0, "a b"), (1, None), (2, "")], "i int, text string")
    out = {r.i: r.embedding for r in encode.embed_texts(df, encode.HashingEncoder).collect()}
    assert out[1] is None and abs(np.linalg.norm(out[0]) - 1) < 1e-6
    long = " ".join(f"w{i}" for i in range(10))
    docs = spark.createDataFrame([(0, "a b"), (1, None), (2, ""), (3, long)], "doc_id int, text string")
    made = {(r.doc_id, r.chunk_id): r for r in encode.embed_documents(docs, encode.HashingEncoder, content=6, overlap=2).collect()}
    assert set(made) == {(0, "c0"), (2, "c0"), (3, "c0"), (3, "c1")}
    prefix, words = config.PREFIXES["document"], long.split()
    for chunk, part in (("c0", words[:6]), ("c1", words[4:])):
        assert np.allclose(made[3, chunk].embedding, encode.HashingEncoder().encode([prefix + " ".join(part)])[0])
    assert made[3, "c0"].length == 6 + len(prefix.split()) + 2 and made[3, "c0"].bucket == 0
    q = spark.createDataFrame([(0, "w " * 9000), (1, None)], "query_id int, query string")
    asked = {r.query_id: r.embedding for r in encode.embed_queries(q, encode.HashingEncoder).collect()}
    kept = " ".join(["w"] * (8190 - len(config.PREFIXES["query"].split())))
    assert asked[1] is None and np.allclose(asked[0], encode.HashingEncoder().encode([config.PREFIXES["query"] + kept])[0])
    s = spark.createDataFrame([([[3.0, 0.0], [0.0, 8.0], [9.0, 9.0]], [1, 1, 0])], "s array<array<float>>, m array<int>")
    p = s.select(encode.mean_pool(F.col("s"), encode.checked_mask(F.col("m")))).first()[0]
    assert np.allclose(p, np.array([3, 8]) / math.hypot(3, 8))
    for bad in ([0, 0], [1, 2]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "m array<int>").select(encode.checked_mask(F.col("m"))).collect()
    assert spark.createDataFrame([([],)], "m array<int>").select(encode.checked_mask(F.col("m"))).first()[0] == []
    assert spark.range(1).select(encode.global_mask(F.array(F.lit(1), F.lit(0)))).first()[0] == [0.0, -1e9]
    encode.EncoderConfig(64, 2, 4, 100, 128).validate()
    for bad in (dict(hidden_size=65), dict(num_layers=0), dict(norm_eps=0.0), dict(vocab_size=2**31)):
        with pytest.raises(ValueError):
            encode.EncoderConfig(**(dict(hidden_size=64, num_layers=2, num_heads=4, vocab_size=100, intermediate_size=128) | bad)).validate()
    assert encode.OneHotEncoder(4).encode(["a"] * 5)[4].tolist() == [1, 0, 0, 0]


@pytest.mark.parametrize("metric", vectors.METRICS)
def test_knn_blocks(spark, metric):
    v = np.random.default_rng(0).normal(size=(60, 5)).round(1)
    v[7] = v[3]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<float>")
    got = {}
    for r in vectors.knn(df, df.withColumnRenamed("id", "query_id"), 4, metric, block_rows=16).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id))
    v = v.astype(np.float32).astype(float)
    for q in range(60):
        s = v @ v[q] if metric == "dot" else -np.linalg.norm(v - v[q], axis=1) if metric == "l2" else v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        want = sorted(range(60), key=lambda i: (-round(s[i], 6), i))[:4]
        mine = [i for _, i in sorted(got[q])]
        assert [round(s[i], 6) for i in mine] == [round(s[i], 6) for i in want]


def test_cosine_guards(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([0.0, 0.0], [0.0, 0.0], 1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)]
    got = spark.createDataFrame(rows, "a array<double>, b array<double>, e double").select("e", R.cosine(F.col("a"), F.col("b")).alias("c")).collect()
    assert all(r.e == r.c for r in got)
    for bad in ([1.0], [1.0, float("nan")]):
        with pytest.raises(PySparkException):
            spark.createDataFrame([(bad,)], "v array<double>").select(R.checked_vector(F.col("v"), 2)).collect()


def test_rerank(spark):
    s = spark.createDataFrame([(0, 0, 0.2), (0, 1, 0.9), (0, 2, 0.9), (0, 3, float("nan"))], "query_id bigint, index int, score double")
    assert [r["index"] for r in rerank.sort_results(s).orderBy("rank").collect()] == [3, 1, 2, 0]
    calls = []

    def broken():
        calls.append(1)
        raise RuntimeError("no model")

    lazy = rerank.Lazy(broken)
    for _ in range(2):
        with pytest.raises(RuntimeError):
            lazy()
    assert calls == [1]
    h = hits(spark, [("1", None, 0.5, None, None), ("2", None, 0.4, None, None)])
    q = spark.createDataFrame([(0, "red fox")], schemas.QUERIES)
    docs = spark.createDataFrame([(1, "a dog"), (2, "the red fox")], "doc_id bigint, text string")
    out = rerank.rerank(h, q, docs, rerank.overlap_scorer).orderBy("rank").collect()
    assert [(r.doc_id, r.original_rank) for r in out] == [("2", 1), ("1", 0)] and 0 < out[1].reranker_score < out[0].reranker_score < 1
    plain = rerank.top_k(rerank.rerank(h, q, docs, None), 1).collect()
    assert [r.doc_id for r in plain] == ["1"] and plain[0].reranker_score is None


def test_search_end_to_end(spark):
    docs = spark.createDataFrame([(1, "red fox jumps"), (2, "blue fox"), (3, "red car")], "doc_id bigint, text string")
    vecs = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [0.7, 0.7])], "id bigint, v array<float>")
    q = spark.createDataFrame([(0, "red fox")], schemas.QUERIES)
    out = pipeline.search(q, docs, vecs, spark.createDataFrame([(0, [1.0, 0.0])], "query_id bigint, v array<float>"), 2).orderBy("rank").collect()
    assert [(r.doc_id, r["rank"]) for r in out] == [("1", 0), ("3", 1)]
    assert out[0].fts_score == 1 / 60 and out[1].fts_score is None


def test_harness(spark):
    line = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(5)], "x double, y double")
    f = harness.linear_fit(line).first()
    assert abs(f.slope - 2) < 1e-12 and abs(f.intercept - 1) < 1e-12
    with pytest.raises(PySparkException):
        harness.linear_fit(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], line.schema)).collect()
    assert harness.r_squared(line, F.lit(2.0), F.lit(1.0)).first().r2 == 1
    assert harness.r_squared(line, F.lit(-9.0), F.lit(0.0)).first().r2 < 0
    assert harness.r_squared(spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], line.schema), F.lit(0.0), F.lit(0.0)).first().r2 == 1
    assert harness.upper_median(spark.createDataFrame([(4,), (1,), (3,), (2,)], "v int"), "v").first().upper_median == 3
    a = spark.createDataFrame([("d", "c0", [1.0, 0.0])], "doc_id string, chunk_id string, embedding array<double>")
    b = spark.createDataFrame([("d", "c0", [1.0, float("nan")])], a.schema)
    assert harness.compare_embeddings(a, a).first().cosine_min == 1
    assert tuple(harness.compare_embeddings(a, b).first()) == (1.0, 0.0)
    with pytest.raises(PySparkException):
        harness.compare_embeddings(a, spark.createDataFrame([("d", "c0", [1.0])], a.schema)).collect()
    assert [harness.workload(spark, w).count() for w in ("w1", "w2", "w3")] == [2, 100, 10]


def test_binary_embeddings_and_tensor_headers(spark, tmp_path):
    docs = [[np.array([1.0, 2.0], "f4")], [np.array([3.0], "f4"), np.array([], "f4")]]
    (tmp_path / "e.bin").write_bytes(tables.pack_embeddings(docs))
    got = tables.read_embeddings(spark, str(tmp_path / "e.bin")).orderBy("doc_id", "chunk_idx").collect()
    assert [(r.doc_id, r.chunk_id, r.embedding) for r in got] == [("0", "c0", [1.0, 2.0]), ("1", "c0", [3.0]), ("1", "c1", [])]
    head = b'{"__metadata__":{},"head.dense.weight":{"dtype":"F32","shape":[2,3],"data_offsets":[0,24]}}'
    (tmp_path / "m.safetensors").write_bytes(len(head).to_bytes(8, "little") + head + bytes(24))
    names = tables.tensor_names(spark, str(tmp_path / "m.safetensors"))
    assert [(r.name, r.dtype, list(r["shape"])) for r in names.collect()] == [("head.dense.weight", "F32", [2, 3])]
    assert tables.model_kind(names).first().kind == "reranker"


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(1, "red fox"), (2, "blue")], "doc_id bigint, text string")
    docs.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    q = micro_batches.index_stream(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3
    q = micro_batches.each_batch(stream, lambda d: d.select("doc_id"), str(tmp_path / "b"), str(tmp_path / "ck2"))
    q.processAllAvailable()
    q.stop()
    assert spark.read.parquet(str(tmp_path / "b")).count() == 2


def test_index_gives_the_scores_of_the_texts(spark, tmp_path):
    from verdigris.operators import fulltext

    rows = [(1, "rate-limit the rate limit"), (2, "limit rate"), (3, None), (4, ""), (5, "the a a a the"), (6, "rate limit " * 50)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    q = spark.createDataFrame([(0, "rate-limit"), (1, "the"), (2, "a:a the"), (3, "absent"), (4, None)], "query_id bigint, query string")
    split, asked = fulltext.tokenized(docs), fulltext.phrases(q)
    fulltext.write_index(split, str(tmp_path / "index"), buckets=4)
    post, lengths = fulltext.read_index(spark, str(tmp_path / "index"), asked, buckets=4)
    got = sorted(map(tuple, fulltext.bm25_of(asked, post, lengths).collect()))
    assert got == sorted(map(tuple, fulltext.bm25(asked, split).collect()))
    hits = {(r.query_id, r.doc_id, r.tf) for r in fulltext.phrase_hits(asked, fulltext.postings(docs)).collect()}
    assert hits >= {(0, 1, 2), (0, 6, 50), (1, 1, 1), (1, 5, 2), (2, 5, 2), (2, 1, 1)} and not any(h[0] > 2 or h[:2] == (0, 2) for h in hits)
    assert {(r.query_id, r.doc_id) for r in fulltext.match_all(asked, fulltext.postings(docs)).collect()} == {(0, 1), (0, 6), (1, 1), (1, 5), (2, 5)}


def test_bm25_explodes_documents_once(spark, tmp_path):
    from verdigris.operators import fulltext

    spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    q = spark.createDataFrame([(0, "b")], "query_id bigint, query string")
    plan = fulltext.bm25(fulltext.phrases(q), fulltext.tokenized(spark.read.parquet(str(tmp_path / "d"))))
    text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert text.count("FileScan parquet") <= 3


def test_vocabulary_by_table_name(spark):
    from verdigris.functions import match
    from verdigris.operators import fulltext

    assert fulltext.vocabulary_table(spark, "no_such_table") is None
    with pytest.raises(match.InvalidVocabTable):
        fulltext.vocabulary_table(spark, "a; DROP TABLE b")
    docs = spark.createDataFrame([(1, "to tea to"), (2, "tea"), (3, None), (4, "")], "doc_id bigint, text string")
    fulltext.vocabulary_of(fulltext.tokenized(docs)).createOrReplaceTempView("some_vocab")
    rows = {tuple(r) for r in fulltext.vocabulary_table(spark, "some_vocab").select("term", "docs", "cnt").collect()}
    assert rows == {("to", 1, 2), ("tea", 2, 2)} == {tuple(r) for r in fulltext.vocabulary(fulltext.postings(docs)).collect()}


def test_pooled_rows(spark):
    from pyspark.sql import functions as F

    from verdigris.operators import encode

    rows = [("a", 1, [3.0, 0.0]), ("a", 1, [3.0, 8.0]), ("a", 0, [9.0, 9.0]), (None, 1, [0.0, 0.0]), ("b", 0, [1.0, 1.0]), ("c", 1, None)]
    df = spark.createDataFrame(rows, "g string, m int, embedding array<float>")
    got = {(r.g, r.i): round(r.x, 6) for r in encode.pool_rows(df, ["g"], mask=F.col("m")).collect()}
    assert got == {("a", 0): 0.6, ("a", 1): 0.8, (None, 0): 0.0, (None, 1): 0.0}
