"""Search through whole documents against the joins of postings and against loops."""

import random

import pyarrow as pa

import __spark_entry__ as entry
from verdigris.operators import fulltext, scan

TEXTS = ["the rate limit is low", "limit the rate", "", None, "rate limit rate limit the", "Low and limit", "the the the"] + [" ".join(random.Random(i).choices("the rate limit low and or".split(), k=i % 9)) for i in range(60)]
ASKED = [(0, "rate-limit"), (1, "limit rate"), (2, "limit %%%"), (3, ""), (4, None), (5, "the rate-limit the"), (6, "And low"), (7, "absent the"), (8, "the-the the")]


def _tables(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string"), spark.createDataFrame(ASKED, "query_id bigint, query string")


def _rows(df):
    return sorted(map(tuple, df.collect()))


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_phrase_hits_of_texts(spark):
    docs, q = _tables(spark)
    asked = fulltext.plain_phrases(q)
    got = fulltext.phrase_hits_of(asked, fulltext.tokenized(docs))
    assert _rows(got) == _rows(fulltext.phrase_hits(asked, fulltext.postings(docs))) and got.count() > 50


def test_whole_passages_move_no_postings(spark):  # F1
    plan = _plan(entry.queries()["fts_phrase"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan and "Join" not in plan


def test_slices_are_the_documents():
    lists = [[1] * n for n in (0, 3, 0, 5, 2, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array([["x"] * len(x) for x in lists])], names=["terms"]).slice(1)
    was, scan.SLICE_TERMS = scan.SLICE_TERMS, 4
    try:
        got = [(row, len(flat), lens.tolist()) for row, flat, lens in scan._slices(batch)]
    finally:
        scan.SLICE_TERMS = was
    assert got == [(0, 3, [3, 0]), (2, 5, [5]), (3, 2, [2, 0])]


def test_blocks_keep_queries_whole(spark, monkeypatch):
    docs, q = _tables(spark)
    asked, split = fulltext.plain_phrases(q), fulltext.tokenized(docs)
    want, scores = _rows(fulltext.match_texts(asked, split)), _rows(fulltext.bm25(asked, split))
    monkeypatch.setattr(scan, "BLOCK_TERMS", 3)
    made = list(scan.blocks(asked))
    assert len(made) > 2 and sorted(i for b in made for i in b.ids) == sorted(set(r.query_id for r in asked.collect()))
    assert _rows(fulltext.match_texts(asked, split)) == want and _rows(fulltext.bm25(asked, split)) == scores


def test_hybrid_writes_no_texts(spark, monkeypatch):  # F2, F3
    from verdigris.plans import pipeline
    from verdigris.sources import shared

    names = []
    for module in (pipeline, fulltext):
        monkeypatch.setattr(module, "written", lambda df, name: names.append((name, df.columns)) or shared.written(df, name), raising=False)
    docs, q = _tables(spark)
    vecs = spark.createDataFrame([(1, [1.0, 0.0])], "id bigint, v array<float>")
    found = pipeline.candidates(q, docs, vecs, vecs.withColumnRenamed("id", "query_id"), 2)
    assert found.count() and all("terms" not in c for _, c in names)
    assert "posexplode" not in _plan(found)


def test_rerank_moves_the_texts_of_hits_alone(spark, monkeypatch):  # F3
    from verdigris.operators import rerank

    docs, q = _tables(spark)
    hits = spark.createDataFrame([(1, "0", 0), (1, "1", 1), (6, "5", 0), (6, "none", 1)], "query_id bigint, doc_id string, in_rank bigint")
    few = rerank.rerank(hits, q, docs, rerank.overlap_scorer)
    assert "LeftSemi" in _plan(few)
    monkeypatch.setattr(rerank, "BROADCAST_IDS", 0)
    many = rerank.rerank(hits, q, docs, rerank.overlap_scorer)
    assert "LeftSemi" not in _plan(many) and _rows(few.select(*sorted(few.columns))) == _rows(many.select(*sorted(many.columns))) and few.count() == 4


def test_passages_are_words_not_syntax(spark):  # F5, F6
    docs = spark.createDataFrame([(1, "low limit"), (2, "and low limit")], "doc_id bigint, text string")
    q = spark.createDataFrame([(0, "And low limit"), (1, "low - limit")], "query_id bigint, query string")
    asked = fulltext.plain_phrases(q)
    assert {(r.grp, *r.terms) for r in asked.filter("query_id = 0").collect()} == {(0, "and"), (1, "low"), (2, "limit")}
    scores = fulltext.bm25(asked, fulltext.tokenized(docs)).collect()
    assert [(r.query_id, r.doc_id) for r in scores] == [(0, 2)] and scores[0].score != round(scores[0].score, 9)
    from verdigris.plans.search_queries import asked as passages

    first = passages(spark, "/root/testdata/sf0.1").filter("query_id = 36")
    assert fulltext.plain_phrases(first).count() == len(first.first().query.split()) > fulltext.phrases(first).count()


def test_match_of_texts(spark):  # F7
    docs, q = _tables(spark)
    asked = fulltext.plain_phrases(q)
    got = fulltext.match_texts(asked, fulltext.tokenized(docs))
    assert _rows(got) == _rows(fulltext.match_all(asked, fulltext.postings(docs))) and got.count() > 20
    plan = _plan(entry.queries()["fts_match_and"](spark, "/root/testdata/sf0.001"))
    assert "posexplode" not in plan and "Join" not in plan


def test_words_that_cancel_out_have_a_unit_vector(spark):  # F4
    import zlib

    from verdigris.operators import encode

    ahead = zlib.crc32("検索文書:".encode())
    word = next(w for w in map(str, range(10000)) if (h := zlib.crc32(w.encode())) % 64 == ahead % 64 and h >> 31 != ahead >> 31)
    docs = spark.createDataFrame([(0, word), (1, "x"), (2, "")], "doc_id bigint, text string")
    made = encode.embed_documents(docs, encode.HashingEncoder).collect()
    assert [round(sum(x * x for x in r.embedding), 4) for r in made] == [1.0, 1.0, 1.0]
    assert not encode.HashingEncoder().encode([" "]).any()


def test_only_what_nfkc_may_change_goes_to_python(spark):  # F8, F9
    import unicodedata

    from verdigris.functions import text as T

    may = lambda x: any(c not in T._inert() for c in x if not c.isascii())
    assert not may("Écoute, ça va? Größe ñandú “Привет” カナ")
    assert all(may(x) for x in ("e\u0301", "ﬁ", "Ａ", "か\u3099", "½", "\u1100\u1161", "…", "\u00a0", "𝐀"))
    assert len(T._inert()) > 800 and all(unicodedata.normalize("NFKC", a + c) == unicodedata.normalize("NFKC", a) + c for a in "aeかᄀ가ά" for c in T._inert())
    some = spark.createDataFrame([("a",), ("Écran",), ("e\u0301",), ("ﬁ",)], "t string").select(T._may_fold(T.F.col("t")).alias("m"))
    assert [bool(r.m) for r in some.collect()] == [False, False, True, True]
    texts = ["ÀB Écran", "A\u0301B", "ＡB", "ÇÀ  É\tx", "ΆΒΓ", None, ""]
    got = [r.n for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.normalize(T.F.col("t")).alias("n")).orderBy("i").collect()]
    lower = str.maketrans(T._UPPER, T._LOWER)
    assert got == [None if t is None else " ".join(unicodedata.normalize("NFKC", t).translate(lower).split()) for t in texts]


def test_term_counts_row_by_row(spark):  # F10
    from collections import Counter

    rows = [(1, "banana ananas"), (2, "aaaa"), (2, "Aaab"), (3, "ab"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "p_partkey bigint, p_name string")
    got = {(r.doc_id, r.term): r.n for r in fulltext.term_counts(docs, "p_partkey", "p_name", trigram=True).collect()}
    assert got == Counter((i, t.lower()[k : k + 3]) for i, t in rows if t for k in range(len(t) - 2))
    words = {(r.doc_id, r.term): r.n for r in fulltext.term_counts(docs, "p_partkey", "p_name").collect()}
    assert words == Counter((i, w) for i, t in rows if t for w in t.lower().split())
    plan = _plan(entry.queries()["fts_trigrams"](spark, "/root/testdata/sf0.001"))
    assert plan.index("Generate explode") < plan.index("Exchange")  # trigrams come after the shuffle
