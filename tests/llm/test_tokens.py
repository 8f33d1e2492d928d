"""BPE, wavelet files and shards: exact round trips, and odd tables."""

import base64

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from verdigris.llm import bpe, sharding, wavelet


def reference(path):
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module", params=["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"])
def pair(request):
    path = "/opt/tokenizers/" + request.param
    return bpe.Encoder(bpe.Vocabulary.read(path)), reference(path)


def encoded(encoder, texts):
    out = []
    for ids, firsts, intact in encoder.encode_column(pa.array(texts, pa.string())):
        assert intact.all()
        out += [ids[a:b].tolist() for a, b in zip(firsts[:-1], firsts[1:])]
    return out


def test_encoding_is_exact(pair, odd, prose):
    encoder, ref = pair
    texts = [t or "" for t in odd] + prose(100) + ["it's 's we'll 'RE x'll", "a\n\n b \t　c  ", "½Ⅷ²", "ab" * 5000, "日本" * 300, "<|endoftext|>"]
    assert encoded(encoder, texts) == [ref.encode_ordinary(t) for t in texts]


@given(st.lists(st.text(alphabet=st.sampled_from("abethin's \n\t.,0é日😀AB'"), max_size=60), max_size=5))
@settings(max_examples=150, deadline=None)
def test_encoding_is_exact_for_any_text(texts):
    encoder, ref = test_encoding_is_exact_for_any_text.pair
    assert encoded(encoder, texts) == [ref.encode_ordinary(t) for t in texts]


test_encoding_is_exact_for_any_text.pair = (bpe.Encoder(bpe.Vocabulary.read(bpe.VOCABULARY)), reference(bpe.VOCABULARY))


def test_a_forgetful_encoder_is_exact(prose):
    v = bpe.Vocabulary.read(bpe.VOCABULARY)
    texts = prose(50)
    assert encoded(bpe.Encoder(v, remembered=1), texts) == encoded(bpe.Encoder(v), texts)


def test_texts_come_back(make, odd, prose):
    df = make(odd + prose(20))
    out, c = bpe.encode_texts(df)
    assert out.columns[: len(df.columns)] == df.columns
    back, text = bpe.decode_tokens(out, column=c["tokens"])
    rows = back.select("text", F.col(text).alias("back"), F.col(c["n_tokens"]).alias("n"), F.col(c["intact"]).alias("ok"), F.col(c["tokens"]).alias("t")).collect()
    assert len(rows) == df.count() and all(r.text == r.back and r.ok for r in rows)
    assert all((r.t is None) == (r.text is None) and r.n == len(r.t or []) for r in rows)
    assert bpe.encode_texts(df.limit(0))[0].count() == 0
    with pytest.raises(Exception, match="outside the vocabulary"):
        bpe.decode_tokens(df.sparkSession.createDataFrame([([10**6],)], "tokens array<int>"))[0].collect()


@pytest.mark.parametrize("n,bits", [(0, 5), (1, 5), (1000, 5), (wavelet.BLOCK_BITS, 3), (wavelet.BLOCK_BITS * 2 + 77, 9)])
def test_wavelet_lookups(n, bits):
    rng = np.random.default_rng(n)
    a, firsts = rng.zipf(1.3, n) % (1 << bits), np.array([0, n // 3, n // 3, n])
    w = wavelet.TokenFile(wavelet.pack(a, firsts, [5, None, 7], bits))
    assert (w.access(np.arange(n)) == a).all() and w.doc_ids == [5, None, 7]
    lo, hi = n // 5, n - n // 7
    for t in (0, 1, 3, 2**bits - 1, 2**bits + 5):
        assert w.count(t)[0] == (a == t).sum() and w.count(t, lo, hi)[0] == (a[lo:hi] == t).sum()
        assert (w.occurrences(t) == np.flatnonzero(a == t)).all()
        assert (w.occurrences(t, lo, hi) == lo + np.flatnonzero(a[lo:hi] == t)).all()
    assert [w.document(k).tolist() for k in range(3)] == [a[: n // 3].tolist(), [], a[n // 3 :].tolist()]
    if n:
        assert w.document_at([0, n - 1]).tolist() == [0 if n >= 3 else 2, 2]
        with pytest.raises(IndexError):
            w.access(n)
    with pytest.raises(ValueError):
        wavelet.TokenFile(b"something else")


def test_shards_hold_every_document(make, odd, prose):
    texts = odd + prose(30)
    ids = [None if i % 9 == 0 else i for i in range(len(texts))]
    df = make(texts, ids=ids).repartition(3)
    rows = wavelet.token_shards(df, shard_tokens=500).collect()
    ref, got = reference(bpe.VOCABULARY), []
    for r in rows:
        w = wavelet.TokenFile(bytes(r.data))
        assert (w.n, w.n_docs, w.doc_ids) == (r.n_tokens, r.n_docs, list(r.doc_ids))
        got += [(d, tuple(w.document(k).tolist())) for k, d in enumerate(w.doc_ids)]
    want = [(i, tuple(ref.encode_ordinary(t or ""))) for i, t in zip(ids, texts)]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert sum(r.n_bytes for r in rows) == sum(len((t or "").encode()) for t in texts) and len({r.shard for r in rows}) == len(rows) > 3
    assert wavelet.token_shards(df.limit(0)).count() == 0


def test_byte_shards(make, odd, prose):
    texts = odd + prose(40) + prose(2)
    df = make(texts, ids=[None if i % 13 == 0 else i // 2 for i in range(len(texts))])
    rows = sharding.shard_by_bytes(df, 20_000).collect()
    total = sum(len((t or "").encode()) for t in texts)
    n = -(-total // 20_000)
    width = -(-total // n)
    at = 0
    for r in sorted(rows, key=lambda r: r.start_byte):
        assert r.start_byte == at and r.shard == min(r.start_byte // width, n - 1)
        at += r.n_bytes
    assert at == total and len(rows) == len(texts)
    ordered = sorted(rows, key=lambda r: (r.start_byte, r.n_bytes > 0))
    ids = [(r.doc_id is not None, r.doc_id or 0) for r in ordered if r.n_bytes]
    assert ids == sorted(ids)
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0
    assert {r.shard for r in sharding.shard_by_bytes(make([None, ""])).collect()} == {0}


def test_byte_shards_have_the_rows_of_sql(make, prose):
    df = make(prose(50)).select("doc_id", "text")
    documents = df.toPandas()  # noqa: F841
    want = sorted(duckdb.query(sharding.OP8_SQL).fetchall())
    assert sorted(tuple(r) for r in sharding.shard_by_bytes(df).collect()) == want
