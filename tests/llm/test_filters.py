"""Quality rules, exact and near dedup, mixing and the pipeline, against brute force and on odd tables."""

import math
import random
import re
from collections import Counter

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from verdigris.llm import mixing, quality, simhash_dedup
from verdigris.llm.bpe import VOCABULARY, Encoder, Vocabulary
from verdigris.llm.exact_dedup import OP5_SQL, exact_dedup


def junk(texts):
    return [" ".join(w + "###$$$" for w in t.split()) for t in texts]


@pytest.fixture(scope="module")
def corpus(prose):
    en, junky, short = prose(60), junk(prose(4, seed=1)), [t[:20] for t in prose(10, seed=2)]
    other = ["ñó " + t.replace("th", "ß") for t in prose(20, seed=3)]
    texts = en + junky + short + other + [None, "", en[0], en[0]]
    langs = ["en"] * (len(en) + len(junky) + len(short)) + ["de"] * 15 + [None] * 5 + ["en"] * 4
    return texts, langs


@pytest.mark.parametrize("room", [quality.MODEL_GRAMS, 3000])
def test_perplexities_are_those_of_brute_force(make, corpus, room):
    """With room for every n-gram, and for few of them."""
    texts, langs = corpus
    want = brute.quality(list(zip(texts, langs)), room)
    out, c = quality.perplexities(make(texts, langs=langs), ["h1"], model_grams=room)
    got = {r.h1: r for r in out.select("h1", *[F.col(x).alias(n) for n, x in c.items()]).collect()}
    for i, (*figures, kept) in enumerate(want):
        r = got[i]
        mine = (r.perplexity, r.lower, r.upper, r.word_info, r.word_lower, r.word_upper)
        if figures[0] is None:
            assert mine == (None,) * 6 and not r.kept
            continue
        for x, y in zip(mine, figures):
            assert abs(math.log(x) * quality.MEAN_UNIT - y) < 2.5
        edge = min(abs(figures[0] - b) for b in figures[1:3] + figures[4:6]) <= 2 or min(abs(figures[3] - b) for b in figures[4:6]) <= 2
        assert edge or r.kept == kept


@pytest.mark.parametrize("room", [0, 700])
def test_perplexities_do_not_depend_on_the_room_for_n_grams(make, corpus, room):
    """those that the arrays don't hold are joined, none is left to backing off."""
    texts, langs = corpus
    texts, langs = [*texts, "日本語 😀", "\x00\x02\x01", "x" * 90_000], [*langs, "en", "en", "xx"]
    seen = []
    for how in ({}, {"room": room}):
        out, c = quality.perplexities(make(texts, langs=langs), ["h1"], **how)
        seen.append(sorted(map(tuple, out.select("h1", *c.values()).collect())))
    assert seen[0] == seen[1]
    want = brute.quality(list(zip(texts, langs)))
    for h1, *figures, kept in seen[1]:
        assert figures[0] is None and want[h1][0] is None or abs(math.log(figures[0]) * quality.MEAN_UNIT - want[h1][0]) < 2.5


@pytest.mark.parametrize("room", [quality.MODEL_GRAMS, 400])
def test_probabilities_add_up(spark, make, prose, room):
    """Of all characters after any context, counted or not, stored or not: 1 with that of a character never seen. So does the model in arrays, by its own lookups."""
    texts = prose(12, words=15) + ["日本語の文", "aaaaaa"]
    model = brute.models([(t, "en") for t in texts], quality.ORDER, room)["en"]
    entries, _ = quality.kneser_ney(quality.count_grams(make(texts).select(F.lit(5).cast("long").alias("seed"), "text")), model_grams=room)
    rows = entries.collect()
    assert len(rows) <= room + 1
    seed, k, hi, lo, logp, back = (np.array([r[c] for r in rows]) for c in ("seed", "k", "hi", "lo", "logp", "back"))
    arrays = quality.Model(quality.entry_hashes(seed, k, hi, lo), logp, back)
    for context in ("", "t", "th", "the ", "zzzz", "日本", "ther"):
        g = [chr(quality.MARK) * (4 - len(context[-4:])) + context[-4:] + x for x in model.letters]
        assert abs(sum(map(model.p, g)) + 1 / (len(model.letters) + 1) * np.prod([model.gamma[y] for k in range(5) if (y := g[0][k:4]) in model.gamma and (not y or y in model.own)]) - 1) < 1e-9
        for x in model.letters[1:]:
            text = context + x
            buf = np.frombuffer(text.encode() + bytes(16), np.uint8)
            grams = quality.Grams(buf, np.array([0, len(buf) - 16]), np.full(1, 5, np.int64), 5)
            want = -sum(math.log(model.p(y)) for y in brute.grams(text, 5))
            assert abs(arrays.information(grams)[0] / quality.UNIT - want) < 1e-4


def test_a_worker_that_holds_little_counts_the_same(make, prose):
    rows = make(prose(40)).select(F.lit(1).cast("long").alias("seed"), "text")
    a, b = (sorted(map(tuple, quality.count_grams(rows, held=n).collect())) for n in (50, 1 << 21))
    assert a == b


def test_junk_goes_and_prose_stays(make, prose):
    """Symbols after words, capitals, lists: common enough to teach the model, and still outside its bands."""
    signs = ["###", "$$$", "%%%", "***"]
    clean = prose(400, words=120)
    bad = junk(prose(12, words=120, seed=9)) + [" ".join(w + signs[(i + len(w)) % 4] for i, w in enumerate(t.split())) for t in prose(40, words=120, seed=8)]
    bad += [t.upper().replace(" ", "!! ") for t in prose(30, words=120, seed=7)] + [" | ".join(t.split()) for t in prose(30, words=120, seed=10)]
    kept = {r.h1 for r in quality.quality_filter(make(clean + bad)).select("h1").collect()}
    assert len(kept & set(range(400))) >= 392 and len(kept) - len(kept & set(range(400))) <= len(bad) // 10


def test_the_same_rows_stay_whatever_the_room_for_n_grams(make, odd, prose):
    """the pipeline's stage, all columns with it."""
    df = make(odd + prose(60) + junk(prose(6, seed=1)))
    a, b = (sorted(map(str, quality.quality_filter(df, **how).collect())) for how in ({}, {"room": 500}))
    assert a == b and 60 <= len(a) < df.count()


def test_exact_dedup(make, odd, prose):
    texts = odd + prose(5) + prose(5)
    ids = [None if i % 4 == 0 else i % 7 for i in range(len(texts))]
    df = make(texts, ids=ids)
    out = exact_dedup(df)
    assert out.columns == df.columns
    rows = out.collect()
    assert Counter(r.text for r in rows) == Counter(set(texts))
    want = {r["text"]: r["doc_id"] for r in brute.exact([{"text": t, "doc_id": i} for t, i in zip(texts, ids)])}
    assert {r.text: r.doc_id for r in rows} == want
    assert exact_dedup(df.limit(0)).count() == 0


def test_exact_dedup_has_the_rows_of_sql(spark, make, prose):
    df = make(prose(20) * 3).select("doc_id", "text", "lang", "source", "n_chars")
    documents = df.toPandas()  # noqa: F841
    want = duckdb.query(OP5_SQL).fetchall()
    got = [tuple(r) for r in exact_dedup(df).select("doc_id", "text", "lang", "source", "n_chars").collect()]
    assert sorted(got) == sorted(want)


def near_copies(texts, seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for t in texts:
        words = t.split()
        for at in rng.choice(len(words), max(1, len(words) // 25), replace=False):
            words[at] = "changed"
        out.append(" ".join(words))
    return out


def words_of(text):
    """As the fingerprints define words, by characters."""
    kana = r"[\u3000-\u9fff\u0e00-\u0eff\U00010000-\U0003ffff]"
    low = "".join(chr(ord(c) + 32) if c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" or "\xc0" <= c <= "\xde" and c != "\xd7" else c for c in text or "")
    return re.findall(rf"{kana}|(?:(?!{kana})[0-9a-z\x80-\U0010ffff])+", low)


def fingerprint(text, bits):
    """One text's, feature by feature, from the definition; hashes of single words are the library's."""
    from verdigris.llm import textops as X

    m, votes = (1 << 64) - 1, [0] * bits
    mix = lambda h: (h := (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & m, h := (h ^ h >> 27) * 0x94D049BB133111EB & m, h ^ h >> 31)[-1]  # noqa: E731, F841
    golden, salt, low = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D, (1 << 44) - 1
    words = []
    for w in words_of(text):
        raw = w.encode()
        words.append(int(X.hash_spans(np.frombuffer(raw + bytes(16), np.uint8), np.array([0]), np.array([len(raw)]))[0]))
    features = {(h & low, 2, "w") for h in words} | {(mix((a * golden + b) & m) & low, 1, "p") for a, b in zip(words, words[1:])}
    for h, weight, _ in features:
        for lane in range(-(-bits // 64)):
            x = mix((h * golden + salt * (2 * lane + 1)) & m)
            for i in range(min(64, bits - 64 * lane)):
                votes[64 * lane + i] += weight if x >> i & 1 else -weight
    return [v > 0 for v in votes], len(set(words))


def kept_of_all_pairs(texts, layout):
    prints, size = zip(*[fingerprint(t, layout.n_bits) for t in texts])
    prints, some = np.array(prints), np.flatnonzero(size)
    d = (prints[some][:, None, :] != prints[some][None, :, :]).sum(axis=2)
    root = brute.components(len(some), [(i, j) for i, j in np.argwhere(d <= layout.max_distance) if i < j])
    return {int(some[i]) for i in range(len(some)) if root[i] == i} | {i for i, n in enumerate(size) if n == 0}


def test_near_dedup_is_that_of_all_pairs(make, prose, odd):
    base = prose(60, words=80)
    texts = base + near_copies(base[:30]) + near_copies(near_copies(base[:10]), 6) + [t for t in odd if t is None or len(t) < 1000]
    df = make(texts)
    rows = simhash_dedup.simhash_dedup(df)
    assert rows.columns == df.columns
    kept = {r.h1 for r in rows.select("h1").collect()}
    assert kept == kept_of_all_pairs(texts, simhash_dedup.layout_for(len(texts)))
    assert kept & set(range(60)) == set(range(60)) and not kept & set(range(60, 100))


def test_order_and_scripts_without_spaces(make, prose):
    """A text's words in another order are another text; a changed character of a Japanese text isn't, nor are texts that share no more than their script."""
    rng = random.Random(4)
    kanji = ["".join(rng.choice("日本語文章検索評価結果方法問題研究計算機学習言語処理") for _ in range(120)) for _ in range(3)]
    text = prose(1, words=150)[0]
    texts = [text, " ".join(reversed(text.split())), kanji[0], kanji[0][:60] + "新" + kanji[0][61:], kanji[1], kanji[2]]
    assert {r.h1 for r in simhash_dedup.simhash_dedup(make(texts)).select("h1").collect()} == {0, 1, 2, 4, 5}


def test_long_texts_in_pieces(prose):
    """A text in pieces has the fingerprint of the whole, also without any space; near copies of very long texts are near."""
    n = simhash_dedup.layout_for(1).n_bits
    for text in (" ".join(f"w{i * 7919 % 1000003}" for i in range(1_300_000)), "語" * 3_000_001, "x" * 9_000_000):
        buf = np.frombuffer(text.encode() + bytes(16), np.uint8)
        size = len(buf) - 16
        got, sizes = simhash_dedup.fingerprints(pa.array([text]), n)
        h, _, _, firsts = simhash_dedup.X.words(buf, np.array([0, size]))
        words, pairs = (np.unique(x & simhash_dedup._LOW) for x in (h, simhash_dedup._pairs(h, np.ones(len(h) - 1, bool))))
        if text[0] != "x":  # one word longer than a piece is cut
            ones = 2 * simhash_dedup._sums(words, 3) + simhash_dedup._sums(pairs, 3)
            want = np.packbits(2 * ones > 2 * len(words) + len(pairs), bitorder="little").view(np.uint64)
            assert (got[0] == want).all() and sizes[0] == len(words)


@pytest.mark.parametrize("n_rows", [1000, 10**9])
def test_recall_at_every_distance(spark, n_rows):
    """Exact up to 23 bits; beyond, as often as promised, in a layout for few rows and in one for many."""
    layout = simhash_dedup.layout_for(n_rows)
    rng = np.random.default_rng(2)
    n, bits = 500, layout.n_bits
    a = rng.integers(0, 2, (n, bits)).astype(np.uint8)
    b = a.copy()
    distance = np.where(np.arange(n) % 2, layout.max_distance, rng.integers(1, layout.max_distance + 1, n))
    for i in range(n):
        b[i, rng.choice(bits, distance[i], replace=False)] ^= 1
    full = np.zeros((2 * n, layout.lanes * 64), np.uint8)
    full[:, :bits] = np.concatenate([a, b])
    prints = np.packbits(full, axis=1, bitorder="little").view(np.int64)
    rows = [(i, [int(x) for x in v]) for i, v in enumerate(prints)]
    edges = {(r.u, r.v) for r in simhash_dedup.near_edges(spark.createDataFrame(rows, "id long, fp array<long>"), layout).collect()}
    found = np.array([(i + n, i) in edges for i in range(n)])
    assert found[distance < 3 * simhash_dedup.SEGMENTS].all() and found[1::2].mean() > simhash_dedup.RECALL - 0.03


def test_a_hot_bucket_is_searched_whole(monkeypatch):
    """Keys of many rows, from leaders and in parts, have the links of all pairs."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2, (4, 192)).astype(np.uint8)
    rows = np.concatenate([centres[rng.integers(0, 4, 300)]])
    for i in range(len(rows)):
        rows[i, 24 + rng.choice(168, rng.integers(0, 24), replace=False)] ^= 1
    prints = np.packbits(rows, axis=1, bitorder="little").view(np.uint64)
    d = np.array([simhash_dedup.distances(p[None, :], prints) for p in prints])
    for most in (simhash_dedup._KEYS_AT_ONCE, 999):
        monkeypatch.setattr(simhash_dedup, "_KEYS_AT_ONCE", most)
        u, v = simhash_dedup.bucket_edges(np.zeros(300, np.int64), np.zeros(300, np.uint64), prints, np.arange(300), 16, 34)
        root = brute.components(300, list(zip(u.tolist(), v.tolist())))
        assert root == brute.components(300, [(i, j) for i, j in np.argwhere(d <= 34) if i < j])


def test_near_dedup_of_odd_tables(make, prose):
    df = make(["same words here"] * 3, ids=[None, 5, 2])
    assert [r.doc_id for r in simhash_dedup.simhash_dedup(df).collect()] == [2]
    twice = df.union(df).drop("m")
    assert simhash_dedup.simhash_dedup(twice).count() == 1
    assert simhash_dedup.simhash_dedup(df.limit(0)).count() == 0
    strings = make(prose(2) * 2).withColumn("doc_id", F.concat(F.lit("k"), 9 - F.col("doc_id")))
    assert sorted(r.doc_id for r in simhash_dedup.simhash_dedup(strings).collect()) == ["k6", "k7"]
    null_ids = make(prose(3), ids=[None, None, None])
    assert simhash_dedup.simhash_dedup(null_ids).count() == 3


@pytest.mark.parametrize("weights", [None, {"src0": 3.0, "src1": 1.0, None: 0.5, "src9": 0.0}, {"src0": 1.0, "src1": 2.0**-40, None: 1e-3}])
def test_mixing_is_that_of_brute_force(make, prose, weights):
    texts = prose(60, words=12) + [None, "", "one"]
    sources = [None if i % 11 == 0 else f"src{i % 3}" for i in range(63)]
    df = make(texts, sources=sources)
    mixed, c = mixing.mix_sources(df, weights, block_tokens=50)
    got = sorted((r.s, str(r.source), r.doc_id) for r in mixed.select(F.col(c["slot"]).alias("s"), "source", "doc_id").collect())
    want = brute.mixture([{"doc_id": i, "text": t, "source": s} for i, (t, s) in enumerate(zip(texts, sources))], weights, mixing.ALPHA, 50, mixing.SEED, mixing.MAX_EPOCHS)
    assert got == sorted((a, str(b), d) for a, b, d in want)


def test_mixing_of_odd_tables(make, odd):
    df = make(odd, ids=[None] * len(odd), sources=[None, "a"] * 7)
    out = mixing.mixture_stage(df)
    assert out.columns == df.columns
    assert {r.h1 for r in out.select("h1").collect()} == set(range(len(odd)))
    assert mixing.mixture_stage(df.limit(0)).count() == 0


def test_mixture_follows_its_weights(make, prose):
    """One large source and small ones, some below a block: shares of tokens are the weights'."""
    texts = prose(400, words=20)
    df = make(texts, sources=["a"] * 340 + ["b"] * 50 + ["c"] * 8 + ["d"] * 2)
    weights = {"a": 0.9, "b": 0.07, "c": 0.025, "d": 0.005}
    mixed, c = mixing.mix_sources(df, weights, block_tokens=100, max_epochs=40)
    n = Counter()
    for r in mixed.select("source", F.col(c["tokens"]).alias("n")).collect():
        n[r.source] += r.n
    total = sum(n.values())
    assert all(0.75 < n[k] / total / w < 1.3 for k, w in weights.items()), n


def test_no_source_is_lost_and_repeats_are_bounded(make, prose):
    df = make(prose(60, words=20), sources=["a"] * 30 + ["b"] * 25 + ["c"] * 5)
    mixed, _ = mixing.mix_sources(df, {"a": 1.0, "b": 2.0**-33, "c": 50.0}, block_tokens=60)
    n = Counter(r.h1 for r in mixed.select("h1").collect())
    assert set(n) == set(range(60)) and max(n.values()) <= mixing.MAX_EPOCHS
    assert max(n[i] for i in range(30, 55)) <= 2 and min(n[i] for i in range(55, 60)) > 1


def test_equal_rows_have_places_of_their_own(make, prose):
    df = make(prose(10))
    three = df.union(df).union(df)
    n = Counter(r.h1 for r in mixing.mixture_stage(three).select("h1").collect())
    assert set(n) == set(range(10)) and min(n.values()) >= 3


def test_mixing_has_the_rows_of_sql(make, prose):
    df = make(prose(50, words=3000), sources=[None if i % 13 == 0 else f"src{i * i % 4}" for i in range(50)]).select("doc_id", "source", "text")
    documents = df.toPandas()  # noqa: F841
    at = mixing.placements(df).select("slot", "source", "nth", "id", "start", "tokens").collect()
    assert sorted(map(str, map(tuple, at))) == sorted(map(str, duckdb.query(mixing.OP2_SQL).fetchall()))


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, make, odd, name, stage):
    df = make(odd, ids=[None, 1, 1] + [None] * (len(odd) - 3), langs=[None, "en"] * 7, sources=[None] * 14)
    for docs in (df, df.limit(0)):
        out = stage(spark, docs, "")
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == docs.columns
        rows = out.collect()
        assert len(rows) <= mixing.MAX_EPOCHS * docs.count()


def test_pipeline_is_that_of_brute_force(spark, prose, tmp_path):
    base = prose(120, words=80)
    texts = base + base[:10] + near_copies(base[10:20]) + junk(prose(5, words=80, seed=4)) + [None, "", "short one"]
    rows = [{"doc_id": i, "text": t, "lang": "en", "source": f"src{i % 2}", "n_chars": None if t is None else len(t)} for i, t in enumerate(texts)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = Counter((r.doc_id, tuple(r.tokens)) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())

    kept = [r for r, q in zip(rows, brute.quality([(r["text"], r["lang"]) for r in rows])) if q[-1]]
    kept = sorted(brute.exact(kept), key=lambda r: r["doc_id"])
    stay = kept_of_all_pairs([r["text"] for r in kept], simhash_dedup.layout_for(len(kept)))
    kept = [r for i, r in enumerate(kept) if i in stay]
    text = {r["doc_id"]: r["text"] for r in kept}
    encoder = Encoder(Vocabulary.read(VOCABULARY))
    want: Counter = Counter()
    for _, _, doc in brute.mixture(kept, None, mixing.ALPHA, mixing.BLOCK_TOKENS, mixing.SEED, mixing.MAX_EPOCHS):
        want[doc, tuple(next(encoder.encode_column(pa.array([text[doc]])))[0].tolist())] += 1
    assert got == want
