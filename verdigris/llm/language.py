"""Language ID of web pages and plain texts by Bayesian fusion of four kinds of evidence.

- Text: a multinomial model of hashed character trigrams for each language,
  counted over all documents whose language is given. Hashing to 2**BUCKET_BITS
  buckets gives a model of fixed size for each language, however large the
  corpus. Its log likelihood is divided by three, as trigrams overlap. Counts
  are kept in two folds by the text's hash; a document of the corpus is judged
  by the other fold's, so neither it nor its exact copies vouch for themselves.
- The language that the markup declares: its likelihood given the language is
  a table of counts over all pages, of what the text alone says against what is
  declared.
- The suffix of the address and the host: a prior from the pages of the same
  host, smoothed towards its domain's, that towards the suffix's, and that
  towards all pages'. The suffix is a level of this hierarchy and nothing else,
  so no evidence counts twice. A page's own vote is taken out of each level.

The tables are grouped aggregations and the fusion is one expression a page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.common import documents, quoted, table
from verdigris.llm.quality import Grams

BUCKET_BITS = 18
ORDER = 3
#: Languages known at most: those with the most documents, ties by name. It bounds the model that is broadcast, 2 MB a language.
MOST_LANGUAGES = 128
#: Pseudo-counts: of a bucket, of a declaration, and of the wider level of priors.
ALPHA, EVIDENCE_ALPHA, PRIOR_WEIGHT = 0.1, 1.0, 4.0
UNIT = 1e6
_MARKUP = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->|<[^>]*>|&[a-z0-9#]{2,8};"


def page_text(html: Column) -> Column:
    """A page's text: its markup replaced by spaces, none of them at the ends."""
    return F.regexp_replace(F.regexp_replace(html, _MARKUP, " "), r"\A\s+|\s+\z", "")


def declared_language(html: Column) -> Column:
    """The primary subtag of the html element's lang attribute, in lower case; null without one."""
    return F.nullif(F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})\b", 1)), F.lit(""))


def host_of(url: Column) -> Column:
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def domain_of(host: Column) -> Column:
    """The last two labels of a host, three where the suffix is of the kind co.uk; null for a host of one label."""
    return F.nullif(F.regexp_extract(host, r"([^.]+\.(?:(?:ac|co|com|edu|go|gov|ne|net|or|org)\.[a-z]{2}|[^.]+))$", 1), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label of a host; null for a host of one label."""
    return F.when(F.instr(host, ".") > 0, F.substring_index(host, ".", -1))


def fold_of(text: Column) -> Column:
    """The fold in which a text is counted, 0 or 1."""
    return F.pmod(F.xxhash64(text), F.lit(2)).cast("int")


class TextModel:
    """Languages in order, and counts of buckets by fold and language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        """counts: (2, languages, 2**BUCKET_BITS)."""
        self.langs, self.counts = langs, counts

    def logs(self) -> np.ndarray:
        """log p of each bucket in each language, in UNIT: for texts of fold 0 (counted in fold 1), of fold 1, and of neither."""
        n = np.stack([self.counts[1], self.counts[0], self.counts[0] + self.counts[1]]) + ALPHA
        return np.rint(np.log(n / n.sum(axis=2, keepdims=True)) * UNIT).astype(np.int32)


def text_model(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_languages: int = MOST_LANGUAGES) -> TextModel:
    """The model of the languages given, at most most_languages. Rows without a language, or with one beyond these, don't count."""
    known = docs.select(quoted(lang_col).cast("string").alias("lang"), quoted(text_col).cast("string").alias("text")).filter("lang IS NOT NULL")
    langs = sorted(r.lang for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages).collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, str], np.ndarray] = {}
        for batch in batches:
            names = batch.column("lang").dictionary_encode()
            which, names = names.indices.to_numpy(zero_copy_only=False), names.dictionary.to_pylist()
            which = which * 2 + batch.column("fold").to_numpy()
            for a, b, buf, offsets in X.slices(batch.column("text")):
                grams = Grams(buf, offsets, np.zeros(b - a, np.int64), ORDER)
                bucket = (grams.hashes(ORDER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                row = np.repeat(which[a:b], grams.sizes)
                for i in np.unique(row):
                    key = (int(i % 2), names[i // 2])
                    part = np.bincount(bucket[row == i], minlength=1 << BUCKET_BITS)
                    sums[key] = sums[key] + part if key in sums else part
        for (fold, name), n in sums.items():
            some = np.flatnonzero(n)
            size = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(size, fold, np.int32)), pa.array([name] * size, pa.string()), pa.array(some.astype(np.int32)), pa.array(n[some])], names=["fold", "lang", "bucket", "n"])

    counts = np.zeros((2, len(langs), 1 << BUCKET_BITS))
    if langs:
        counted = known.filter(F.col("lang").isin(langs)).withColumn("fold", fold_of(F.col("text")))
        got = counted.filter("text IS NOT NULL").mapInArrow(run, "fold int, lang string, bucket int, n long").groupBy("fold", "lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
        place = {x: i for i, x in enumerate(langs)}
        counts[got["fold"].to_numpy(), [place[x] for x in got["lang"].to_pylist()], got["bucket"].to_numpy()] += got["n"].to_numpy()
    return TextModel(langs, counts)


def text_scores(pages: DataFrame, model: TextModel) -> DataFrame:
    """pages (..., text, held: the fold in which it was counted, or 2) -> without these, with grams (long) and logs (array<double>, one for each language)."""
    langs = len(model.langs)
    shared = pages.sparkSession.sparkContext.broadcast(model.logs())
    names = [c for c in pages.columns if c not in ("text", "held")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs = shared.value
        for batch in batches:
            held = batch.column("held").to_numpy()
            for a, b, buf, offsets in X.slices(batch.column("text")):
                grams = Grams(buf, offsets, np.zeros(b - a, np.int64), ORDER)
                bucket = (grams.hashes(ORDER) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
                at = bucket + (np.repeat(held[a:b].astype(np.int64), grams.sizes) * langs << BUCKET_BITS)
                flat = logs.reshape(-1)
                sums = np.stack([X.segment_sums(flat[at + (i << BUCKET_BITS)].astype(np.int64), grams.firsts) for i in range(langs)], axis=1) / (UNIT * ORDER)
                values = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * langs, langs, dtype=np.int32)), pa.array(sums.ravel()))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], pa.array(grams.sizes), values], names=[*names, "grams", "logs"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name not in ("text", "held"))
    return pages.mapInArrow(run, f"{types}, grams long, logs array<double>")


def _argmax(logs: Column) -> Column:
    """The place of the largest element, the first of equals, from 0."""
    return -F.array_max(F.transform(logs, lambda x, i: F.struct(x.alias("x"), (-i).alias("i")))).getField("i")


def _votes(pages: DataFrame, key: list[str], langs: int, out: str) -> DataFrame:
    """Votes of the text for each language by key, as an array; added up by key and language first."""
    each = pages.filter("vote IS NOT NULL").groupBy(*key, "vote").agg(F.count("*").cast("double").alias("n"))
    seen = F.map_from_entries(F.collect_list(F.struct("vote", "n")))
    return each.groupBy(*key).agg(F.transform(F.sequence(F.lit(0), F.lit(langs - 1)), lambda i: F.coalesce(F.element_at(seen, i), F.lit(0.0))).alias(out))


def identify_languages(pages: DataFrame, model: TextModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", plain: bool = False, counted: bool = False) -> DataFrame:
    """(id_col, lang, probability, text_lang, declared, host) of each page; model is from text_model(), whose languages are those known.

    plain: the texts are no markup; they are judged as they stand, '<' and '&'
    too, and declare nothing. counted: they are texts that the model may have
    counted, which are judged by the fold without them.

    A page without text is judged by the rest; text_lang is then null. Null
    markup and addresses are no evidence; an address without a host falls back
    on all pages' prior, and a host of one label has no domain and suffix.
    Equal posteriors go to the language first by name. Very long texts are
    scored whole, and repeated pages are judged each. Where the model knows no
    language, lang and probability are null. Only the three columns named are
    read, so others can't clash. An empty table gives an empty one.
    """
    langs = model.langs
    html, url = quoted(html_col).cast("string"), quoted(url_col).cast("string")
    text = html if plain else page_text(html)
    given = pages.select(quoted(id_col).alias("id"), (F.lit(None).cast("string") if plain else declared_language(html)).alias("declared"), host_of(url).alias("host"), text.alias("text"))
    if not langs:
        return given.select(F.col("id").alias(id_col), F.lit(None).cast("string").alias("lang"), F.lit(None).cast("double").alias("probability"), F.lit(None).cast("string").alias("text_lang"), "declared", "host")
    n = len(langs)
    thin = text_scores(given.withColumn("held", F.coalesce(fold_of(F.col("text")), F.lit(2)) if counted else F.lit(2)), model)
    thin = thin.withColumn("vote", F.when(F.col("grams") > 0, _argmax(F.col("logs")))).withColumn("domain", domain_of(F.col("host"))).withColumn("suffix", suffix_of(F.col("host")))
    thin = table(thin, "pages")
    joined = thin
    for level, out in (("host", "of_host"), ("domain", "of_domain"), ("suffix", "of_suffix"), ("declared", "of_declared")):
        joined = joined.join(_votes(thin.filter(F.col(level).isNotNull()), [level], n, out), level, "left")
    nothing = F.array_repeat(F.lit(0.0), n)
    for of, out in ((thin, "of_all"), (thin.filter("declared IS NOT NULL"), "all_declared")):
        # one row each, null where no text has a vote
        joined = joined.crossJoin(_votes(of, [], n, out).agg(F.coalesce(F.first(out), nothing).alias(out)))
    joined = joined.crossJoin(thin.agg(F.count_distinct("declared").cast("double").alias("n_declared")))
    mine = lambda i: F.when(F.col("vote") == i, 1.0).otherwise(0.0)
    one = F.when(F.col("vote").isNotNull(), 1.0).otherwise(0.0)
    total = lambda votes: F.aggregate(votes, F.lit(0.0), lambda s, x: s + x) - one

    # one level a select, so that each is computed once
    step = joined.withColumn("t", total("of_all")).withColumn("prior", F.transform("of_all", lambda v, i: (v - mine(i) + PRIOR_WEIGHT / n) / (F.col("t") + PRIOR_WEIGHT)))
    for level in ("of_suffix", "of_domain", "of_host"):
        narrow = F.transform(level, lambda v, i: (v - mine(i) + PRIOR_WEIGHT * F.get("prior", i)) / (F.col("t") + PRIOR_WEIGHT))
        step = step.withColumn("t", total(level)).withColumn("prior", F.when(F.col(level).isNull(), F.col("prior")).otherwise(narrow))
    likely = F.transform("of_declared", lambda v, i: F.log((v - mine(i) + EVIDENCE_ALPHA) / (F.get("all_declared", i) - mine(i) + EVIDENCE_ALPHA * (F.col("n_declared") + 1))))
    step = step.withColumn("l_declared", F.when(F.col("of_declared").isNull(), nothing).otherwise(likely))
    step = step.withColumn("posterior", F.transform("logs", lambda x, i: F.log(F.get("prior", i)) + F.get("l_declared", i) + x))
    best = F.array_max("posterior")
    names = F.array(*[F.lit(x) for x in langs])
    return step.select(
        F.col("id").alias(id_col),
        F.get(names, _argmax(F.col("posterior"))).alias("lang"),
        (1.0 / F.aggregate("posterior", F.lit(0.0), lambda s, x: s + F.exp(x - best))).alias("probability"),
        F.get(names, F.col("vote")).alias("text_lang"),
        "declared",
        "host",
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, doc_id, lang, probability, text_lang, declared, host): every page, and every document as plain text whose source is its host."""
    docs = documents(spark, sf_dir)
    model = text_model(docs)
    ids = lambda page, doc: F.struct(page.cast("bigint").alias("page_id"), doc.cast("bigint").alias("doc_id")).alias("ids")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select(ids(F.col("page_id"), F.lit(None)), "url", "html")
    plain = docs.select(ids(F.lit(None), F.col("doc_id")), F.concat(F.lit("source://"), "source").alias("url"), F.col("text").alias("html"))
    both = identify_languages(pages, model, "ids").union(identify_languages(plain, model, "ids", plain=True, counted=True))
    return both.select("ids.page_id", "ids.doc_id", "lang", "probability", "text_lang", "declared", "host")
