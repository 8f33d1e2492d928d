"""Queries of normalization and query preparation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.config import Normalization
from verdigris.functions import match as M
from verdigris.functions import text as T
from verdigris.operators import fulltext
from verdigris.plans.registry import query
from verdigris.schemas import QUERIES as QUERY_SCHEMA
from verdigris.sources.tables import read

_SPACE = r"[\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
NORMAL = f"trim(regexp_replace(translate({{0}}, {_AZ}), '{_SPACE}', ' ', 'g'))"
TERMS = r"regexp_extract_all(strip_accents(lower(" + NORMAL + r")), '[\p{{L}}\p{{N}}\p{{Co}}]+')"


def normal(x: str) -> str:
    return NORMAL.replace("{0}", x)


def terms_sql(x: str) -> str:
    return TERMS.replace("{0}", x).replace("{{", "{").replace("}}", "}")


def _digests(docs: DataFrame, made: Column) -> DataFrame:
    return docs.select("doc_id", made.alias("made")).select("doc_id", F.char_length("made").cast("bigint").alias("n"), F.md5("made").alias("digest"))


@query(f"SELECT doc_id, length({normal('text')}) AS n, md5({normal('text')}) AS digest FROM documents")
def norm_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(read(spark, sf_dir, "documents"), T.normalize(F.col("text")))


@query(f"SELECT doc_id, length(translate(text, {_AZ})) AS n, md5(translate(text, {_AZ})) AS digest FROM documents")
def norm_ascii_lower(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(read(spark, sf_dir, "documents"), T.normalize(F.col("text"), Normalization(nfkc=False, whitespace=False)))


_WS = f"trim(regexp_replace(html, '{_SPACE}', ' ', 'g'))"


@query(f"SELECT page_id, length({_WS}) AS n, md5({_WS}) AS digest FROM pages")
def norm_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.normalize(F.col("html"), Normalization(nfkc=False, lower=False))
    return read(spark, sf_dir, "pages").select("page_id", F.char_length(made).cast("bigint").alias("n"), F.md5(made).alias("digest"))


@query("SELECT doc_id, length(text) AS n, md5(text) AS digest FROM documents")
def norm_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(read(spark, sf_dir, "documents"), T.normalize(F.col("text"), Normalization.disabled()))


_FOLDED = [("ＡＢＣ", "abc"), ("ｱｲｳｴｵ", "アイウエオ"), ("foo　bar", "foo bar"), ("hello！", "hello!"), ("ひらがな", "ひらがな"), ("  a \t b  ", "a b"), ("ÀＡ", "Àa"), ("", "")]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


@query(f"SELECT CAST(i AS BIGINT) AS i, folded FROM {_values([(i, b) for i, (_, b) in enumerate(_FOLDED)], 'i, folded')}")
def norm_nfkc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_FOLDED)], "i bigint, text string")
    return rows.select("i", T.normalize(F.col("text")).alias("folded"))


#: query, what is left of it, why nothing is
ASKED: list[tuple[str | None, str | None, str | None]] = [
    ("NEAR(a b) hello", "hello", None),
    ("NEAR/3(a b c) hello", "hello", None),
    ("NEAR(a b hello", None, M.NO_TERMS),
    ("NEAR((a b) c) hello", "hello", None),
    ("rate-limit", '"rate-limit"', None),
    ("std::io", '"std::io"', None),
    ("^+hello", "hello", None),
    ('unbalanced"', 'unbalanced""', None),
    ("", None, M.EMPTY_INPUT),
    ("   ", None, M.EMPTY_INPUT),
    (None, None, M.EMPTY_INPUT),
    ("foo AND bar", "foo AND bar", None),
    ("foo or bar", "foo or bar", None),
    ("NOT secret", "secret", None),
    ("foo OR", "foo", None),
    ("foo AND OR bar", "foo bar", None),
    ("NOT foo NOT", "foo", None),
    ("AND OR NOT", None, M.NO_TERMS),
    ("foo OR NEAR(bar baz)", "foo", None),
    ("^", None, M.NO_TERMS),
    ("(-foo)", '"-foo"', None),
    ("(foo", "foo", None),
]


def _asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, q) for i, (q, _, _) in enumerate(ASKED)], QUERY_SCHEMA)


@query(f"SELECT CAST(query_id AS BIGINT) AS query_id, sanitized, error FROM {_values([(i, s, e) for i, (_, s, e) in enumerate(ASKED)], 'query_id, sanitized, error')}")
def fts_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = M.sanitize(F.col("query"))
    return _asked(spark).select("query_id", s.alias("sanitized"), M.sanitize_error(F.col("query"), s).alias("error"))


_WORDS = "list_filter(regexp_split_to_array({}, '" + _SPACE + "'), lambda w: w <> '')"
_BARE = "regexp_replace(regexp_replace(w, '^[\\^+\\-]+', ''), '^[()]+|[()]+$', '', 'g')"
_CLEANED = f"list_filter(list_transform({{}}, lambda w: CASE WHEN regexp_matches({_BARE}, '[:-]') AND NOT starts_with({_BARE}, '\"') THEN '\"' || replace({_BARE}, '\"', '') || '\"' ELSE {_BARE} END), lambda w: w <> '')"


def _op(word: str) -> str:
    return f"upper({word}) IN ('AND', 'OR', 'NOT')"


#: The sanitized form of x, for texts without NEAR.
SANITIZED_CTE = f"""
k AS (SELECT id, {_CLEANED.replace('{}', _WORDS.replace('{}', normal('text')))} AS c FROM asked),
d AS (SELECT id, list_filter(c, lambda w, i: NOT {_op('w')} OR (i > 1 AND i < len(c) AND NOT {_op('c[i - 1]')} AND NOT {_op('c[i + 1]')})) AS kept FROM k),
z AS (SELECT id, array_to_string(kept, ' ') AS j FROM d),
sane AS (SELECT id, j || CASE WHEN (length(j) - length(replace(j, '"', ''))) % 2 = 1 THEN '"' ELSE '' END AS s FROM z WHERE j <> '')
"""


@query(f"WITH asked AS (SELECT item_id AS id, text FROM benchmark), {SANITIZED_CTE} SELECT id AS query_id, s AS sanitized FROM sane")
def fts_sanitize(spark: SparkSession, sf_dir: str) -> DataFrame:
    normal = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), T.normalize(F.col("text")).alias("normal"))
    return normal.select("query_id", M.sanitize(F.col("normal")).alias("sanitized")).filter("sanitized IS NOT NULL")


_NEAR = [("NEAR(a b) c", "c"), ("x NEAR/2(a (b) c) d", "x c) d"), ("near(a b", ""), ("a near b", "a near b"), ("NEAR(a) b", "b"), ("NEAR((a b) c", "")]


@query(f"SELECT CAST(i AS BIGINT) AS i, kept FROM {_values([(i, b) for i, (_, b) in enumerate(_NEAR)], 'i, kept')}")
def fts_strip_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_NEAR)], "i bigint, text string")
    return rows.select("i", F.array_join(M.strip_near(M.split_words(F.col("text"))), " ").alias("kept"))


_DANGLING = [("AND foo bar", "foo bar"), ("foo AND bar", "foo AND bar"), ("foo AND OR bar", "foo bar"), ("foo bar NOT", "foo bar"), ("a or b and", "a or b")]


@query(f"SELECT CAST(i AS BIGINT) AS i, kept FROM {_values([(i, b) for i, (_, b) in enumerate(_DANGLING)], 'i, kept')}")
def fts_dangling_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(_DANGLING)], "i bigint, text string")
    return rows.select("i", F.array_join(M.drop_dangling(M.split_words(F.col("text"))), " ").alias("kept"))


@query("""SELECT conv_id, turn, '"' || replace(text, '"', '""') || '"' AS quoted FROM conversations""")
def fts_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", M.quote(F.col("text")).alias("quoted"))


#: Vocabulary of documents.
VOCAB_CTE = f"post AS (SELECT doc_id, unnest(generate_series(0, len(t) - 1)) AS pos, unnest(t) AS term FROM (SELECT doc_id, {terms_sql('text')} AS t FROM documents)), vocab AS (SELECT term, count(DISTINCT doc_id) AS docs, count(*) AS cnt FROM post GROUP BY term)"


@query(f"WITH {VOCAB_CTE} SELECT doc_id, CAST(pos AS BIGINT) AS pos, term FROM post")
def fts_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.postings(read(spark, sf_dir, "documents")).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "term")


@query(f"SELECT doc_id, g AS trigram, count(*) AS n FROM (SELECT doc_id, unnest(list_transform(generate_series(1, length(t) - 2), lambda i: substring(t, i, 3))) AS g FROM (SELECT part_id AS doc_id, lower({normal('name')}) AS t FROM (SELECT p_partkey AS part_id, p_name AS name FROM part)) WHERE length(t) >= 3) GROUP BY ALL")
def fts_trigrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = fulltext.term_counts(read(spark, sf_dir, "part"), "p_partkey", "p_name", trigram=True)
    return counts.select("doc_id", F.col("term").alias("trigram"), "n")


@query(f"WITH {VOCAB_CTE} SELECT * FROM vocab")
def fts_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fulltext.vocabulary_of(fulltext.tokenized(read(spark, sf_dir, "documents")))


SHORT = [(0, "a"), (1, "th the"), (2, "É of"), (3, "zq in"), (4, "or th"), (5, "ａｎ"), (6, "d_ and"), (7, "Qu-e te"), (8, "u AND re")]


def short_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SHORT, QUERY_SCHEMA)


SHORT_CTE = f"""
asked AS (SELECT CAST(id AS BIGINT) AS id, replace(text, 'ａｎ', 'an') AS text FROM {_values(SHORT, 'id, text')}), {SANITIZED_CTE},
words AS (SELECT id AS query_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS grp FROM (SELECT id, string_split(s, ' ') AS w FROM sane)),
short AS (SELECT DISTINCT word FROM words WHERE length(word) < 3 AND NOT {_op('word')}),
found AS (SELECT word, term, row_number() OVER (PARTITION BY word ORDER BY cnt DESC, term) AS nth FROM short JOIN vocab ON starts_with(translate(term, {_AZ}), translate(word, {_AZ})) QUALIFY nth <= {M.VOCAB_LIMIT})
"""


@query(f"WITH {VOCAB_CTE}, {SHORT_CTE} SELECT word, term, CAST(nth AS BIGINT) AS nth FROM found")
def fts_vocab_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = fulltext.vocabulary_of(fulltext.tokenized(read(spark, sf_dir, "documents")))
    words = short_queries(spark).select(T.normalize(F.col("query")).alias("normal")).select(F.explode(M.split_words(M.sanitize(F.col("normal")))).alias("word")).filter(M.is_short(F.col("word")))
    return fulltext.expand_short(words, vocab).withColumn("nth", F.col("nth").cast("bigint"))


_PREPARED = """
g AS (SELECT word, '(' || string_agg('"' || term || '"', ' OR ' ORDER BY nth) || ')' AS part FROM found GROUP BY word)
SELECT query_id, string_agg(coalesce(part, '"' || replace(word, '"', '""') || '"'), ' AND ' ORDER BY grp) AS match_query FROM words LEFT JOIN g USING (word) GROUP BY query_id
"""


@query(f"WITH {VOCAB_CTE}, {SHORT_CTE}, {_PREPARED}")
def fts_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = fulltext.vocabulary_of(fulltext.tokenized(read(spark, sf_dir, "documents")))
    return fulltext.prepare(short_queries(spark), vocab).select("query_id", "match_query")


@query(
    f"""WITH {VOCAB_CTE}, {SHORT_CTE.replace(_values(SHORT, 'id, text'), '(SELECT item_id AS id, text FROM benchmark)')}, {_PREPARED}"""
)
def fts_prepare(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = fulltext.vocabulary_of(fulltext.tokenized(read(spark, sf_dir, "documents")))
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return fulltext.prepare(asked, vocab).filter("error IS NULL").select("query_id", "match_query")


@query(f"WITH asked AS (SELECT item_id AS id, text FROM benchmark), {SANITIZED_CTE}, words AS (SELECT id AS query_id, unnest(w) AS word, unnest(generate_series(0, len(w) - 1)) AS grp FROM (SELECT id, string_split(s, ' ') AS w FROM sane)) SELECT query_id, string_agg('\"' || replace(word, '\"', '\"\"') || '\"', ' AND ' ORDER BY grp) AS match_query FROM words GROUP BY query_id")
def fts_missing_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Preparation by a vocabulary table that isn't there: short words stay as they are."""
    asked = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return fulltext.prepare(asked, fulltext.vocabulary_table(spark, "no_such_vocabulary")).filter("error IS NULL").select("query_id", "match_query")
