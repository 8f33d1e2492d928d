"""Mixing sources to target weights by a low-discrepancy schedule.

Each source's rows are shuffled (by a digest of id and seed) and laid end to
end, and again from the beginning after the last, up to max_epochs times. The
j-th block of a source holds what begins in its tokens [j, j + 1) *
block_tokens of this stream, so that blocks are of equal tokens, those of
sources shorter than a block too. Slot k of the schedule takes the source in
whose share of the cumulative weights the golden-ratio point frac(k * phi)
falls; the j-th slot of a source takes its j-th block.

The schedule ends with the first slot by which every source has been given
whole, or after max_epochs times the slots that all sources fill once; what
sources of tiny weight haven't given by then follows in slots of its own. So no
row is dropped, each occurs max_epochs times at most, and the mixture is at most
that much longer than its sources. Slots of a source beyond its epochs are left
out: there the others' shares grow.

Only (key, tokens) of each row is ranked and joined with the slots; texts are
joined once, to the places found. Nothing is ordered as a whole: tokens before a
row are those of earlier digest buckets of its source (small sums) plus those
before it in its bucket, and ranks of slots are found in the same way from
counts of slot ranges.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm.common import documents, own, quoted, row_key, table, text_of

BLOCK_TOKENS = 65_536
ALPHA = 0.7
SEED = 17
#: 2**32 / golden ratio: k * STEP mod 2**32 are the points frac(k * phi), in integers.
STEP, ONE = 2_654_435_769, 1 << 32
CELLS = 4096
RANGE = 1 << 16
#: Hex digits of the digest that make a bucket of a source: 2**20 of them.
BUCKET_DIGITS = 5
#: Times that a row occurs at most: up to about four, repeats are worth nearly as much as new data (Muennighoff et al. 2023).
MAX_EPOCHS = 4


def n_tokens(text: Column) -> Column:
    """Tokens between white space."""
    return F.regexp_count(text, F.lit(r"[^ \t\n\r]+")).cast("long")


def _prefix(df: DataFrame, key: list[str], by: str, value: str, out: str) -> DataFrame:
    before = Window.partitionBy(*key).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def shares(totals: DataFrame, weights: Mapping[str | None, float] | None, alpha: float, block_tokens: int) -> DataFrame:
    """(src, tokens) -> (src, tokens, blocks, lo, hi): each source's blocks and share [lo, hi) of 2**32, which holds a point at least."""
    spark = totals.sparkSession
    if weights is None:
        weighed = totals.withColumn("w", F.pow(F.greatest("tokens", F.lit(1)).cast("double"), F.lit(alpha)))
    else:
        given = spark.createDataFrame([(("n" if s is None else f"s{s}"), float(w)) for s, w in weights.items()], "src string, w double")
        weighed = totals.join(given, "src").filter("w > 0")
    by, whole = Window.orderBy("src"), Window.partitionBy(F.lit(1))
    cum = weighed.withColumn("c", F.sum("w").over(by.rowsBetween(Window.unboundedPreceding, 0))).withColumn("i", F.row_number().over(by))
    cum = cum.withColumn("all", F.max("c").over(whole)).withColumn("n", F.max("i").over(whole))
    hi = (F.col("i") + F.when(F.col("c") >= F.col("all"), F.lit(ONE) - F.col("n")).otherwise(F.floor(F.col("c") / F.col("all") * (F.lit(ONE) - F.col("n")).cast("double")))).cast("long")
    return cum.withColumn("hi", hi).select("src", "tokens", F.greatest(F.ceil(F.col("tokens") / F.lit(float(block_tokens))), F.lit(1)).cast("long").alias("blocks"), F.coalesce(F.lag("hi").over(by), F.lit(0)).alias("lo"), "hi")


def schedule(sources: DataFrame, max_epochs: int) -> tuple[DataFrame, DataFrame]:
    """(src, tokens, blocks, lo, hi) -> (slot, src, nth), the slots and their ranks in their sources; and (src, slots), how many each source has."""
    spark = sources.sparkSession
    # a share's count of points strays from its mean by a few only
    need = F.max(F.ceil((F.col("blocks") + 8) * F.lit(float(ONE)) / (F.col("hi") - F.col("lo"))))
    of = sources.agg(F.least(need, F.sum("blocks") * max_epochs).cast("long").alias("n"), F.count("*").alias("sources")).first()
    n = int(of.n or 0)
    cells = sources.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {ONE // CELLS}"), F.expr(f"(hi - 1) div {ONE // CELLS}"))))
    points = spark.range(n).select(F.col("id").alias("slot"), F.pmod(F.col("id") * F.lit(STEP), F.lit(ONE)).alias("u")).withColumn("cell", F.expr(f"u div {ONE // CELLS}"))
    placed = points.join(cells, "cell").filter("u >= lo AND u < hi").select("slot", "src", "blocks", F.expr(f"slot div {RANGE}").alias("range"))
    counts = _prefix(placed.groupBy("src", "range").agg(F.count("*").alias("c")), ["src"], "range", "c", "before").drop("c")
    within = placed.withColumn("r", F.row_number().over(Window.partitionBy("src", "range").orderBy("slot")) - 1)
    ranked = table(within.join(counts, ["src", "range"]).select("slot", "src", "blocks", (F.col("before") + F.col("r")).alias("nth")), "slots")
    whole = ranked.filter("nth = blocks - 1").agg(F.max("slot").alias("last"), F.count("*").alias("n")).first()
    last = whole.last if whole.n == of.sources and n else n - 1
    used = ranked.filter(F.col("slot") <= last)
    given = sources.join(used.groupBy("src").agg(F.count("*").alias("given")), "src", "left").select("src", "blocks", F.coalesce("given", F.lit(0)).alias("given"))
    missing = _prefix(given.withColumn("extra", F.greatest(F.col("blocks") - F.col("given"), F.lit(0))), [], "src", "extra", "base")
    rest = missing.filter("extra > 0").withColumn("x", F.explode(F.sequence(F.lit(0).cast("long"), F.col("extra") - 1)))
    rest = rest.select((F.lit(last + 1) + F.col("base") + F.col("x")).alias("slot"), "src", (F.col("given") + F.col("x")).alias("nth"))
    return used.select("slot", "src", "nth").union(rest), given.select("src", F.greatest("given", "blocks").alias("slots"))


def placements(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    alpha: float = ALPHA,
    block_tokens: int = BLOCK_TOKENS,
    seed: int = SEED,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """(h1, h2: the row's key, id, source, slot, nth, start, tokens): where each row of docs stands, without its text; see mix_sources()."""
    text = text_of(docs, text_col)
    source = quoted(source_col).cast("string")
    h1, h2 = row_key(docs)
    src = F.when(source.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), source))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), F.lit(""))))
    thin = docs.select(h1.alias("h1"), h2.alias("h2"), quoted(id_col).alias("id"), source.alias("source"), src.alias("src"), n_tokens(text).alias("tokens"), F.xxhash64(text).alias("th"), digest.alias("digest"))
    thin = table(thin.withColumn("bucket", F.substring("digest", 1, BUCKET_DIGITS)), "thin")
    sums = thin.groupBy("src", "bucket").agg(F.sum("tokens").alias("tokens"))
    sources = table(shares(sums.groupBy("src").agg(F.sum("tokens").alias("tokens")), weights, alpha, block_tokens), "sources")
    slots, given = schedule(sources, max_epochs)
    before = _prefix(sums, ["src"], "bucket", "tokens", "before").drop("tokens")
    within = Window.partitionBy("src", "bucket").orderBy("digest", "id", "tokens", "th", "h1", "h2").rowsBetween(Window.unboundedPreceding, -1)
    placed = thin.withColumn("h", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(before, ["src", "bucket"])
    placed = placed.join(sources.select("src", F.col("tokens").alias("all")).join(given, "src"), "src")
    epochs = F.when(F.col("all") > 0, F.least(F.lit(float(max_epochs)), F.ceil(F.col("slots") * F.lit(float(block_tokens)) / F.col("all")))).otherwise(1.0).cast("int")
    placed = placed.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(epochs, F.lit(1)) - 1)))
    start = F.col("before") + F.col("h")
    placed = placed.withColumn("start", start + F.col("epoch") * F.col("all"))
    # a row without tokens at a source's end stands with its last token
    stands = F.col("epoch") * F.col("all") + F.least(F.col("start") - F.col("epoch") * F.col("all"), F.greatest(F.col("all") - 1, F.lit(0)))
    placed = placed.withColumn("stands", stands).withColumn("nth", F.expr(f"stands div {block_tokens}"))
    return placed.join(slots, ["src", "nth"]).select("h1", "h2", "id", "source", "slot", "nth", "start", "tokens")


def mix_sources(docs: DataFrame, *args, **settings) -> tuple[DataFrame, dict[str, str]]:
    """docs, each row as often as the schedule takes it; and the names of the columns added: slot, nth, start, tokens. Settings are those of placements().

    weights: share of tokens by source (None: null); a source that they don't
    name, or give 0, is left out. By default sources weigh tokens ** alpha.
    Null is a source of its own. A row without text has 0 tokens and stands with
    what surrounds it; a row longer than a block runs over several and stands in
    the first. Ties in the shuffle are ordered by id, size and hashes of the
    text and of the row, so only equal rows tie; each of them has a place of its
    own. A key of 128 bits leads from places to rows. Columns added take names
    that docs doesn't have. An empty table gives an empty one.
    """
    a, b, row, slot, nth, start, tokens = own(docs, "h1", "h2", "row", "slot", "nth", "start", "tokens")
    at = placements(docs, *args, **settings)
    h1, h2 = row_key(docs)
    # equal rows are combined where they are read: each place joins one row
    each = docs.select(h1.alias(a), h2.alias(b), F.struct(*[quoted(c) for c in docs.columns]).alias(row)).groupBy(a, b).agg(F.first(row).alias(row))
    at = at.select(F.col("h1").alias(a), F.col("h2").alias(b), *[F.col(x).alias(y) for x, y in (("slot", slot), ("nth", nth), ("start", start), ("tokens", tokens))])
    out = each.join(at, [a, b]).select(*[F.col(row).getField(c).alias(c) for c in docs.columns], slot, nth, start, tokens)
    return out, {"slot": slot, "nth": nth, "start": start, "tokens": tokens}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(slot, source, nth, doc_id, start_token, n_tokens): which document stands where in the mixture."""
    at = placements(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return at.select("slot", "source", "nth", F.col("id").alias("doc_id"), F.col("start").alias("start_token"), F.col("tokens").alias("n_tokens"))


def mixture_stage(docs: DataFrame) -> DataFrame:
    """docs in the order of the mixture, with just their own columns; see mix_sources()."""
    mixed, c = mix_sources(docs)
    return mixed.repartitionByRange(c["slot"]).sortWithinPartitions(c["slot"], c["start"]).select(*[quoted(x) for x in docs.columns])


OP2_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r]+')) AS n_tokens,
    CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS src FROM documents),
p AS (SELECT *, CAST(coalesce(sum(n_tokens) OVER (PARTITION BY src ORDER BY digest, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_token FROM d),
t AS (SELECT src, CAST(sum(n_tokens) AS BIGINT) AS tokens FROM d GROUP BY src),
w AS (SELECT src, tokens, greatest(1, CAST(ceil(tokens / {BLOCK_TOKENS}.0) AS BIGINT)) AS blocks, sum(pow(greatest(tokens, 1), {ALPHA})) OVER (ORDER BY src) AS c, row_number() OVER (ORDER BY src) AS i FROM t),
h AS (SELECT src, tokens, blocks, i + CASE WHEN c >= max(c) OVER () THEN {ONE} - max(i) OVER () ELSE CAST(floor(c / max(c) OVER () * CAST({ONE} - max(i) OVER () AS DOUBLE)) AS BIGINT) END AS hi FROM w),
s AS (SELECT src, tokens, blocks, hi, coalesce(lag(hi) OVER (ORDER BY src), 0) AS lo FROM h),
k AS (SELECT CAST(least(max(ceil((blocks + 8) * {ONE}.0 / (hi - lo))), sum(blocks) * {MAX_EPOCHS}) AS BIGINT) AS n, count(*) AS sources FROM s),
u AS (SELECT r AS slot, (r * {STEP}) % {ONE} AS u FROM k, range(0, k.n) AS x(r)),
j AS (SELECT slot, src, blocks, row_number() OVER (PARTITION BY src ORDER BY slot) - 1 AS nth FROM u JOIN s ON u >= lo AND u < hi),
e AS (SELECT CASE WHEN (SELECT count(*) FROM j WHERE nth = blocks - 1) = sources THEN (SELECT max(slot) FROM j WHERE nth = blocks - 1) ELSE n - 1 END AS last FROM k),
g AS (SELECT s.src, s.tokens, s.blocks, count(slot) AS given FROM s LEFT JOIN (SELECT j.src, slot FROM j, e WHERE slot <= last) AS y ON s.src = y.src GROUP BY ALL),
x AS (SELECT *, greatest(blocks - given, 0) AS extra, coalesce(sum(greatest(blocks - given, 0)) OVER (ORDER BY src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM g),
slots AS (SELECT slot, src, nth FROM j, e WHERE slot <= last UNION ALL SELECT last + 1 + base + y.i, src, given + y.i FROM x, e, LATERAL (SELECT unnest(range(0, extra)) AS i) AS y),
m AS (SELECT p.*, x.tokens, unnest(range(0, greatest(1, CASE WHEN x.tokens > 0 THEN least({MAX_EPOCHS}, CAST(ceil(greatest(given, blocks) * {BLOCK_TOKENS}.0 / x.tokens) AS BIGINT)) ELSE 1 END))) AS epoch FROM p JOIN x ON p.src = x.src)
SELECT CAST(slots.slot AS BIGINT) AS slot, m.source, CAST(slots.nth AS BIGINT) AS nth, m.doc_id, CAST(m.start_token + epoch * tokens AS BIGINT) AS start_token, CAST(m.n_tokens AS BIGINT) AS n_tokens
FROM m JOIN slots ON slots.src = m.src AND slots.nth = (epoch * tokens + least(m.start_token, greatest(tokens - 1, 0))) // {BLOCK_TOKENS}
"""
