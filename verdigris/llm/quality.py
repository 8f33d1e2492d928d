"""Quality rules by n-gram perplexity.

A modified Kneser-Ney model of characters (code points) of order 5 is estimated
for each language from counts over all documents. A document's information is
the sum of -log p over its characters; two means of it, by characters (the
logarithm of perplexity) and by words (runs of letters and digits), must each
lie within a lower and an upper band of its language. The mean by words tells
what the one by characters can't: words with symbols after them, lists without
function words. Bands are the median +- WIDTH scales, with the median and the
median absolute deviation of the language's distinct texts of like length (by
powers of two), so that a short text, whose perplexity strays more, is given
more room. Where such a cell has few texts it leans on its language's median and
twice its language's scale, and a language of few texts on a wide prior scale,
each in proportion.

Every document counts, rare kinds of text too, so that clean text isn't turned
away for being unknown. Common junk teaches the model as well, and still lies
outside the bands, as five characters reach from one word's symbols to the next
word's only.

Counting combines in the workers (sort and count of hashed n-grams, in bounded
parts), then in Spark; continuation counts, discounts and interpolation are
joins over the table of n-grams. Nothing is pruned. As every text is counted,
each of its n-grams of the highest order has a probability of its own, and
scoring is one lookup a character. The sorted hash arrays that are broadcast
hold MODEL_GRAMS of these at most, whatever the corpus and however many its
languages: those that occur at least as often as the least power of two by which
they fit. The characters whose n-grams are rarer, if any, are joined with the
table of the rest, so that all are scored by the same model at any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.common import documents, forget, own, quoted, table
from verdigris.llm.hashing import SortedHash

ORDER = 5
#: Half-width of the bands, in scales.
WIDTH = 4.0
#: A cell's, or a language's, own figures weigh texts / (texts + PRIOR_TEXTS); the rest is the prior.
PRIOR_TEXTS = 10.0
#: Scales of a language without texts, and least ones: of the mean by characters, and of the logarithm of that by words.
PRIOR_SCALE, LEAST_SCALE = {"x": 0.5, "w": 0.2}, {"x": 0.01, "w": 0.005}
LEAST_DISCOUNT = 0.1
#: N-grams in the arrays that are broadcast at most; the rest are joined.
MODEL_GRAMS = 1 << 23
#: Rows of the table of bands (languages by lengths) up to which it is broadcast; beyond, it is joined by shuffling.
BROADCAST_BANDS = 500_000
#: Log probabilities are whole numbers of 1e-6, mean ones of 1e-4: sums don't depend on their order.
UNIT, MEAN_UNIT = 1e6, 1e4
#: -log p of a character of a language that the model doesn't know.
UNKNOWN = -20 * UNIT
MARK = 2
SLICE_BYTES = 2 << 20
#: Distinct n-grams that a worker holds before it hands them on.
HELD_GRAMS = 1 << 21
_BLOCK = 1 << 16
_BITS = 21
_MASK = (1 << _BITS) - 1
_SIGN = np.int64(-(1 << 63))
#: Columns that scoring adds for each text, and for each character that is to be joined.
_SCORED = ("row", "sum", "size", "words", "hi", "lo")
UNCOUNTED = "an n-gram that wasn't counted: the table isn't the same when it is read again"


def cell_of(text: Column) -> Column:
    """The whole part of the binary logarithm of a text's length; null for null and empty texts."""
    n = F.char_length(text)
    return F.when(n > 0, F.length(F.bin(n.cast("long"))) - 1)


def code_points(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a slice's rows and where each row's begin among them."""
    raw = buf[: offsets[-1]]
    try:
        text = raw.tobytes().decode()
    except UnicodeDecodeError:
        rows = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return np.frombuffer("".join(rows).encode("utf-32-le"), "<u4"), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return np.frombuffer(text.encode("utf-32-le"), "<u4"), begins[offsets]


class Grams:
    """The n-grams that end at each character of a slice; marks stand before a row's first character."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, seeds: np.ndarray, order: int):
        self.points, self.firsts = code_points(buf, offsets)
        self.sizes, self.order = np.diff(self.firsts), order
        self.seeds = seeds.view(np.uint64)

    def hashes(self, order: int, of_rows: np.ndarray | None = None) -> np.ndarray:
        """of_rows: other seeds of the rows."""
        n, of_rows = len(self.points), self.seeds if of_rows is None else of_rows
        out, seeds = np.empty(n, dtype=np.uint64), np.repeat(of_rows, self.sizes)
        for at in range(0, n, _BLOCK):  # a block's arrays stay in the cache
            end = min(n, at + _BLOCK)
            points = np.full(end - at + order - 1, MARK, dtype=np.uint64)
            points[max(0, order - 1 - at) :] = self.points[max(0, at - order + 1) : end]
            out[at:end] = hash_grams([points[j : j + end - at] for j in range(order)], seeds[at:end])
        for j in range(order - 1):  # where the row before would reach in
            some = np.flatnonzero(self.sizes > j)
            at = self.firsts[some] + j
            out[at] = hash_grams([self.points[at - k].astype(np.uint64) if k <= j else np.full(len(at), MARK, np.uint64) for k in range(order - 1, -1, -1)], of_rows[some])
        return out

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The code points of the n-grams that end at these characters."""
        start = self.firsts[np.searchsorted(self.firsts, at, "right") - 1]
        places = at[:, None] + np.arange(1 - self.order, 1)[None, :]
        return np.where(places >= start[:, None], self.points[np.maximum(places, 0)], np.uint32(MARK)).astype(np.uint32)


def hash_grams(points: list[np.ndarray], seeds: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams given by their places' code points, three to a step; one step loses nothing."""
    h = seeds
    for at in range(0, len(points), 3):
        part = points[at]
        for j, p in enumerate(points[at + 1 : at + 3]):
            part = part | (p << np.uint64(_BITS * (j + 1)))
        h = X.mix64((h ^ part) * X._G)
    return h


def of_order(seeds: np.ndarray, order: int) -> np.ndarray:
    """The seeds by which n-grams of this order are hashed in the model."""
    return X.mix64(seeds + np.uint64(order))


def packed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of five code points at most, as two numbers of 21 bits a point, the last one lowest."""
    hi, lo = np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    for j in range(points.shape[1] - 3):
        hi = (hi << _BITS) | points[:, j]
    for j in range(max(0, points.shape[1] - 3), points.shape[1]):
        lo = (lo << _BITS) | points[:, j]
    return hi, lo


class Tally:
    """Counts of n-grams so far: hashes in order, counts, seeds and the n-grams themselves."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, grams: Grams) -> None:
        """The n-grams that end at each character of a slice, and that which ends just before each row's first."""
        h = grams.hashes(grams.order)
        by = np.argsort(h)
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[by]) != 0])) if len(h) else np.zeros(0, np.int64)
        place = by[first]
        row = np.searchsorted(grams.firsts, place, "right") - 1
        self._hold(h[place], np.diff(np.append(first, len(h))), grams.seeds[row], *packed(grams.rows(place)))
        seeds, n = np.unique(grams.seeds[grams.sizes > 0], return_counts=True)
        marks = np.full((len(seeds), grams.order), MARK, np.uint32)
        self._hold(hash_grams([c.astype(np.uint64) for c in marks.T], seeds), n, seeds, *packed(marks))

    def _hold(self, *part: np.ndarray) -> None:
        self.parts.append(part)
        self.pending += len(part[0])

    def merge(self) -> None:
        h, n, *rest = (np.concatenate(x) for x in zip(*self.parts))
        h, first, which = np.unique(h, return_index=True, return_inverse=True)
        self.parts = [(h, np.bincount(which, weights=n, minlength=len(h)).astype(np.int64), *[x[first] for x in rest])]
        self.pending = len(h)

    def batches(self) -> Iterator[pa.RecordBatch]:
        """What is held, which is then let go."""
        if self.parts:
            self.merge()
            _, n, seeds, hi, lo = self.parts[0]
            self.parts, self.pending = [], 0
            for at in range(0, len(n), 1 << 16):
                part = slice(at, at + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array(x[part]) for x in (seeds.view(np.int64), hi, lo, n)], names=["seed", "hi", "lo", "n"])


def count_grams(rows: DataFrame, order: int = ORDER, held: int = HELD_GRAMS) -> DataFrame:
    """rows (seed, text) -> table (seed, hi, lo, n): how often each n-gram occurs. A worker holds some `held` distinct ones; then it merges, and hands them on if that leaves more than half."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()
        for batch in batches:
            seeds = batch.column("seed").to_numpy()
            for a, b, buf, offsets in X.slices(batch.column("text"), SLICE_BYTES):
                tally.add(Grams(buf, offsets, seeds[a:b], order))
                if tally.pending > held:
                    tally.merge()
                    if tally.pending > held // 2:
                        yield from tally.batches()
        yield from tally.batches()

    parts = rows.select("seed", "text").mapInArrow(run, "seed long, hi long, lo long, n long")
    return table(parts.groupBy("seed", "hi", "lo").agg(F.sum("n").alias("n")), "grams")


def _suffix(k: int) -> list[Column]:
    """The last k characters of an n-gram."""
    hi = F.lit(0).cast("long") if k <= 3 else F.col("hi").bitwiseAND(F.lit((1 << _BITS * (k - 3)) - 1))
    return [hi.alias("hi"), (F.col("lo") if k >= 3 else F.col("lo").bitwiseAND(F.lit((1 << _BITS * k) - 1))).alias("lo")]


def _prefix() -> list[Column]:
    """All but the last character of an n-gram."""
    low = F.shiftleft(F.col("hi").bitwiseAND(F.lit(_MASK)), 2 * _BITS).bitwiseOR(F.shiftright("lo", _BITS))
    return [F.shiftright("hi", _BITS).alias("hi"), low.alias("lo")]


def discounts(levels: dict[int, DataFrame]) -> DataFrame:
    """Levels (seed, c) by order -> (seed, k, d1, d2, d3): the discounts of modified Kneser-Ney, from counts of counts."""
    few = None
    for k, level in levels.items():
        of = level.select("seed", F.lit(k).alias("k"), F.least("c", F.lit(5)).alias("c")).groupBy("seed", "k", "c").agg(F.count("*").cast("double").alias("m"))
        few = of if few is None else few.union(of)
    n = few.groupBy("seed", "k").agg(*[F.coalesce(F.sum(F.when(F.col("c") == i, F.col("m"))), F.lit(0.0)).alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(0.0)
    d = [F.when(F.col(f"n{i}") > 0, i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(float(i)) for i in (1, 2, 3)]
    return n.select("seed", "k", *[F.greatest(F.least(x, F.lit(float(i))), F.lit(LEAST_DISCOUNT)).alias(f"d{i}") for i, x in enumerate(d, 1)])


def _least(levels: dict[int, DataFrame], room: float) -> DataFrame:
    """(seed, least1, ..., least<order>): how often n-grams of each order occur at least that are stored; not less than for the order below, as an n-gram's parts are as frequent."""
    size = levels[1].groupBy("seed").agg(F.sum("n").alias("size"))
    share = size.crossJoin(size.agg(F.sum(F.sqrt("size")).alias("roots"))).select("seed", (F.sqrt("size") / F.col("roots") * room).alias("room"))
    power = F.length(F.bin("n")) - 1
    bins = None
    for k, level in levels.items():
        of = level.groupBy("seed", power.alias("power")).agg(F.count("*").alias("grams")).withColumn("k", F.lit(k))
        bins = of if bins is None else bins.union(of)
    down = Window.partitionBy("seed", "k").orderBy(F.desc("power"))
    fits = bins.withColumn("upto", F.sum("grams").over(down)).join(share, "seed")
    of = fits.groupBy("seed", "k").agg(F.coalesce(F.max(F.when(F.col("upto") > F.col("room"), F.col("power"))) + 1, F.lit(0)).alias("power"))
    return of.groupBy("seed").agg(*[F.pow(F.lit(2.0), F.max(F.when(F.col("k") <= k, F.col("power")))).cast("long").alias(f"least{k}") for k in levels])


def interpolated(grams: DataFrame, order: int = ORDER, model_grams: int | None = None) -> tuple[dict[int, DataFrame], dict[int, DataFrame], list[DataFrame]]:
    """Table grams (seed, hi, lo, n) -> by order k, 0 to order, tables (seed, hi, lo, p), with n in the highest; by order tables of contexts (seed, phi, plo, total, gamma); and tables to forget once these are read.

    p is the interpolated probability of the last character, gamma the mass that
    a context leaves to the lower order. That of k = 0 is the uniform
    distribution. The highest order has the counts given, lower ones continuation
    counts. model_grams: prunes to so many n-grams; None prunes none.
    """
    levels = {order: grams.withColumn("c", F.col("n"))}
    made = []
    for k in range(order - 1, 0, -1):
        levels[k] = table(levels[k + 1].groupBy("seed", *_suffix(k)).agg(F.sum("n").alias("n"), F.count("*").alias("c")), f"level{k}")
        made.append(levels[k])
    # written, so that the plans below hold a small table in their place
    off = table(discounts(levels), "discounts")
    made.append(off)
    if model_grams is not None:
        least = table(_least(levels, model_grams / order), "least")
        made.append(least)
    none = F.lit(0).cast("long")
    below = levels[1].groupBy("seed").agg((1.0 / (F.count("*") + 1)).alias("p")).select("seed", none.alias("hi"), none.alias("lo"), "p")
    found, contexts = {0: below}, {}
    for k in range(1, order + 1):
        of, stored = levels[k].join(off.filter(F.col("k") == k).drop("k"), "seed"), F.lit(True)
        if model_grams is not None:
            of = of.join(least.select("seed", F.col(f"least{k}").alias("least")), "seed")
            stored = F.col("n") >= F.col("least")
        kind = F.least("c", F.lit(3))
        context = of.select("seed", *_prefix(), "c", "d1", "d2", "d3", stored.alias("stored"), kind.alias("kind")).groupBy("seed", "hi", "lo").agg(
            F.sum("c").alias("total"),
            F.sum(F.when(F.col("stored"), F.col("c")).otherwise(0)).alias("kept"),
            *[F.count_if(F.col("stored") & (F.col("kind") == i)).alias(f"m{i}") for i in (1, 2, 3)],
            *[F.first(f"d{i}").alias(f"d{i}") for i in (1, 2, 3)],
        )
        left = F.col("total") - F.col("kept") + F.col("m1") * F.col("d1") + F.col("m2") * F.col("d2") + F.col("m3") * F.col("d3")
        contexts[k] = table(context.select("seed", F.col("hi").alias("phi"), F.col("lo").alias("plo"), "total", (left / F.col("total")).alias("gamma")), f"context{k}")
        made.append(contexts[k])
        own = F.col("c") - F.when(kind == 1, F.col("d1")).when(kind == 2, F.col("d2")).otherwise(F.col("d3"))
        (phi, plo), (shi, slo) = _prefix(), _suffix(k - 1) if k > 1 else [none] * 2
        counted = ["n"] if k == order else []
        mine = of.filter(stored).select("seed", "hi", "lo", *counted, own.alias("own"), phi.alias("phi"), plo.alias("plo"), shi.alias("shi"), slo.alias("slo"))
        lower = found[k - 1].select("seed", F.col("hi").alias("shi"), F.col("lo").alias("slo"), "p")
        p = F.col("own") / F.col("total") + F.col("gamma") * F.col("p")
        found[k] = table(mine.join(contexts[k], ["seed", "phi", "plo"]).join(lower, ["seed", "shi", "slo"]).select("seed", "hi", "lo", *counted, p.alias("p")), f"p{k}")
        made.append(found[k])
    return found, contexts, made


def _unit(c: Column) -> Column:
    """A logarithm in UNIT; 0 for null."""
    return F.rint(F.coalesce(c, F.lit(0.0)) * UNIT).cast("int")


def kneser_ney(grams: DataFrame, order: int = ORDER, model_grams: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """Table grams (seed, hi, lo, n) -> (seed, k, hi, lo, logp, back), and tables to forget once it is read: the model for texts that may not have been counted, or pruned to model_grams entries.

    Entries of k = 1 to order are the n-grams stored: the interpolated log
    probability of the last character, and the log of the mass that their
    contexts leave to the lower order (0 where nothing follows), in UNIT. The
    entry of k = 0 has that of the empty context, and as logp that of each
    character by the uniform distribution.
    """
    found, contexts, made = interpolated(grams, order, model_grams)
    whole = backs = None
    for k, of in found.items():
        now = of.select("seed", F.lit(k).alias("k"), "hi", "lo", F.log("p").alias("lp"))
        whole = now if whole is None else whole.union(now)
    for k, of in contexts.items():
        back = of.select("seed", F.lit(k - 1).alias("k"), F.col("phi").alias("hi"), F.col("plo").alias("lo"), F.log("gamma").alias("back"))
        backs = back if backs is None else backs.union(back)
    # a context is looked for only where its own n-gram is stored; others have no stored n-gram after them
    return whole.join(backs, ["seed", "k", "hi", "lo"], "left").select("seed", "k", "hi", "lo", _unit(F.col("lp")).alias("logp"), _unit(F.col("back")).alias("back")), made


def entry_hashes(seeds: np.ndarray, k: np.ndarray, hi: np.ndarray, lo: np.ndarray, order: int = ORDER) -> np.ndarray:
    """The keys of the model's entries."""
    h = np.empty(len(seeds), np.uint64)
    for i in range(order + 1):
        at = np.flatnonzero(k == i)
        points = [((hi if j >= 3 else lo)[at] >> (_BITS * (j % 3)) & _MASK).astype(np.uint64) for j in range(i - 1, -1, -1)]
        h[at] = hash_grams(points, of_order(seeds[at].view(np.uint64), i))
    return h.view(np.int64)


class Model:
    """Sorted hash arrays: of each n-gram stored, its log probability and, where texts may have others, what its context leaves to the lower order."""

    def __init__(self, h: np.ndarray, logp: np.ndarray, back: np.ndarray | None = None, order: int = ORDER):
        """h: entry_hashes(), in any order; if in order they aren't sorted again. Without back, an n-gram that isn't stored is the caller's to find."""
        h = h.view(np.uint64)
        if not np.all(h[1:] > h[:-1]):
            h, first = np.unique(h, return_index=True)
            logp, back = logp[first], None if back is None else back[first]
        self.keys, self.order = SortedHash(h), order
        self.logp, self.back = (None if x is None else np.append(x, 0).astype(np.int32, copy=False) for x in (logp, back))  # the last is that of -1

    def lookup(self, grams: Grams) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each character, in UNIT, and the characters whose n-grams of the highest order aren't stored, with 0."""
        seeds, n = of_order(grams.seeds, self.order), len(grams.points)
        h, each, todo = grams.hashes(self.order, seeds), np.empty(n, np.int64), [np.zeros(0, np.int64)]
        for at in range(0, n, _BLOCK):
            place = self.keys.find(h[at : at + _BLOCK])
            each[at : at + _BLOCK] = self.logp[place]
            todo.append(np.flatnonzero(place < 0) + at)
        return each, np.concatenate(todo)

    def information(self, grams: Grams) -> np.ndarray:
        """-log p of each row, in UNIT, by backing off where need be."""
        each, todo = self.lookup(grams)
        for at in range(0, len(todo), _BLOCK):
            part = todo[at : at + _BLOCK]
            each[part] = self._backed_off(grams, part)
        return -X.segment_sums(each, grams.firsts)

    def _backed_off(self, grams: Grams, at: np.ndarray) -> np.ndarray:
        """Log probabilities of the characters whose n-grams of the highest order aren't stored."""
        points = grams.rows(at).astype(np.uint64)
        seeds = grams.seeds[np.searchsorted(grams.firsts, at, "right") - 1]
        out, left = np.zeros(len(at), np.int64), np.arange(len(at))
        for k in range(self.order, -1, -1):
            own, known = points[left, self.order - k :], seeds[left]
            if k < self.order:
                place = self.keys.find(hash_grams(list(own.T), of_order(known, k)))
                out[left] += np.where(place >= 0, self.logp[place], UNKNOWN if k == 0 else 0).astype(np.int64)
                left = left[place < 0]
                if k == 0 or not left.size:
                    break
                own, known = points[left, self.order - k :], seeds[left]
            place = self.keys.find(hash_grams(list(own[:, :-1].T), of_order(known, k - 1)))
            out[left] += self.back[place]
        return out


def fit(rows: DataFrame, order: int = ORDER, room: int | None = None) -> tuple[Broadcast, DataFrame | None]:
    """rows (seed, text) -> the model to broadcast, of the `room` (MODEL_GRAMS) most frequent n-grams of the corpus, or fewer, and a table of the rest (seed, hi, lo, logp); None if there are none. Both are of one model, of which nothing is pruned."""
    room = MODEL_GRAMS if room is None else room
    grams = count_grams(rows, order)
    found, _, made = interpolated(grams, order)
    every = found[order].select("seed", "hi", "lo", "n", _unit(F.log("p")).alias("logp"))
    bins = dict(every.groupBy((F.length(F.bin("n")) - 1).alias("power")).agg(F.count("*")).collect())
    power = max(bins, default=0) + 1
    while power and (room := room - bins.get(power - 1, 0)) >= 0:
        power -= 1
    stored = F.col("n") >= (1 << power)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seeds, hi, lo = (batch.column(c).to_numpy() for c in ("seed", "hi", "lo"))
            h = entry_hashes(seeds, np.full(len(seeds), order), hi, lo, order) ^ _SIGN
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("logp")], names=["h", "logp"])

    # in order of the unsigned hashes, so that the driver needn't sort
    got = every.filter(stored).select("seed", "hi", "lo", "logp").mapInArrow(run, "h long, logp int").orderBy("h").toArrow()
    h, logp = got["h"].to_numpy(), got["logp"].to_numpy()
    del got
    pa.default_memory_pool().release_unused()
    model = rows.sparkSession.sparkContext.broadcast(Model(h ^ _SIGN, logp, order=order))
    del h, logp  # the driver's memory
    rest = table(every.filter(~stored).drop("n"), "rest") if power else None
    forget(grams, *made)
    return model, rest


def fit_pruned(rows: DataFrame, model_grams: int, order: int = ORDER) -> Broadcast:
    """rows (seed, text) -> a model, to broadcast, of model_grams entries and one for each language at most, that backs off for the n-grams left out. Coarser than fit()'s; no query uses it."""
    grams = count_grams(rows, order)
    entries, made = kneser_ney(grams, order, model_grams)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = entry_hashes(*[batch.column(c).to_numpy() for c in ("seed", "k", "hi", "lo")], order)
            yield pa.RecordBatch.from_arrays([pa.array(h), batch.column("logp"), batch.column("back")], names=["h", "logp", "back"])

    got = entries.mapInArrow(run, "h long, logp int, back int").toArrow()
    forget(grams, *made)
    return rows.sparkSession.sparkContext.broadcast(Model(*[got[c].to_numpy() for c in ("h", "logp", "back")], order))


def scored(rows: DataFrame, model: Broadcast, rest: DataFrame | None = None) -> DataFrame:
    """rows (seed, text, ...) -> rows without text, with x, the mean information by characters, and w, the logarithm of that by words, in MEAN_UNIT (both -1 without characters); from tables. A text without words counts as one. model, which is destroyed, and rest: fit()'s."""
    names = [c for c in rows.columns if c != "text"]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "text")
    joined = rest is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each text; where rest is joined, also one for each of its characters that is to be found there, with null elsewhere."""
        known = model.value
        for batch in batches:
            seeds, ids, out = batch.column("seed").to_numpy(), batch.column("row").to_numpy(), [np.zeros((3, 0), np.int64)]
            for a, b, buf, offsets in X.slices(batch.column("text"), SLICE_BYTES):
                grams = Grams(buf, offsets, seeds[a:b], known.order)
                if known.back is None:
                    each, todo = known.lookup(grams)
                    sums = -X.segment_sums(each, grams.firsts)
                    if todo.size and not joined:
                        raise RuntimeError(UNCOUNTED)
                    for at in range(0, len(todo), _BLOCK):
                        part = todo[at : at + _BLOCK]
                        of = np.searchsorted(grams.firsts, part, "right") - 1 + a
                        rare = {"seed": seeds[of], "row": ids[of], **dict(zip(("hi", "lo"), packed(grams.rows(part))))}
                        yield pa.RecordBatch.from_arrays([pa.array(rare[c]) if c in rare else pa.nulls(len(of), kind) for c, kind in kinds(batch)], names=[*names, *_SCORED])
                else:
                    sums = known.information(grams)
                words = np.diff(X.runs(X.WORD_BYTE[buf], offsets)[2])
                out.append(np.stack([sums, grams.sizes, words]).astype(np.int64))
            mine = [*[batch.column(c) for c in names], batch.column("row"), *map(pa.array, np.concatenate(out, axis=1)), *[pa.nulls(len(ids), pa.int64())] * 2]
            yield pa.RecordBatch.from_arrays(mine, names=[*names, *_SCORED])

    def kinds(batch: pa.RecordBatch) -> list[tuple[str, pa.DataType]]:
        return [*[(c, batch.schema.field(c).type) for c in names], *[(c, pa.int64()) for c in _SCORED]]

    found = rows.withColumn("row", F.monotonically_increasing_id()).mapInArrow(run, f"{types}, " + ", ".join(f"{c} long" for c in _SCORED))
    some, words = F.col("size") > 0, F.greatest("words", F.lit(1))
    x = F.when(some, F.rint(F.col("sum") / F.col("size") / UNIT * MEAN_UNIT)).otherwise(-1).cast("long")
    w = F.when(some, F.rint(F.log(F.greatest(F.col("sum") / words / UNIT, F.lit(1.0))) * MEAN_UNIT)).otherwise(-1).cast("long")
    figures = [*map(quoted, names), x.alias("x"), w.alias("w")]
    found = table(found if joined else found.select(figures), "scores")
    model.destroy()
    if not joined:
        return found
    logp = F.coalesce("logp", F.raise_error(F.lit(UNCOUNTED)).cast("int"))
    rare = found.filter("size is null").select("row", "seed", "hi", "lo").join(rest, ["seed", "hi", "lo"], "left").groupBy("row").agg(F.sum(logp).alias("rare"))
    rare = table(rare, "rare")
    return found.filter("size is not null").join(rare, "row", "left").withColumn("sum", F.col("sum") - F.coalesce("rare", F.lit(0))).select(figures)


def _weighted_median(df: DataFrame, key: list[str], value: str, out: str) -> DataFrame:
    """(key, value, w) -> (key, out, texts): the lower median, from a histogram."""
    by = Window.partitionBy(*key)
    upto = df.withColumn("upto", F.sum("w").over(by.orderBy(value))).withColumn("texts", F.sum("w").over(by))
    return upto.filter(F.col("upto") * 2 >= F.col("texts")).groupBy(*key).agg(F.min(value).alias(out), F.first("texts").alias("texts"))


def bands(scores: DataFrame, of: str, width: float = WIDTH) -> DataFrame:
    """scores (seed, cell, x, w, digest) -> table (seed, cell, lo_<of>, hi_<of>), in MEAN_UNIT. Repeats of a text count once."""
    known = scores.filter("x >= 0").select("seed", "cell", F.col(of).alias("x"), "digest").distinct()
    histogram = table(known.groupBy("seed", "cell", "x").agg(F.count("*").alias("w")), "histogram")

    def middle_and_spread(key: list[str]) -> DataFrame:
        middle = _weighted_median(histogram.groupBy(*key, "x").agg(F.sum("w").alias("w")), key, "x", "middle")
        away = histogram.join(middle.drop("texts"), key).groupBy(*key, F.abs(F.col("x") - F.col("middle")).alias("away")).agg(F.sum("w").alias("w"))
        return middle.join(_weighted_median(away, key, "away", "spread").drop("texts"), key)

    share = F.col("texts") / (F.col("texts") + F.lit(PRIOR_TEXTS))
    wide = 2 * share * 1.4826 * F.col("spread") + (1 - share) * (PRIOR_SCALE[of] * MEAN_UNIT)
    of_seed = middle_and_spread(["seed"]).select("seed", F.col("middle").alias("of_all"), wide.alias("wide"))
    centre = share * F.col("middle") + (1 - share) * F.col("of_all")
    scale = F.greatest(share * 1.4826 * F.col("spread") + (1 - share) * F.col("wide"), F.lit(LEAST_SCALE[of] * MEAN_UNIT))
    joined = middle_and_spread(["seed", "cell"]).join(of_seed, "seed")
    out = table(joined.select("seed", "cell", F.rint(centre - width * scale).cast("long").alias(f"lo_{of}"), F.rint(centre + width * scale).cast("long").alias(f"hi_{of}")), "bands")
    forget(histogram)
    return out


def _rows(docs: DataFrame, text_col: str, lang_col: str) -> tuple[Column, Column]:
    """The seed, which stands for the language, null being one of its own; and the text."""
    lang = quoted(lang_col).cast("string")
    return F.xxhash64(lang, lang.isNull()), quoted(text_col).cast("string")


def perplexities(docs: DataFrame, keep: list[str], text_col: str = "text", lang_col: str = "lang", model_grams: int | None = None, room: int | None = None) -> tuple[DataFrame, dict[str, str]]:
    """The columns of docs named, with perplexity, lower, upper (by characters), word_info, word_lower, word_upper (nats a word) and kept added; and the names of these.

    Null and empty texts have null figures and bounds, and are not kept; so are
    bounds and kept of no other text. A text without words counts as one word. A
    null language is a language, and any string is one. Rows with equal text and
    language fare alike, so ties and repeated rows do; very long texts are
    counted and scored whole. A corpus of a few texts has wide bands. The columns
    added take names that docs doesn't have. An empty table gives an empty one.
    room: n-grams in the arrays that are broadcast (MODEL_GRAMS), which doesn't
    change any figure. model_grams: prunes the model to so many, which does.
    """
    held, *added = own(docs, "held", "perplexity", "lower", "upper", "word_info", "word_lower", "word_upper", "kept")
    seed, text = _rows(docs, text_col, lang_col)
    texts = docs.select(seed.alias("seed"), text.alias("text"))
    model, rest = fit(texts, room=room) if model_grams is None else (fit_pruned(texts, model_grams), None)
    rows = docs.select(F.struct(*[quoted(c) for c in keep]).alias(held), seed.alias("seed"), cell_of(text).alias("cell"), F.xxhash64(text).alias("digest"), text.alias("text"))
    done = scored(rows, model, rest)
    if rest is not None:
        forget(rest)
    limits = table(bands(done, "x").join(bands(done, "w"), ["seed", "cell"]), "limits")
    small = limits.count() <= BROADCAST_BANDS
    out = done.join(F.broadcast(limits) if small else limits, ["seed", "cell"], "left")
    some = F.col("x") >= 0
    inside = [(F.col(c) >= F.col(f"lo_{c}")) & (F.col(c) <= F.col(f"hi_{c}")) for c in ("x", "w")]
    nats = lambda c: F.when(some, F.exp(F.col(c) / MEAN_UNIT))
    figures = [nats(c) for c in ("x", "lo_x", "hi_x", "w", "lo_w", "hi_w")] + [F.coalesce(some & inside[0] & inside[1], F.lit(False))]
    kinds = ("perplexity", "lower", "upper", "word_info", "word_lower", "word_upper", "kept")
    return out.select(*[F.col(held).getField(c).alias(c) for c in keep], *[f.alias(c) for f, c in zip(figures, added)]), dict(zip(kinds, added))


def quality_filter(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", room: int | None = None) -> DataFrame:
    """The rows of docs whose information lies within both bands of their language, with their columns; see perplexities() for nulls, ties, room and other odd input."""
    out, names = perplexities(docs, docs.columns, text_col, lang_col, room=room)
    return out.filter(F.col(names["kept"])).select(*[quoted(c) for c in docs.columns])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, perplexity, lower, upper, word_info, word_lower, word_upper, kept) of every document."""
    out, c = perplexities(documents(spark, sf_dir).select("doc_id", "lang", "text"), ["doc_id"])
    return out.select("doc_id", *[F.round(c[k], 4).alias(k) for k in ("perplexity", "lower", "upper", "word_info", "word_lower", "word_upper")], F.col(c["kept"]).alias("kept"))
