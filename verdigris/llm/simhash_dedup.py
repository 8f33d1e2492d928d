"""SimHash near-dedup by multi-index hashing.

A text's fingerprint is the sign, bit by bit, of the sum of +-1 hashes of its
features: its distinct case-folded words, with weight WORD_WEIGHT, and its
distinct pairs of successive words, so that the same words in another order are
another text. Two texts are near copies if their fingerprints differ in at most
a share MAX_SHARE of bits (34 of 192); the groups are the connected components
of that relation, and the row with the smallest id of each group stays.

Search: the bits are laid out in segments of three blocks each. If two
fingerprints differ in 2 bits of a segment at most, one of its blocks is equal
in both. A row is sent to the bucket (segment, block, value) of each of its
blocks; there each fingerprint is entered under all keys of the Hamming ball of
radius 1 around the segment's other two blocks. Two balls meet if the centres
are 2 bits apart at most, so that pairs meet under a key of the table; their
whole distance is then computed. Several layouts, by fixed permutations of the
bits, give further segments: up to 3 * SEGMENTS - 1 bits the search is exact, and
at the largest distance allowed it finds a pair with a probability of RECALL.

The width of a block and the number of layouts follow from the number of rows:
blocks widen by a bit with every eight-fold table, which keeps chance meetings
in proportion to the table, and layouts are as many as RECALL asks for.

Each bucket returns a spanning forest of its verified pairs rather than the
pairs, so that a group of n copies leaves O(n) edges; and within a key what is
joined already isn't compared. No bucket is capped; they are read one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.common import documents, own, quoted, row_key, table, text_of

SEGMENTS, LEAST_BLOCK_BITS = 8, 8
MAX_SHARE, RECALL = 34 / 192, 0.95
WORD_WEIGHT = 2
#: Rows up to which blocks have their least width.
ROWS_OF_LEAST = 1 << 24
_SALT = 0x5851F42D4C957F2D
_PAIRS_AT_ONCE = 1 << 20
_KEYS_AT_ONCE = 1 << 24
#: Keys with more entries are searched from leaders, others pair by pair; with the same result.
_DIRECT = 64
_PIECE = 4 << 20


class Layout(NamedTuple):
    """Of fingerprints: bits in a block, layouts, and bits in which near copies differ at most."""

    block_bits: int
    layouts: int
    max_distance: int

    @property
    def n_bits(self) -> int:
        return SEGMENTS * 3 * self.block_bits

    @property
    def lanes(self) -> int:
        return -(-self.n_bits // 64)

    def order(self, layout: int) -> np.ndarray:
        """The bits of a layout in their order; the first is the plain one."""
        return np.arange(self.n_bits) if layout == 0 else np.random.default_rng(layout).permutation(self.n_bits)


def layout_for(n_rows: int, max_share: float = MAX_SHARE, recall: float = RECALL) -> Layout:
    bits = LEAST_BLOCK_BITS
    while n_rows > ROWS_OF_LEAST << 3 * (bits - LEAST_BLOCK_BITS):
        bits += 1
    n = 3 * bits
    meets = sum(math.comb(n, k) * max_share**k * (1 - max_share) ** (n - k) for k in range(3))
    return Layout(bits, max(1, math.ceil(math.log(1 - recall) / math.log(1 - meets) / SEGMENTS)), round(max_share * SEGMENTS * n))


def _sums(keys: np.ndarray, lanes: int) -> np.ndarray:
    """How many of these hashes set each bit."""
    out = np.zeros(lanes * 64, np.int64)
    for at in range(0, len(keys), 1 << 16):
        out += _bits(keys[at : at + (1 << 16)], lanes).sum(axis=0, dtype=np.int64)
    return out


def _bits(keys: np.ndarray, lanes: int) -> np.ndarray:
    words = np.empty((len(keys), lanes), dtype=np.uint64)
    for lane in range(lanes):
        words[:, lane] = X.mix64(keys * X._G + np.uint64((_SALT * (2 * lane + 1)) & (2**64 - 1)))
    return np.unpackbits(words.view(np.uint8), axis=1, bitorder="little")


_LOW = np.uint64((1 << 44) - 1)


def _of_rows(rows: np.ndarray, h: np.ndarray, n: int, lanes: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bits over each row's distinct hashes, and their number."""
    keys = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (h & _LOW))
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if keys.size else keys
    firsts = np.searchsorted((keys >> np.uint64(44)).astype(np.int64), np.arange(n + 1))
    size = np.diff(firsts)
    out = np.zeros((n, lanes * 64), dtype=np.int32)
    some = np.flatnonzero(size)
    # a few rows at a time: 8 bytes of hash become 64 of bits
    step = max(1, (1 << 16) // max(1, int(size.mean()) if some.size else 1))
    for at in range(0, some.size, step):
        part = some[at : at + step]
        lo, hi = firsts[part[0]], firsts[part[-1] + 1]
        if hi - lo > 1 << 20 and len(part) == 1:
            out[part[0]] = _sums(keys[lo:hi] & _LOW, lanes)
        else:
            out[part] = np.add.reduceat(_bits(keys[lo:hi] & _LOW, lanes), firsts[part] - lo, axis=0, dtype=np.int32)
    return out, size


def _pairs(h: np.ndarray, same_row: np.ndarray) -> np.ndarray:
    return X.mix64(h[:-1] * X._G + h[1:])[same_row]


def _of_long_text(buf: np.ndarray, size: int, lanes: int) -> tuple[np.ndarray, int, int]:
    """As _of_rows, weighted, for one text that is read in pieces: sums, distinct words, distinct pairs."""
    found: list[list[np.ndarray]] = [[], []]
    at, last = 0, np.zeros(0, np.uint64)
    while at < size:
        end = min(size, at + _PIECE)
        if end < size:  # between words if one ends in reach, else between characters
            back = np.flatnonzero(~X.WORD_BYTE[buf[max(at + 1, end - 4096) : end]])
            end = max(at + 1, end - 4096) + int(back[-1]) if back.size else end
            while end < size and buf[end] & 0xC0 == 0x80:
                end += 1
        part = np.zeros(end - at + X.PAD, np.uint8)
        part[: end - at] = buf[at:end]
        h = X.words(part, np.array([0, end - at]))[0]
        chain = np.concatenate([last, h])
        for kind, values in enumerate((h, _pairs(chain, np.ones(max(len(chain) - 1, 0), bool)))):
            found[kind].append(np.unique(values & _LOW))
            if sum(map(len, found[kind][1:])) > len(found[kind][0]):
                found[kind] = [np.unique(np.concatenate(found[kind]))]
        at, last = end, chain[-1:]
    words, pairs = (np.unique(np.concatenate(x)) for x in found)
    return WORD_WEIGHT * _sums(words, lanes) + _sums(pairs, lanes), len(words), len(pairs)


def fingerprints(column: pa.Array, n_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints as rows of 64-bit words, and how many distinct words each text has."""
    lanes = -(-n_bits // 64)
    prints, sizes = [np.zeros((0, lanes), np.uint64)], [np.zeros(0, np.int64)]
    for first, end, buf, offsets in X.slices(column):
        if offsets[-1] > 2 * _PIECE:
            ones, n, pairs = _of_long_text(buf, int(offsets[-1]), lanes)
            ones, size, total = ones[None, :], np.array([n]), np.array([WORD_WEIGHT * n + pairs])
        else:
            h, _, _, firsts = X.words(buf, offsets)
            rows = X.row_of(firsts)
            ones, size = _of_rows(rows, h, end - first, lanes)
            same = rows[1:] == rows[:-1]
            of_pairs, pairs = _of_rows(rows[:-1][same], _pairs(h, same), end - first, lanes) if len(h) else (0, 0)
            ones, total = WORD_WEIGHT * ones + of_pairs, WORD_WEIGHT * size + pairs
        signs = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view(np.uint64)
        if n_bits % 64:
            signs[:, -1] &= np.uint64((1 << (n_bits % 64)) - 1)
        prints.append(signs)
        sizes.append(size)
    return np.concatenate(prints), np.concatenate(sizes)


def take_bits(prints: np.ndarray, at: int, n: int) -> np.ndarray:
    """Bits at..at+n of each fingerprint, as numbers (n below 64)."""
    lane, shift = divmod(at, 64)
    out = prints[:, lane] >> np.uint64(shift)
    if shift + n > 64:
        out = out | (prints[:, lane + 1] << np.uint64(64 - shift))
    return out & np.uint64((1 << n) - 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """Union-find over 0..n-1 with whole arrays of pairs."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        r = self.root[x]
        while not np.array_equal(r, up := self.root[r]):
            r = up
        return r

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while a.size:
            ra, rb = self.find(a), self.find(b)
            keep = ra != rb
            if not keep.any():
                return
            a, b = a[keep], b[keep]
            hi, lo = np.maximum(ra, rb)[keep], np.minimum(ra, rb)[keep]
            np.minimum.at(self.root, hi, lo)

    def flat(self) -> np.ndarray:
        return self.find(np.arange(len(self.root)))


def _direct(row: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within the stretches given, in bounded arrays."""
    size = ends - begins
    at_key = np.repeat(begins, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    later = np.repeat(ends, size) - at_key - 1
    total = np.concatenate([[0], np.cumsum(later)])
    at = 0
    while at < len(at_key):
        end = max(at + 1, int(np.searchsorted(total, total[at] + _PAIRS_AT_ONCE, "right")) - 1)
        count = later[at:end]
        if count.any():
            left = np.repeat(at_key[at:end], count)
            right = left + 1 + np.arange(len(left)) - np.repeat(total[at:end] - total[at], count)
            yield row[left], row[right]
        at = end


def _from_leaders(some: np.ndarray, prints: np.ndarray, forest: Forest, max_distance: int) -> None:
    """Joins all near rows of one key: those near a leader are joined by it and not compared with each other."""
    while len(some) > 1:
        leader, rest = some[0], some[1:]
        near = distances(prints[leader][None, :], prints[rest]) <= max_distance
        joined, rest = rest[near], rest[~near]
        forest.join(np.full(len(joined), leader), joined)
        step = max(1, _PAIRS_AT_ONCE // max(1, len(rest)))
        for at in range(0, len(joined) if len(rest) else 0, step):
            part = joined[at : at + step]
            open_ = rest[forest.find(rest) != forest.find(np.array([leader]))[0]]
            a, b = np.repeat(part, len(open_)), np.tile(open_, len(part))
            near = distances(prints[a], prints[b]) <= max_distance
            forest.join(a[near], b[near])
        some = rest


def bucket_edges(bucket: np.ndarray, inner: np.ndarray, prints: np.ndarray, ids: np.ndarray, bits: int, max_distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (larger id, smaller id) of a spanning forest of the verified pairs, of rows in one bucket whose inner keys are at most 2 bits apart."""
    order = np.lexsort((ids, bucket))
    bucket, inner, prints, ids = bucket[order], inner[order], prints[order], ids[order]
    forest, n = Forest(len(ids)), len(ids)
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.uint64)
    base = bucket.astype(np.uint64) << np.uint64(bits) | inner
    parts = -(-n * len(flips) // _KEYS_AT_ONCE)
    for k in range(parts):
        keys, rows = [], []
        for flip in flips:
            key = base ^ flip
            at = np.arange(n) if parts == 1 else np.flatnonzero(key % np.uint64(parts) == k)
            keys.append(key[at])
            rows.append(at)
        keys, row = np.concatenate(keys), np.concatenate(rows)
        by = np.argsort(keys, kind="stable")
        keys, row = keys[by], row[by]
        begins = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, np.int64)
        ends = np.append(begins[1:], len(keys))
        small = ends - begins <= _DIRECT
        for a, b in _direct(row, begins[small], ends[small]):
            near = distances(prints[a], prints[b]) <= max_distance
            forest.join(a[near], b[near])
        for a, b in zip(begins[~small], ends[~small]):
            _from_leaders(row[a:b], prints, forest, max_distance)
    root = forest.flat()
    moved = np.flatnonzero(root != np.arange(len(root)))
    return ids[moved], ids[root[moved]]


def near_edges(reps: DataFrame, layout: Layout) -> DataFrame:
    """reps (id long, fp array<long>, distinct fp) -> edges (u long, v long), u > v, that connect all near copies found."""
    bits, lanes = layout.block_bits, layout.lanes
    lane_names = [f"f{i}" for i in range(lanes)]
    names = ["bucket", "inner", "id", *lane_names]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        orders = [layout.order(i) for i in range(layout.layouts)]
        for batch in batches:
            prints = np.stack([batch.column(f).to_numpy() for f in lane_names], axis=1).view(np.uint64)
            each = np.unpackbits(np.ascontiguousarray(prints).view(np.uint8), axis=1, bitorder="little")
            for i, order in enumerate(orders):
                laid = np.zeros_like(each)
                laid[:, : layout.n_bits] = each[:, order]
                laid = np.packbits(laid, axis=1, bitorder="little").view(np.uint64)
                for k in range(SEGMENTS * 3):
                    segment, block = divmod(k, 3)
                    a, b = [segment * 3 + x for x in range(3) if x != block]
                    inner = take_bits(laid, a * bits, bits) | (take_bits(laid, b * bits, bits) << np.uint64(bits))
                    bucket = (np.int64(i * SEGMENTS * 3 + k) << np.int64(bits)) | take_bits(laid, k * bits, bits).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(inner.view(np.int64)), batch.column("id"), *[batch.column(f) for f in lane_names]], names=names)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        size = 0

        def whole(last: bool) -> Iterator[pa.RecordBatch]:
            """Edges of the buckets that are complete; the last one read isn't, unless all is read."""
            nonlocal held, size
            columns = [np.concatenate(x) for x in zip(*held)]
            end = len(columns[0]) if last else int(np.searchsorted(columns[0], columns[0][-1]))
            if end:
                u, v = bucket_edges(columns[0][:end], columns[1][:end].view(np.uint64), np.stack([c[:end] for c in columns[3:]], axis=1).view(np.uint64), columns[2][:end], 2 * bits, layout.max_distance)
                if u.size:
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
            held = [[c[end:] for c in columns]] if end < len(columns[0]) else []
            size = len(columns[0]) - end

        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(c).to_numpy() for c in names])
                size += batch.num_rows
                if size > 100_000 and held[0][0][0] != held[-1][0][-1]:
                    yield from whole(False)
        if held:
            yield from whole(True)

    slim = reps.select("id", *[F.col("fp")[i].alias(f) for i, f in enumerate(lane_names)])
    sent = slim.mapInArrow(send, ", ".join(f"{n} long" for n in names))
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(search, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v) of longs -> (id, root): the smallest id of each component, for all ids but roots.

    Alternates the large-star and small-star steps of Kiveris et al. (2014); the
    edges are written to the shared folder after each round, and the rounds end
    when a round changes nothing.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        if not large:
            both = e.select("u", "v")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        return out.filter("u > v").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())

    now = table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "edges")
    was, is_now = None, mark(now)
    while is_now[0] and was != is_now:
        now = table(star(star(now, True), False), "edges")
        was, is_now = is_now, mark(now)
    return now.select(F.col("u").alias("id"), F.col("v").alias("root"))


def simhash_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", layout: Layout | None = None) -> DataFrame:
    """The rows of docs, without those that are near copies of a row that stays. layout: by default that for the number of rows.

    One row of each group stays: that of the smallest id (of any type that has
    an order), nulls last, and of these the one that comes first by a hash of
    the whole row. Of rows that are equal in every column one stays. A text
    without any word (null and empty ones too) is never a copy: such rows stay,
    all but repeats of whole equal rows. Very long texts are read whole, in
    pieces. An empty table gives an empty one; other columns are kept as they
    are, whatever their names.
    """
    layout = layout_for(docs.count()) if layout is None else layout
    n_bits, lanes = layout.n_bits, layout.lanes
    h1, h2 = row_key(docs)
    keyed = docs.select(quoted(id_col).alias("id"), h1.alias("h1"), h2.alias("h2"), text_of(docs, text_col).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, size = fingerprints(batch.column("text"), n_bits)
            flat = pa.array(prints.view(np.int64).ravel())
            fp = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, lanes, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("id", "h1", "h2")], fp, pa.array(size)], names=["id", "h1", "h2", "fp", "size"])

    slim = table(keyed.mapInArrow(scan, f"id {keyed.schema['id'].dataType.simpleString()}, h1 long, h2 long, fp array<long>, size long"), "fingerprints")
    order = F.struct(F.col("id").isNull(), "id", "h1", "h2").alias("o")
    groups = slim.filter("size > 0").groupBy("fp").agg(F.min(order).alias("o"))
    # numbered once and written, so that a lost executor can't change the numbers
    numbered = table(groups.select("fp", F.col("o.id").alias("id0"), F.col("o.h1").alias("h1"), F.col("o.h2").alias("h2"), F.monotonically_increasing_id().alias("id")), "representatives")
    roots = components(near_edges(numbered.select("id", "fp"), layout))
    of = numbered.join(roots, "id", "left").select("id0", "h1", "h2", F.coalesce("root", "id").alias("root"))
    stay = of.groupBy("root").agg(F.min(F.struct(F.col("id0").isNull().alias("n"), "id0", "h1", "h2")).alias("o")).select(F.col("o.h1").alias("h1"), F.col("o.h2").alias("h2"))
    stay = stay.union(slim.filter("size = 0").select("h1", "h2").distinct())

    a, b, nth = own(docs, "h1", "h2", "nth")
    full = docs.withColumns({a: h1, b: h2}).join(stay.select(F.col("h1").alias(a), F.col("h2").alias(b)).hint("shuffle_hash"), [a, b], "left_semi")
    first = full.withColumn(nth, F.row_number().over(Window.partitionBy(a, b).orderBy(a))).filter(F.col(nth) == 1)
    return first.drop(a, b, nth)


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup(documents(spark, sf_dir))
