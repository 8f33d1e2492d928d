"""Token-ID output: a wavelet matrix for each shard, in one compressed file.

A shard is a run of documents, encoded as by bpe.py and laid end to end. Its
wavelet matrix holds the tokens bit by bit from the highest: each plane has one
bit a token, and the next plane sees the tokens with a 0 before those with a 1.
Ranks and selects on the planes give the token at any place, how often a token
occurs in a range, and where it occurs, in time that depends on the number of
planes only. Planes are stored as blocks of BLOCK_BITS bits, each compressed by
itself behind a directory of the ones before it: a lookup reads the blocks that
it touches, not the file.

Layout: magic, the length of the header, the header (compressed), the blocks.
"""

from __future__ import annotations

import io
import struct
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from verdigris.llm.bpe import VOCABULARY, broadcast_vocabulary, worker_encoder
from verdigris.llm.common import documents, quoted

MAGIC = b"VDWM0001"
#: A shard is closed with the document that brings it to as many tokens.
SHARD_TOKENS = 4_000_000
BLOCK_BITS = 1 << 18
_HELD_BLOCKS = 256


def build_planes(tokens: np.ndarray, bits: int) -> tuple[list[np.ndarray], np.ndarray]:
    """The planes as packed bytes, from the highest bit, and each one's zeros."""
    planes, zeros, now = [], np.zeros(bits, np.int64), tokens
    for level in range(bits):
        one = (now >> (bits - 1 - level)) & 1 == 1
        planes.append(np.packbits(one, bitorder="little"))
        low = now[~one]
        zeros[level] = len(low)
        now = np.concatenate([low, now[one]])
    return planes, zeros


def pack(tokens: np.ndarray, firsts: np.ndarray, doc_ids: list[int | None], bits: int) -> bytes:
    """A shard's file: tokens, where each document's begin (and where the last ends), the documents' ids."""
    planes, zeros = build_planes(tokens, bits)
    press = zstandard.ZstdCompressor(level=3)
    step, blocks, before = BLOCK_BITS // 8, [], []
    for plane in planes:
        parts = [plane[at : at + step] for at in range(0, len(plane), step)]
        ones = np.array([int(np.bitwise_count(p).sum()) for p in parts], dtype=np.int64)
        before.append(np.cumsum(ones) - ones)
        blocks += [press.compress(p.tobytes()) for p in parts]
    header = io.BytesIO()
    np.savez(
        header,
        shape=np.array([len(tokens), bits, len(doc_ids), -(-len(planes[0]) // step) if bits and len(tokens) else 0], np.int64),
        zeros=zeros,
        before=np.array(before, np.int64).reshape(bits, -1),
        sizes=np.array([len(b) for b in blocks], np.int64),
        lengths=np.diff(firsts).astype(np.int64),
        ids=np.array([0 if i is None else i for i in doc_ids], np.int64),
        null=np.array([i is None for i in doc_ids], bool),
    )
    head = press.compress(header.getvalue())
    return b"".join([MAGIC, struct.pack("<Q", len(head)), head, *blocks])


class TokenFile:
    """Lookups in a packed shard. Places are of the shard's tokens, from 0; arguments may be arrays."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<Q", data, 8)
        head = np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data[16 : 16 + size])))
        self.n, self.bits, self.n_docs, self.per_plane = (int(x) for x in head["shape"])
        self.zeros, self.before, sizes = head["zeros"], head["before"], head["sizes"]
        self.firsts = np.concatenate([[0], np.cumsum(head["lengths"])])
        self.doc_ids = [None if null else int(i) for i, null in zip(head["ids"], head["null"])]
        self.at = 16 + size + np.concatenate([[0], np.cumsum(sizes)])
        self.data, self.held = data, OrderedDict()

    def _block(self, level: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """A block's 64-bit words and the ones before each of them."""
        key = level * self.per_plane + k
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        raw = zstandard.ZstdDecompressor().decompress(self.data[self.at[key] : self.at[key + 1]])
        words = np.frombuffer(raw + bytes(-len(raw) % 8 + 8), "<u8")
        ones = np.bitwise_count(words).astype(np.int64)
        self.held[key] = words, self.before[level, k] + np.cumsum(ones) - ones
        if len(self.held) > _HELD_BLOCKS:
            self.held.popitem(last=False)
        return self.held[key]

    def _by_block(self, blocks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        for k in np.unique(blocks):
            yield int(k), np.flatnonzero(blocks == k)

    def _rank1(self, level: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones before each place, and the bit there (0 at the end)."""
        rank, bit = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
        if not self.n:
            return rank, bit
        for k, some in self._by_block(np.minimum(place // BLOCK_BITS, self.per_plane - 1)):
            words, ones = self._block(level, k)
            local = place[some] - k * BLOCK_BITS
            word, shift = local >> 6, (local & 63).astype(np.uint64)
            rank[some] = ones[word] + np.bitwise_count(words[word] & ((np.uint64(1) << shift) - np.uint64(1)))
            bit[some] = ((words[word] >> shift) & np.uint64(1)).astype(np.int64)
        return rank, bit

    def _select(self, level: int, nth: np.ndarray, one: bool) -> np.ndarray:
        """The place of the nth (from 0) one or zero of a plane."""
        starts = np.arange(self.per_plane, dtype=np.int64) * BLOCK_BITS
        before = self.before[level] if one else starts - self.before[level]
        out = np.zeros(len(nth), np.int64)
        for k, some in self._by_block(np.searchsorted(before, nth, "right") - 1):
            words, ones = self._block(level, k)
            upto = ones if one else starts[k] + 64 * np.arange(len(words)) - ones
            word = np.searchsorted(upto, nth[some], "right") - 1
            left = nth[some] - upto[word]
            bits = words[word] if one else ~words[word]
            table = np.cumsum(np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), axis=1)
            out[some] = starts[k] + word * 64 + (table <= left[:, None]).sum(axis=1)
        return out

    def access(self, places) -> np.ndarray:
        """The tokens at these places."""
        place = np.atleast_1d(np.asarray(places, np.int64))
        if len(place) and (place.min() < 0 or place.max() >= self.n):
            raise IndexError("a place is outside the shard")
        out = np.zeros(len(place), np.int64)
        for level in range(self.bits):
            rank, bit = self._rank1(level, place)
            out = out << 1 | bit
            place = np.where(bit == 1, self.zeros[level] + rank, place - rank)
        return out

    def rank(self, tokens, places) -> np.ndarray:
        """How often each token occurs before its place."""
        token, place = np.broadcast_arrays(np.atleast_1d(np.asarray(tokens, np.int64)), np.atleast_1d(np.asarray(places, np.int64)))
        lo, hi = self._range(token, np.zeros(len(token), np.int64), place)
        return hi - lo

    def _range(self, token: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the token's occurrences in [lo, hi) stand below the lowest plane."""
        for level in range(self.bits):
            one = (token >> (self.bits - 1 - level)) & 1 == 1
            a, b = self._rank1(level, lo)[0], self._rank1(level, hi)[0]
            lo, hi = np.where(one, self.zeros[level] + a, lo - a), np.where(one, self.zeros[level] + b, hi - b)
        known = (token >= 0) & (token < 1 << self.bits)
        return lo, np.where(known, hi, lo)

    def count(self, tokens, lo=0, hi=None) -> np.ndarray:
        """How often each token occurs in [lo, hi)."""
        hi = self.n if hi is None else hi
        return self.rank(tokens, hi) - self.rank(tokens, lo)

    def occurrences(self, token: int, lo: int = 0, hi: int | None = None) -> np.ndarray:
        """The places in [lo, hi) at which the token occurs, in order."""
        hi = self.n if hi is None else hi
        a, b = self._range(np.array([token]), np.array([lo]), np.array([hi]))
        place = np.arange(a[0], b[0], dtype=np.int64)
        for level in range(self.bits - 1, -1, -1) if len(place) else ():
            one = token >> (self.bits - 1 - level) & 1 == 1
            place = self._select(level, place - self.zeros[level] if one else place, one)
        return place

    def document(self, k: int) -> np.ndarray:
        """The tokens of the shard's k-th document."""
        return self.access(np.arange(self.firsts[k], self.firsts[k + 1]))

    def document_at(self, places) -> np.ndarray:
        """Which document (from 0) each place belongs to."""
        return np.searchsorted(self.firsts, np.asarray(places), "right") - 1


def token_shards(docs: DataFrame, vocabulary: str = VOCABULARY, shard_tokens: int = SHARD_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(shard, n_docs, n_tokens, n_bytes, doc_ids, data): the shards of docs, data being the file for TokenFile.

    Each partition of docs makes its own shards, in its order, without a
    shuffle; a shard's name is the partition's number and its own there. No
    document is split, so a shard is longer than shard_tokens by less than a
    document. Null and empty texts are documents of 0 tokens; null ids stay
    null, and repeated rows stay as they are. An empty table has no shards.
    n_bytes is the length of the texts in UTF-8.
    """
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)
    names = ["shard", "n_docs", "n_tokens", "n_bytes", "doc_ids", "data"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        bits = max(1, int(encoder.v.n - 1).bit_length())
        part, nth = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[int | None] = []
        n = n_bytes = 0

        def close() -> pa.RecordBatch:
            tokens = np.concatenate(held)
            firsts = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
            row = [f"{part:06d}-{nth:04d}", len(ids), len(tokens), n_bytes, ids, pack(tokens, firsts, ids, bits)]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names=names)

        for batch in batches:
            column, row = batch.column("id").to_pylist(), 0
            for flat, firsts, intact in encoder.encode_column(batch.column("text")):
                if not intact.all():
                    raise ValueError("a text doesn't survive encoding and decoding")
                at, rows = 0, len(firsts) - 1
                while at < rows:  # as many documents as fill the shard
                    end = min(rows, max(at + 1, int(np.searchsorted(firsts, firsts[at] + shard_tokens - n, "left"))))
                    held.append(flat[firsts[at] : firsts[end]])
                    sizes.append(np.diff(firsts[at : end + 1]))
                    ids += column[row + at : row + end]
                    n += int(firsts[end] - firsts[at])
                    n_bytes += int(encoder.v.lengths[held[-1]].sum())
                    at = end
                    if n >= shard_tokens:
                        yield close()
                        held, sizes, ids, n, n_bytes, nth = [], [], [], 0, 0, nth + 1
                row += rows
        if ids:
            yield close()

    given = docs.select(quoted(id_col).cast("long").alias("id"), quoted(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "shard string, n_docs long, n_tokens long, n_bytes long, doc_ids array<long>, data binary")


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(documents(spark, sf_dir))
