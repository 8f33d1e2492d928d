"""BPE encoding and decoding: speculate and verify.

Each distinct piece of a batch is cut greedily into longest tokens. A cut is
the true encoding if and only if no merge could cross any of its seams, which
is a property of adjacent pairs of tokens; it is checked for all distinct pairs
at once by undoing merges from the seam outwards. Only pieces with a failing
pair are merged exactly, rank by rank, all of them in step.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.common import documents, own, quoted
from verdigris.llm.hashing import SortedHash
from verdigris.llm.pretokens import pieces

VOCABULARY = os.path.join("/opt/tokenizers", "byte_bpe_50k.tiktoken")
#: Pieces a worker remembers, with their tokens; it begins anew beyond that.
REMEMBERED = 2_000_000
_NONE = np.iinfo(np.int32).max
#: Longer pieces are merged one by one, by a heap.
_LONG = 256


class Vocabulary:
    """Tokens by rank, with what encoding needs: lookup by bytes, merges by pair, the two parts of each token."""

    def __init__(self, tokens: list[bytes]):
        """tokens[i] has id and rank i; all 256 bytes are tokens."""
        self.n = len(tokens)
        self.lengths = np.array([len(t) for t in tokens], dtype=np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(self.lengths)])
        self.blob = np.frombuffer(b"".join(tokens) + bytes(X.PAD), dtype=np.uint8).copy()
        self.longest = int(self.lengths.max())
        self.by_hash = self._index(X.hash_spans(self.blob, self.offsets[:-1], self.lengths), np.arange(self.n))
        self.of_byte = np.zeros(256, dtype=np.int32)
        single = np.flatnonzero(self.lengths == 1)
        self.of_byte[self.blob[self.offsets[single]]] = single
        if len(single) != 256:
            raise ValueError("a byte-level vocabulary has a token for each of the 256 bytes")
        self._pairs()
        self._parts()

    @staticmethod
    def read(path: str) -> Vocabulary:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        if sorted(ranks.values()) != list(range(len(ranks))):
            raise ValueError("ranks must be 0, 1, 2, ...")
        return Vocabulary(sorted(ranks, key=ranks.get))

    @staticmethod
    def _index(hashes: np.ndarray, ids: np.ndarray) -> tuple[SortedHash, np.ndarray]:
        order = np.argsort(hashes)
        if (np.diff(hashes[order]) == 0).any():
            raise ValueError("two entries of the vocabulary have the same hash")
        return SortedHash(hashes[order]), np.append(ids[order], -1).astype(np.int32)

    def token(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of byte strings given by hash, or -1."""
        table, ids = self.by_hash
        return ids[table.find(hashes)]

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of two adjacent tokens, or _NONE."""
        table, ids = self.by_pair
        at = table.find(X.mix64(a.astype(np.uint64) * np.uint64(self.n) + b.astype(np.uint64) + np.uint64(1)))
        return np.where(at >= 0, ids[at], _NONE)

    def _pairs(self) -> None:
        """All pairs of tokens whose bytes together are a token."""
        lefts, rights, whole = [], [], []
        for cut in range(1, self.longest):
            t = np.flatnonzero(self.lengths > cut)
            size = np.full(len(t), cut, dtype=np.int64)
            a = self.token(X.hash_spans(self.blob, self.offsets[t], size))
            b = self.token(X.hash_spans(self.blob, self.offsets[t] + cut, self.lengths[t] - cut))
            both = (a >= 0) & (b >= 0)
            lefts.append(a[both])
            rights.append(b[both])
            whole.append(t[both])
        a, b, t = (np.concatenate(x) for x in (lefts, rights, whole))
        self.by_pair = self._index(X.mix64(a.astype(np.uint64) * np.uint64(self.n) + b.astype(np.uint64) + np.uint64(1)), t)

    def _parts(self) -> None:
        """The two tokens of which each was merged (itself, for a byte); and which tokens merging can reach."""
        self.left, self.right = np.arange(self.n, dtype=np.int32), np.arange(self.n, dtype=np.int32)
        self.reached = self.lengths == 1
        for t in self._by_width(self.lengths):
            t = t[self.lengths[t] > 1]
            if t.size:
                ids, count = self.merge_exactly(self.blob, self.offsets[t], self.lengths[t], limit=t)
                ok = count == 2
                self.left[t[ok]], self.right[t[ok]] = ids[ok, 0], ids[ok, 1]
                self.reached[t[ok]] = self.merged(ids[ok, 0], ids[ok, 1]) == t[ok]

    @staticmethod
    def _by_width(lengths: np.ndarray) -> Iterator[np.ndarray]:
        """Indices of items of like length, at most 4 MB of padded ids at a time."""
        order = np.argsort(lengths, kind="stable")
        at = 0
        while at < len(order):
            low = int(lengths[order[at]])
            wide = max(8, low + low // 2)
            end = min(int(np.searchsorted(lengths[order], wide, "right")), at + max(1, (1 << 20) // wide))
            yield order[at:end]
            at = end

    def merge_exactly(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, limit: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Merge each piece from its bytes, lowest rank first and leftmost of equals; only ranks below limit. Padded ids and counts."""
        width = int(lengths.max())
        col = np.arange(width)
        inside = col[None, :] < lengths[:, None]
        ids = np.where(inside, self.of_byte[buf[np.minimum(starts[:, None] + col[None, :], len(buf) - 1)]], 0).astype(np.int64)
        count = lengths.astype(np.int64).copy()
        ranks = np.full(ids.shape, _NONE, dtype=np.int64)
        if width > 1:
            both = inside[:, 1:]
            ranks[:, :-1][both] = self.merged(ids[:, :-1][both], ids[:, 1:][both])
        top = np.full(len(starts), _NONE, dtype=np.int64) if limit is None else limit.astype(np.int64)
        live = np.arange(len(starts))
        while live.size:
            r = ranks[live]
            best = r.argmin(axis=1)
            rank = r[np.arange(len(live)), best]
            go = rank < top[live]
            live, best, rank, r = live[go], best[go], rank[go], r[go]
            if not live.size:
                break
            n = np.arange(len(live))
            source = np.minimum(col[None, :] + (col[None, :] > best[:, None]), width - 1)
            now = np.take_along_axis(ids[live], source, 1)
            r = np.take_along_axis(r, source, 1)
            r[:, -1] = _NONE
            now[n, best] = rank
            count[live] -= 1
            size = count[live]
            r[n, best] = _NONE
            after = best + 1 < size
            r[n[after], best[after]] = self.merged(rank[after], now[n[after], best[after] + 1])
            before = best > 0
            r[n[before], best[before] - 1] = self.merged(now[n[before], best[before] - 1], rank[before])
            ids[live], ranks[live] = now, r
        return ids.astype(np.int32), count

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether tokens a and b stay apart when their bytes are encoded together.

        The merges that made a and b are undone from the latest back, on either
        side of the seam. If two parts that once met at the seam could merge
        before the merge that took one of them away, that merge would have come
        first, and the seam is wrong.
        """
        out = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        bound = np.full(len(a), _NONE, dtype=np.int64)
        while live.size:
            clash = self.merged(x, y) < bound
            out[live[clash]] = False
            # the later merge is undone; of two equal ones the right, as merging goes from the left
            late = x > y
            part_x, part_y = self.right[x], self.left[y]
            undo_x = late & (part_x != x)
            undo_y = ~late & (part_y != y)
            # where that one is a byte, the other is undone
            undo_y |= late & (part_x == x) & (part_y != y)
            undo_x |= ~late & (part_y == y) & (part_x != x)
            bound = np.where(undo_x, x, np.where(undo_y, y + 1, bound))
            x, y = np.where(undo_x, part_x, x), np.where(undo_y, part_y, y)
            keep = (undo_x | undo_y) & ~clash
            live, x, y, bound = live[keep], x[keep], y[keep], bound[keep]
        return out

    def greedy(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each piece cut into longest reachable tokens from its left: flat ids and counts."""
        ids, owner = [], []
        live, at, left = np.arange(len(starts)), starts.copy(), lengths.copy()
        while live.size:
            token = np.full(len(live), -1, dtype=np.int32)
            todo = np.arange(len(live))
            size = np.minimum(left, self.longest)
            while todo.size:
                found = self.token(X.hash_spans(buf, at[todo], size[todo]))
                good = (found >= 0) & self.reached[found]
                token[todo[good]] = found[good]
                todo = todo[~good]
                size[todo] -= 1
            ids.append(token)
            owner.append(live)
            step = self.lengths[token]
            at, left = at + step, left - step
            more = left > 0
            live, at, left = live[more], at[more], left[more]
        if not ids:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        flat, owner = np.concatenate(ids), np.concatenate(owner)
        order = np.argsort(owner, kind="stable")
        return flat[order], np.bincount(owner, minlength=len(starts))

    @cached_property
    def ranks(self) -> dict[bytes, int]:
        blob = self.blob.tobytes()
        return {blob[self.offsets[i] : self.offsets[i + 1]]: i for i in range(self.n)}

    def merge_long(self, piece: bytes) -> list[int]:
        """The exact merges of one piece in O(n log n), however long it is."""
        ranks, n = self.ranks, len(piece)
        if piece in ranks:
            return [ranks[piece]]
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (rank := ranks.get(piece[i : end[after[i]]])) is not None:
                heap.append((rank, i, end[after[i]])) if building else heapq.heappush(heap, (rank, i, end[after[i]]))

        building = True
        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        building = False
        gone = bytearray(n)
        while heap:
            _, i, to = heapq.heappop(heap)
            if gone[i] or after[i] >= n or end[after[i]] != to:
                continue
            j = after[i]
            gone[j] = 1
            end[i], after[i] = end[j], after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]

    def encode_pieces(self, buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and counts of the true encodings of pieces."""
        long = lengths > _LONG
        if long.any():
            short = np.flatnonzero(~long)
            flat, n = self.encode_pieces(buf, starts[short], lengths[short])
            parts = np.split(flat, np.cumsum(n)[:-1]) if len(n) else []
            out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(starts)
            for i, part in zip(short, parts):
                out[i] = part
            for i in np.flatnonzero(long):
                out[i] = np.array(self.merge_long(buf[starts[i] : starts[i] + lengths[i]].tobytes()), dtype=np.int32)
            return np.concatenate(out), np.array([len(x) for x in out], dtype=np.int64)
        flat, count = self.greedy(buf, starts, lengths)
        if not len(flat):
            return flat, count
        owner = np.repeat(np.arange(len(starts)), count)
        seam = np.flatnonzero(owner[1:] == owner[:-1])
        pair, which = np.unique(flat[seam].astype(np.int64) * self.n + flat[seam + 1], return_inverse=True)
        bad = np.zeros(len(starts), dtype=bool)
        bad[owner[seam[~self.compatible(pair // self.n, pair % self.n)[which]]]] = True
        # a piece that is a token is that token, reachable or not
        whole = self.token(X.hash_spans(buf, starts, lengths))
        single = whole >= 0
        bad &= ~single
        fix = np.flatnonzero(bad)
        if not fix.size and not (single & (count != 1)).any():
            return flat, count
        out_count = np.where(single, 1, count)
        fixed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for part in self._by_width(lengths[fix]):
            at = fix[part]
            ids, n = self.merge_exactly(buf, starts[at], lengths[at])
            out_count[at] = n
            fixed.append((at, ids, n))
        first = np.concatenate([[0], np.cumsum(out_count)])
        out = np.empty(first[-1], dtype=np.int32)
        same = ~bad & ~single
        keep = same[owner]
        within = np.arange(len(flat)) - np.repeat(np.cumsum(count) - count, count)
        out[(first[owner] + within)[keep]] = flat[keep]
        out[first[:-1][single]] = whole[single]
        for at, ids, n in fixed:
            row = np.repeat(np.arange(len(at)), n)
            within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out[first[at][row] + within] = ids[row, within]
        return out, out_count

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of tokens, end to end."""
        size = self.lengths[ids]
        end = np.cumsum(size)
        total = int(end[-1]) if len(end) else 0
        return self.blob[np.repeat(self.offsets[ids] - (end - size), size) + np.arange(total)]


def gather(flat: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """flat[first[i]:first[i]+count[i]] for all i, end to end."""
    end = np.cumsum(count)
    total = int(end[-1]) if len(end) else 0
    return flat[np.repeat(first - (end - count), count) + np.arange(total)]


class Encoder:
    """Encodes batches of texts; remembers the pieces it has met."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.most = vocabulary, remembered
        self.forget()

    def forget(self) -> None:
        self.keys, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _known(self, h: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, h)
        ok = at < len(self.keys)
        ok[ok] = self.keys[at[ok]] == h[ok]
        return np.where(ok, at, -1)

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of a slice's rows, and where each row's begin."""
        starts, firsts = pieces(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        lengths = np.diff(np.append(starts, offsets[-1]))
        h = X.hash_spans(buf, starts, lengths)
        distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
        if len(self.keys) > self.most:
            self.forget()
        known = self._known(distinct)
        new = np.flatnonzero(known < 0)
        if new.size:
            flat, count = self.v.encode_pieces(buf, starts[where[new]], lengths[where[new]])
            first = len(self.flat) + np.cumsum(count) - count
            keys = np.concatenate([self.keys, distinct[new]])
            order = np.argsort(keys, kind="stable")
            self.keys, self.first, self.count = keys[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count.astype(np.int32)])[order]
            self.flat = np.concatenate([self.flat, flat])
            known = np.searchsorted(self.keys, distinct)
        at = known[which]
        count = self.count[at].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(count)])
        return gather(self.flat, self.first[at], count), ends[firsts]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Slice by slice: flat ids, where each row's begin, and whether decoding gave the very bytes back."""
        for _, _, buf, offsets in X.slices(column):
            ids, firsts = self.encode(buf, offsets)
            intact = self._intact(buf, offsets, ids, firsts)
            if not intact.all():  # two pieces of equal hash: encode these rows by themselves, without memory
                kept = (self.keys, self.first, self.count, self.flat)
                parts, sizes = [], []
                for r in range(len(offsets) - 1):
                    row = ids[firsts[r] : firsts[r + 1]]
                    if not intact[r]:
                        self.forget()
                        own_buf = np.append(buf[offsets[r] : offsets[r + 1]], np.zeros(X.PAD, np.uint8))
                        starts, _ = pieces(own_buf, np.array([0, len(own_buf) - X.PAD]))
                        row, _ = self.v.encode_pieces(own_buf, starts, np.diff(np.append(starts, len(own_buf) - X.PAD)))
                    parts.append(row)
                    sizes.append(len(row))
                ids, firsts = np.concatenate(parts), np.concatenate([[0], np.cumsum(sizes)])
                self.keys, self.first, self.count, self.flat = kept
                intact = self._intact(buf, offsets, ids, firsts)
            yield ids, firsts, intact

    def _intact(self, buf: np.ndarray, offsets: np.ndarray, ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        back = self.v.decode(ids)
        ends = np.concatenate([[0], np.cumsum(self.v.lengths[ids])])[firsts]
        if len(back) == offsets[-1] and np.array_equal(ends, offsets) and np.array_equal(back, buf[: offsets[-1]]):
            return np.ones(len(offsets) - 1, dtype=bool)
        return np.array([np.array_equal(back[ends[i] : ends[i + 1]], buf[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)], dtype=bool)


_ENCODERS: dict[int, Encoder] = {}


def worker_encoder(shared) -> Encoder:
    """The worker's encoder for a broadcast vocabulary; it stays for the worker's later tasks."""
    if shared.value.key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[shared.value.key] = Encoder(shared.value)
    return _ENCODERS[shared.value.key]


def broadcast_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """A vocabulary's size is fixed, some MB; it doesn't grow with the data."""
    v = Vocabulary.read(path)
    v.key = hash(v.blob.tobytes())
    return spark.sparkContext.broadcast(v)


def encode_texts(docs: DataFrame, vocabulary: str = VOCABULARY, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """docs with columns added: tokens (array<int>), n_tokens (int) and intact (boolean); and their names.

    The tokens are those of ordinary text: no special tokens are sought or
    added. intact says that the tokens decode to the very text. Null texts have
    null tokens, n_tokens 0 and are intact; empty ones have an empty array.
    """
    tokens, n, intact, text = own(docs, "tokens", "n_tokens", "intact", "text")
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            column, row = batch.column(text), 0
            for ids, firsts, ok in encoder.encode_column(column):
                rows = len(firsts) - 1
                part = batch.slice(row, rows)
                null = part.column(text).is_null()
                values = pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids), mask=null)
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in names], values, pa.array(np.diff(firsts).astype(np.int32)), pa.array(ok)], names=[*names, tokens, n, intact])
                row += rows

    given = docs.withColumn(text, quoted(text_col).cast("string"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", {tokens} array<int>, {n} int, {intact} boolean"
    return given.mapInArrow(run, schema), {"tokens": tokens, "n_tokens": n, "intact": intact}


def decode_tokens(tokens: DataFrame, vocabulary: str = VOCABULARY, column: str = "tokens") -> tuple[DataFrame, str]:
    """tokens with their text added, in a column whose name is returned. Null gives null; an id outside the vocabulary is an error."""
    (text,) = own(tokens, "text")
    shared = broadcast_vocabulary(tokens.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        for batch in batches:
            ids = batch.column(column)
            flat = ids.flatten().to_numpy(zero_copy_only=False)
            if len(flat) and (flat.min() < 0 or flat.max() >= v.n):
                raise ValueError("a token id is outside the vocabulary")
            size = np.array([0 if x is None else x for x in ids.value_lengths().to_pylist()], dtype=np.int64)
            firsts = np.concatenate([[0], np.cumsum(size)])
            ends = np.concatenate([[0], np.cumsum(v.lengths[flat])])[firsts]
            raw = v.decode(flat).tobytes()
            out = pa.array([None if null else raw[ends[i] : ends[i + 1]].decode("utf-8", "replace") for i, null in enumerate(ids.is_null().to_pylist())], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, text])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema.fields) + f", {text} string"
    return tokens.mapInArrow(run, schema), text


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, intact, tokens) of every document."""
    out, c = encode_texts(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", F.col(c["n_tokens"]).alias("n_tokens"), F.col(c["intact"]).alias("intact"), F.col(c["tokens"]).alias("tokens"))
