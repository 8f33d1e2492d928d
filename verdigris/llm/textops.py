"""NumPy kernels over Arrow string columns: words, their hashes and per-document slices.

All kernels take whole texts. Rows are handled in slices of a few MB, so that
a worker's memory stays bounded whatever the Arrow batch holds; a single text
that is longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
SLICE_ROWS = 1 << 16
PAD = 16

_M1, _M2, _G = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)
_MASK8 = np.array([(1 << (8 * i)) - 1 for i in range(8)] + [(1 << 64) - 1], dtype=np.uint64)

#: Letters and digits of ASCII, and every byte of a longer UTF-8 sequence, are word bytes.
WORD_BYTE = np.zeros(256, dtype=bool)
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    WORD_BYTE[_lo:_hi] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix64(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of h."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; PAD zero bytes follow the text."""
    data, offsets = string_parts(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        end = min(max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1), at + SLICE_ROWS, n)
        part = data[offsets[at] : offsets[end]]
        buf = np.zeros(len(part) + PAD, dtype=np.uint8)
        buf[: len(part)] = part
        yield at, end, buf, offsets[at : end + 1] - offsets[at]
        at = end


def fold_case(buf: np.ndarray) -> np.ndarray:
    """Lower case for ASCII and for the letters of Latin-1."""
    low = _LOWER[buf]
    at = np.flatnonzero(buf[:-1] == 0xC3) + 1
    if at.size:
        second = low[at]
        low[at] = np.where((second >= 0x80) & (second <= 0x9E) & (second != 0x97), second + 0x20, second)
    return low


def runs(mask: np.ndarray, offsets: np.ndarray, cuts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of mask, cut at rows (and where cuts is set); and where the runs of each row begin among them."""
    total = int(offsets[-1])
    mask = mask[:total]
    before, after = np.empty(total, bool), np.empty(total, bool)
    if total:
        before[0], before[1:] = False, mask[:-1]
        after[-1], after[:-1] = False, mask[1:]
        edges = offsets[(offsets > 0) & (offsets < total)]
        before[edges] = False
        after[edges - 1] = False
        if cuts is not None:
            before &= ~cuts[:total]
            after[:-1] &= ~cuts[1:total]
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def load8(buf: np.ndarray) -> np.ndarray:
    """Every 8 consecutive bytes as one little-endian number."""
    return np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))


def hash_spans(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans; equal bytes have equal hashes, in any batch."""
    eight = load8(buf)
    h = eight[starts] & _MASK8[np.minimum(lengths, 8)]
    h = mix64(h * _G + lengths.astype(np.uint64))
    todo, done = np.flatnonzero(lengths > 8), 8
    while todo.size:
        rest = lengths[todo] - done
        h[todo] = mix64(h[todo] * _G + (eight[starts[todo] + done] & _MASK8[np.minimum(rest, 8)]))
        done += 8
        todo = todo[rest > 8]
    return h


_WIDE = np.zeros(256, dtype=bool)
_WIDE[0xE3:0xEA] = _WIDE[0xF0] = True


def wide_cuts(buf: np.ndarray) -> np.ndarray | None:
    """Where characters of scripts without spaces (kana, ideographs, Thai and its kin, and all beyond the basic plane) begin and end, if there are any: each is a word of its own."""
    wide = _WIDE[buf]
    thai = np.flatnonzero(buf[:-1] == 0xE0)
    thai = thai[(buf[thai + 1] >= 0xB8) & (buf[thai + 1] <= 0xBB)]
    wide[thai] = True
    at = np.flatnonzero(wide)
    if not at.size:
        return None
    cuts = wide
    ends = at + np.where(buf[at] == 0xF0, 4, 3)
    cuts[ends[ends < len(buf)]] = True
    return cuts


def words(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and lengths of case-folded words, and where each row's begin among them; see wide_cuts() for scripts without spaces."""
    low = fold_case(buf)
    starts, ends, firsts = runs(WORD_BYTE[low], offsets, wide_cuts(buf))
    return hash_spans(low, starts, ends - starts), starts, ends - starts, firsts


def row_of(firsts: np.ndarray) -> np.ndarray:
    """The row of each item, from where the items of each row begin."""
    return np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))


def segment_sums(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums by row; 0 for a row without items. Floats are summed row by row, so a row's sum doesn't depend on its neighbours."""
    out = np.zeros((len(firsts) - 1, *values.shape[1:]), dtype=values.dtype)
    some = np.flatnonzero(np.diff(firsts))
    if some.size:
        out[some] = np.add.reduceat(values, firsts[some], axis=0, dtype=values.dtype)
    return out
