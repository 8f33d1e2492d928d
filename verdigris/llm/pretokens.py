"""The split of text that precedes byte-level BPE, on whole batches of UTF-8 bytes.

Gives the pieces of the public pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``
from runs of equal character classes: the pieces tile the text, so their
starts say all.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
_SPACES = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    out = np.array([{"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], dtype=np.uint8)
    out[_SPACES] = SPACE
    return out


def byte_classes(buf: np.ndarray, total: int) -> np.ndarray:
    """The class of the character to which each byte belongs."""
    table = _classes()
    ascii_only = table[:256].copy()
    ascii_only[128:] = OTHER
    out = ascii_only[buf[:total]]
    lead = np.flatnonzero(buf[:total] >= 0xC0)
    if lead.size:
        b0 = buf[lead].astype(np.int64)
        b1, b2, b3 = (buf[lead + i].astype(np.int64) & 0x3F for i in (1, 2, 3))
        two, four = b0 < 0xE0, b0 >= 0xF0
        point = np.where(two, (b0 & 0x1F) << 6 | b1, np.where(four, (b0 & 7) << 18 | b1 << 12 | b2 << 6 | b3, (b0 & 15) << 12 | b1 << 6 | b2))
        kind = table[np.minimum(point, sys.maxunicode)]
        out[lead] = kind
        for i, some in ((1, b0 >= 0xC0), (2, ~two), (3, four)):
            at = lead[some] + i
            inside = at < total
            out[at[inside]] = kind[some][inside]
    return out


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the pieces of all rows, and where each row's begin among them. A piece ends where the next begins."""
    total = int(offsets[-1])
    if not total:
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = byte_classes(buf, total)
    new = np.empty(total, bool)
    new[0] = True
    new[1:] = kind[1:] != kind[:-1]
    edge = np.zeros(total + 1, bool)
    edge[offsets] = True
    new |= edge[:total]
    start = np.flatnonzero(new)
    end = np.append(start[1:], total)
    of = kind[start]
    first, last = edge[start], edge[end]  # of its row

    # a space before a run of another class is part of it
    joined = np.flatnonzero((of != SPACE) & ~first)
    joined = joined[(of[joined - 1] == SPACE) & (buf[start[joined] - 1] == 0x20)]
    new[start[joined]] = False
    new[start[joined] - 1] = True
    # of other white space, the last character stands alone
    alone = np.flatnonzero((of == SPACE) & ~last)
    alone = alone[buf[end[alone] - 1] != 0x20]
    at = end[alone] - 1
    while (back := (buf[at] & 0xC0) == 0x80).any():
        at[back] -= 1
    new[at] = True
    # 's and the like, where the apostrophe is a run of its own and no space precedes
    quote = np.flatnonzero((of == OTHER) & (end - start == 1) & (buf[start] == 0x27) & ~last)
    quote = quote[(of[quote + 1] == LETTER) & new[start[quote]]]
    if quote.size:
        at = start[quote + 1]
        long = end[quote + 1] - at
        a, b = buf[at], buf[at + 1]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = (long > 1) & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        size = np.where(one, 1, np.where(two, 2, 0))
        some = size > 0
        new[at[some]] = False
        more = some & (size < long)
        new[at[more] + size[more]] = True
    starts = np.flatnonzero(new)
    return starts, np.searchsorted(starts, offsets)
