"""License scans: MinHash over overlapping windows retrieves, exact containment verifies.

Texts and templates are sets of shingles, pairs of successive case-folded
words. For a template of m shingles, windows have the least power of two W >=
1.25 m of shingles, and one begins every W / 8: some window then holds all of a
copy. A band is one minimum of one of BANDS hash functions; a window is looked
at if any of its bands agrees with the template's. Windows that are looked at
count if they contain enough of the template's shingles, exactly: all but
MISSED, which one changed word costs, or a share LEAST_CONTAINMENT. A window
full of other words has W shingles beside those, so the resemblance of a copy
is above 0.4 and of one with a changed word 0.3 on average for notices of ten
shingles; it is missed with a probability below 0.7 ** BANDS (1e-5), and for the
shortest templates, where it may be 0.2, below 8e-4.

Notices of related licenses differ in a few words. Of two templates that share
most of their shingles, each must be there with all the shingles that the other
lacks (version numbers, "Lesser", "or later"); one that is wholly within another
doesn't count where the other is there whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.common import documents, quoted

BANDS = 32
LEAST_CONTAINMENT = 0.9
#: Shingles that a template may lack, if it has two more than that besides.
MISSED = 2
#: Share of a template's shingles in another from which the two are related.
RELATED = 0.6
NO_SHINGLE = np.uint64(2**64 - 1)

_GNU = {"GPL": "GNU General Public License", "LGPL": "GNU Lesser General Public License", "AGPL": "GNU Affero General Public License"}
_GNU_VERSIONS = [("GPL", "1"), ("GPL", "2"), ("GPL", "3"), ("LGPL", "2.1"), ("LGPL", "3"), ("AGPL", "3")]
_DOTTED = {"1": "1.0", "2": "2.0", "3": "3.0"}
_CREATIVE = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}


def _templates() -> list[tuple[str, str]]:
    out = [
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
        ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
        ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
        ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
        ("MIT", "Released under the MIT License"),
        ("MIT", "Licensed under the MIT License"),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining"),
        ("MIT", "a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
        ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
        ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
        ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
        ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
        ("BSD-2-Clause", "Licensed under the BSD 2-Clause License"),
        ("MPL-2.0", "subject to the terms of the Mozilla Public License, v. 2.0"),
        ("MPL-1.1", "subject to the Mozilla Public License Version 1.1"),
        ("EPL-2.0", "under the terms of the Eclipse Public License 2.0"),
        ("EPL-1.0", "under the terms of the Eclipse Public License v1.0"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
        ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
        ("Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
        ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
        ("Unlicense", "This is free and unencumbered software released into the public domain"),
        ("CC0-1.0", "dedicated to the public domain under CC0 1.0 Universal"),
        ("WTFPL", "Do What The Fuck You Want To Public License"),
    ]
    for short, version in _GNU_VERSIONS:
        dotted = f"{short}-{_DOTTED.get(version, version)}"
        out += [
            (dotted, f"licensed under the {_GNU[short]}, version {version}"),
            (f"{dotted}-or-later", f"under the terms of the {_GNU[short]} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version"),
            (f"{dotted}-only", f"under the terms of the {_GNU[short]} as published by the Free Software Foundation, version {version} of the License only"),
        ]
    for code, name in _CREATIVE.items():
        for version in ("3.0", "4.0"):
            out += [
                (f"CC-{code}-{version}", f"Licensed under CC {code} {version}"),
                (f"CC-{code}-{version}", f"licensed under a Creative Commons {name} {version} International License"),
            ]
    stated = ["MIT", "MIT-0", "ISC", "0BSD", "Zlib", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "Apache-1.1", "Apache-2.0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "BSL-1.0", "Unlicense", "CC0-1.0", "Artistic-2.0", "CDDL-1.0", "CDDL-1.1", "EUPL-1.2", "WTFPL"]
    stated += [f"{short}-{_DOTTED.get(v, v)}-{kind}" for short, v in _GNU_VERSIONS for kind in ("only", "or-later")]
    stated += [f"CC-{code}-{v}" for code in _CREATIVE for v in ("3.0", "4.0")]
    return out + [(x, f"SPDX-License-Identifier: {x}") for x in stated]


#: Notices, paragraphs and tags by which works state their license: (license, text).
TEMPLATES: list[tuple[str, str]] = _templates()


def shingles(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingle that begins at each word (NO_SHINGLE at a row's last), and where each row's words begin."""
    h, _, _, firsts = X.words(buf, offsets)
    out = np.full(len(h), NO_SHINGLE, dtype=np.uint64)
    if len(h) > 1:
        out[:-1] = X.mix64(h[:-1] * X._G + h[1:])
        out[firsts[1:][firsts[1:] > 0] - 1] = NO_SHINGLE
    return out, firsts


def minhash(values: np.ndarray, band: int) -> np.ndarray:
    """One hash function of shingles, 32 bits; that of no shingle is the largest."""
    factor = np.uint64((0xD1342543DE82EF95 * (2 * band + 1) + 2 * band) & (2**64 - 1) | 1)
    return np.where(values == NO_SHINGLE, np.uint32(2**32 - 1), ((values * factor) >> np.uint64(32)).astype(np.uint32))


class Templates:
    """Templates by window size, with their bands."""

    def __init__(self, templates: list[tuple[str, str]]):
        """templates: (license, text). Texts of under three words are refused: nothing could tell them from chance."""
        self.names = [name for name, _ in templates]
        self.sets: list[np.ndarray] = []
        self.classes: dict[int, list[int]] = {}
        for i, (name, text) in enumerate(templates):
            raw = np.frombuffer(text.encode() + bytes(X.PAD), np.uint8)
            own, _ = shingles(raw, np.array([0, len(raw) - X.PAD]))
            own = np.unique(own[own != NO_SHINGLE])
            if len(own) < 2:
                raise ValueError(f"the template of {name} is too short: {text!r}")
            self.sets.append(own)
            size = 2
            while size < 1.25 * len(own):
                size *= 2
            self.classes.setdefault(size, []).append(i)
        # of related templates of another license: what this one must have, and what it must lack in part
        self.needs = [np.zeros(len(own), bool) for own in self.sets]
        self.others: list[list[np.ndarray]] = [[] for _ in self.sets]
        for i, mine in enumerate(self.sets):
            for j, other in enumerate(self.sets):
                shared = np.isin(mine, other)
                if self.names[i] == self.names[j] or shared.mean() < RELATED:
                    continue
                if shared.all():
                    if len(other) > len(mine):
                        self.others[i].append(np.setdiff1d(other, mine))
                else:
                    self.needs[i] |= ~shared
        self.marks: dict[tuple[int, int], tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size, some in self.classes.items():
            for band in range(BANDS):
                least = np.array([minhash(self.sets[i], band).min() for i in some], dtype=np.uint32)
                bits = np.zeros(1 << 16, dtype=bool)
                bits[least & 0xFFFF] = True
                self.marks[size, band] = (bits, least, np.array(some))

    def looked_at(self, values: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(template, window size, starts of the windows of which a band agrees)."""
        found: dict[tuple[int, int], list[np.ndarray]] = {}
        sizes = sorted(self.classes)
        for band in range(BANDS):
            low = np.concatenate([minhash(values, band), np.full(sizes[-1], 2**32 - 1, np.uint32)])
            reach = 1
            for size in sizes:
                while reach < size:
                    low = np.minimum(low[:-reach], low[reach:])
                    reach *= 2
                step = max(1, size // 8)
                bits, least, some = self.marks[size, band]
                grid = low[: len(values) : step]
                hit = np.flatnonzero(bits[grid & np.uint32(0xFFFF)])
                for k in range(len(some)):
                    at = hit[grid[hit] == least[k]]
                    if at.size:
                        found.setdefault((int(some[k]), size), []).append(at * step)
        for (template, size), parts in found.items():
            yield template, size, np.unique(np.concatenate(parts))

    def enough(self, template: int, n: np.ndarray, least: float) -> np.ndarray:
        size = len(self.sets[template])
        return (n >= least * size) | (n >= max(size - MISSED, MISSED + 2))

    def matches(self, values: np.ndarray, firsts: np.ndarray, least: float) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(template, rows, first words, containments) of the windows verified. A window that runs over a row's end is checked for either row."""
        rows = X.row_of(firsts)
        for template, size, starts in self.looked_at(values):
            own, needed = self.sets[template], np.flatnonzero(self.needs[template])
            for at in range(0, len(starts), 4096):
                begin = starts[at : at + 4096]
                places = begin[:, None] + np.arange(size)
                inside = places < len(values)
                places = np.minimum(places, len(values) - 1)
                got = values[places]
                which = np.minimum(np.searchsorted(own, got), len(own) - 1)
                hit = (own[which] == got) & inside
                w, k = np.nonzero(hit)
                row = rows[places[w, k]]
                # distinct (window, row, shingle of the template)
                key = np.unique(np.stack([w, row, which[w, k]], axis=1), axis=0) if w.size else np.zeros((0, 3), np.int64)
                pair, of, n = np.unique(key[:, :2], axis=0, return_inverse=True, return_counts=True) if len(key) else (np.zeros((0, 2), np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
                there = np.bincount(of.ravel()[np.isin(key[:, 2], needed)], minlength=len(n)) if len(key) else n
                for i in np.flatnonzero(self.enough(template, n, least) & (there == len(needed))):
                    window, r = pair[i]
                    own_values = got[window][inside[window] & (rows[places[window]] == r)]
                    if any(np.isin(rest, own_values).all() for rest in self.others[template]):
                        continue
                    yield template, np.array([r]), np.array([max(begin[window] - firsts[r], 0)]), np.array([n[i] / len(own)])


def scan_licenses(docs: DataFrame, templates: list[tuple[str, str]] | None = None, least: float = LEAST_CONTAINMENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, license, containment, first_word): the licenses that each document states.

    containment is the largest of the license's templates, first_word where the
    first window begins in which that was found (of equal ones the first).
    Null and empty texts state none; very long texts are scanned whole; repeated
    rows state theirs each; a null id stays null. An empty table gives an empty
    one. Other columns of docs are not returned, so none can clash.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Templates(TEMPLATES if templates is None else templates))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for a, b, buf, offsets in X.slices(batch.column("text")):
                values, firsts = shingles(buf, offsets)
                best: dict[tuple[int, str], tuple[float, int]] = {}
                for template, rows, words, shares in known.matches(values, firsts, least):
                    for row, word, share in zip(rows.tolist(), words.tolist(), shares.tolist()):
                        key = (row, known.names[template])
                        if key not in best or (share, -word) > (best[key][0], -best[key][1]):
                            best[key] = (share, word)
                if best:
                    keys = sorted(best)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(a, b - a).take(pa.array([k[0] for k in keys])), pa.array([k[1] for k in keys]), pa.array([best[k][0] for k in keys]), pa.array([best[k][1] for k in keys], pa.int64())],
                        names=["id", "license", "containment", "first_word"],
                    )

    given = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    found = given.mapInArrow(run, f"id {given.schema['id'].dataType.simpleString()}, license string, containment double, first_word long")
    return found.select(F.col("id").alias(id_col), "license", "containment", "first_word")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
