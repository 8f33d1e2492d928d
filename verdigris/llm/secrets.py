"""Secret scans by token efficiency.

Random strings take many tokens: under a vocabulary made for text, words and
names have three or more characters to a token, random ones fewer than two.
Candidates are runs of the characters of keys and encodings; '=' belongs to a
run as padding at its end only, so that the name in ``name=value`` isn't part
of the value. Where a run as a whole isn't random, its parts between '/', and
those between '_' and '-', are candidates too (paths, prefixed keys). The ratio
of characters to tokens is that of exact encoding.

Strings that are random by nature but not secret are excluded by shape: digests
of the usual lengths in hex, UUIDs, dates and times, version numbers, ISBNs,
and any that the caller knows (`known`). A string that the text assigns to a
credential (``token = "..."``) is no digest, whatever its shape.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigris.llm import textops as X
from verdigris.llm.bpe import VOCABULARY, broadcast_vocabulary, worker_encoder
from verdigris.llm.common import documents, quoted

#: Least length of a candidate, and of one that is assigned to a credential.
LEAST_CHARS, LEAST_ASSIGNED = 16, 8
#: A secret has this many characters to a token at most; one of letters alone fewer, as long words strange to the vocabulary come to 1.6.
MOST_CHARS_PER_TOKEN, MOST_OF_LETTERS = 2.2, 1.5
#: Bytes before a candidate in which its name is sought.
CONTEXT = 48

_KEY_BYTE = np.zeros(256, dtype=bool)
_KEY_BYTE[np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", np.uint8)] = True
_DIGIT, _LETTER = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_LETTER[65:91] = _LETTER[97:123] = True
#: How a run is taken apart, one after the other.
_SEPARATORS = (b"", b"/", b"_-")

_CREDENTIAL = re.compile(rb"(?:token|secret|passw(?:or)?d|passwd|pwd|credentials?|bearer|auth(?:orization)?|api[_\- ]?key|access[_\- ]?key|private[_\- ]?key)[^A-Za-z0-9\n]{1,16}\Z", re.IGNORECASE)
_DIGEST = re.compile(rb"(?:(?:md5|sha1|sha256|sha512)[-=_])?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
_IDENTIFIER = re.compile(
    rb"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"
    rb"|\d{4}-\d\d-\d\d(?:[T_-][\d-]+)?[A-Z]*"
    rb"|[A-Za-z]{0,10}[_-]?v?\d+(?:[_-]\d+)*(?:[_-][A-Za-z]{1,10})?"
    rb"|(?:ISBN|ISSN|DOI)[\d=X-]+",
    re.IGNORECASE,
)


def is_credential(before: bytes) -> bool:
    """Whether text that ends in `before` assigns what follows to a credential."""
    return _CREDENTIAL.search(before) is not None


def is_excluded(candidate: bytes, assigned: bool) -> bool:
    """Whether the shape is that of something random but not secret."""
    return _IDENTIFIER.fullmatch(candidate) is not None or not assigned and _DIGEST.fullmatch(candidate) is not None


def candidates(buf: np.ndarray, offsets: np.ndarray, least: int = LEAST_ASSIGNED) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, starts and ends (in the slice) of the strings that may be keys, and the run that each is of: first whole runs, then their parts."""
    runs, run_ends, firsts = X.runs(_KEY_BYTE[buf], offsets)
    run_rows = X.row_of(firsts)
    total = int(offsets[-1])
    digits, letters = (np.concatenate([[0], np.cumsum(kind[buf[:total]])]) for kind in (_DIGIT, _LETTER))
    some = np.flatnonzero(run_ends - runs >= least)
    for cut in _SEPARATORS:
        key = _KEY_BYTE.copy()
        key[np.frombuffer(cut, np.uint8)] = False
        starts, ends = runs[some], run_ends[some]
        if cut:
            # runs of the kinds of bytes that are left, each within one of the runs above
            starts, ends, _ = X.runs(key[buf], offsets)
            long = np.flatnonzero(ends - starts >= least)
            starts, ends = starts[long], ends[long]
        of = np.searchsorted(runs, starts, "right") - 1
        if cut:
            part = np.flatnonzero((starts > runs[of]) | (ends < run_ends[of]))
            starts, ends, of = starts[part], ends[part], of[part]
        while (lead := (starts < ends) & (buf[starts] == ord("-"))).any():
            starts = starts + lead
        # padding: one or two '=' where the run ends, if no key goes on after them
        closing = ends == run_ends[of]
        limit = offsets[1:][run_rows[of]]
        is_pad = lambda at: (at < limit) & (buf[np.minimum(at, total)] == ord("="))
        pads = np.where(is_pad(ends), np.where(is_pad(ends + 1), 2, 1), 0)
        after = np.minimum(ends + pads, total)
        goes_on = (ends + pads < limit) & (_KEY_BYTE[buf[after]] | (buf[after] == ord("=")))
        ends = ends + np.where(closing & ~goes_on, pads, 0)
        size = ends - starts
        n_digits, n_letters = digits[ends] - digits[starts], letters[ends] - letters[starts]
        ok = (n_letters > 0) & (n_digits > 0) & (size >= least) | (n_letters == size) & (size >= max(least, LEAST_CHARS))
        yield run_rows[of[ok]], starts[ok], ends[ok], of[ok]


def scan_secrets(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str = VOCABULARY,
    least_chars: int = LEAST_CHARS,
    most_chars_per_token: float = MOST_CHARS_PER_TOKEN,
    known: DataFrame | None = None,
    least_assigned: int = LEAST_ASSIGNED,
    most_of_letters: float = MOST_OF_LETTERS,
) -> DataFrame:
    """(id_col, start_byte, n_chars, n_tokens, chars_per_token, assigned, digest): each secret found, as often as it occurs.

    digest is the MD5 of the secret, which itself is not returned. assigned says
    that the text names it a credential; such a one may have least_assigned
    characters, others have least_chars. A part of a run is reported only where
    the whole isn't, and a smaller part only where the larger isn't.
    known: one column of strings that are no secrets (digests, public
    identifiers); null among them is none. Null and empty texts have no secret;
    very long texts are scanned whole, and one run may be as long as the text;
    repeated rows have theirs each; ties (one string twice) are two rows; a null
    id stays null. An empty table gives an empty one. Columns of docs other than
    these two are not returned, so none can clash.
    """
    shared = broadcast_vocabulary(docs.sparkSession, vocabulary)
    names = ["id", "start_byte", "secret", "n_tokens", "assigned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_encoder(shared)
        for batch in batches:
            for a, b, buf, offsets in X.slices(batch.column("text")):
                found, taken = [], []  # taken: the stretches of runs that are settled, found or excluded
                for rows, starts, ends, of in candidates(buf, offsets, min(least_chars, least_assigned)):
                    if not len(rows):
                        continue
                    if taken:
                        begin, until = (np.array(x) for x in zip(*sorted(taken)))
                        at = np.searchsorted(begin, starts, "right") - 1
                        free = (at < 0) | (ends > until[at])
                        rows, starts, ends = rows[free], starts[free], ends[free]
                    size = ends - starts
                    firsts = np.concatenate([[0], np.cumsum(size)])
                    joined = np.zeros(firsts[-1] + X.PAD, np.uint8)
                    joined[: firsts[-1]] = buf[np.arange(firsts[-1]) + np.repeat(starts - firsts[:-1], size)]
                    n = np.diff(encoder.encode(joined, firsts)[1])
                    has_digit = np.add.reduceat(_DIGIT[joined[:-X.PAD]].astype(np.int64), firsts[:-1]) > 0 if len(size) else np.zeros(0, bool)
                    for i in np.flatnonzero(size <= n * np.where(has_digit, most_chars_per_token, most_of_letters)):
                        row, start, end = int(rows[i]), int(starts[i]), int(ends[i])
                        text = joined[firsts[i] : firsts[i + 1]].tobytes()
                        assigned = is_credential(buf[max(offsets[row], start - CONTEXT) : start].tobytes())
                        if size[i] < (least_assigned if assigned and has_digit[i] else least_chars):
                            continue
                        taken.append((start, end))
                        if not is_excluded(text, assigned):
                            found.append((start, row, text, int(n[i]), assigned))
                    excluded = np.flatnonzero((size > n * np.where(has_digit, most_chars_per_token, most_of_letters)) & has_digit)
                    # what has the shape of an identifier isn't taken apart
                    taken += [(int(starts[i]), int(ends[i])) for i in excluded if is_excluded(joined[firsts[i] : firsts[i + 1]].tobytes(), False)]
                if found:
                    found.sort()
                    at = [x[1] for x in found]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("id").slice(a, b - a).take(pa.array(at, pa.int64())), pa.array([int(x[0] - offsets[x[1]]) for x in found], pa.int64()), pa.array([x[2].decode() for x in found], pa.string()), pa.array([x[3] for x in found], pa.int64()), pa.array([x[4] for x in found], pa.bool_())],
                        names=names,
                    )

    given = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    found = given.mapInArrow(run, f"id {kind}, start_byte long, secret string, n_tokens long, assigned boolean")
    if known is not None:
        found = found.join(known.select(F.col(known.columns[0]).cast("string").alias("secret")).distinct(), "secret", "left_anti")
    size = F.length("secret").cast("long")
    return found.select(F.col("id").alias(id_col), "start_byte", size.alias("n_chars"), "n_tokens", (size / F.col("n_tokens")).alias("chars_per_token"), "assigned", F.md5("secret").alias("digest"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
