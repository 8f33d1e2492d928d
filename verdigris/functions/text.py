"""Text normalization, the same for what is indexed and what is asked."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from verdigris.config import Normalization
from verdigris.functions.match import let

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Texts of ASCII alone, the most of many corpora, take the shorter way of each step.
_OTHER = r"[^\x00-\x7F]"


#: Blocks whose letters NFKC mostly leaves: Latin, Greek, Cyrillic, punctuation, kana.
_BLOCKS = ((0x80, 0x250), (0x370, 0x530), (0x2010, 0x2028), (0x3001, 0x3100))


@lru_cache(maxsize=1)
def _inert() -> str:
    """Of some blocks, the characters that NFKC leaves, whatever stands before them: their own form, no marks, and never the second of a composition."""
    seconds = {d[1] for c in map(chr, range(0x80, 0x3100)) if len(d := unicodedata.decomposition(c).split()) == 2 and not d[0].startswith("<")}
    own = lambda c: unicodedata.is_normalized("NFKC", chr(c)) and not unicodedata.combining(chr(c)) and f"{c:04X}" not in seconds
    return "".join(chr(c) for low, high in _BLOCKS for c in range(low, high) if own(c))


def _may_fold(text: Column) -> Column:
    """Whether NFKC may change a text, that is, whether characters other than ASCII are left without the inert ones; false or null where not."""
    return F.when(text.rlike(_OTHER), F.translate(text, _inert(), "")).rlike(_OTHER)


def _folded(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t), na_action="ignore")


_LOWERED = str.maketrans(_UPPER, _LOWER)


def _folded_lower(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: unicodedata.normalize("NFKC", t).translate(_LOWERED), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode compatibility composition. Only rows with characters that it may change are sent to Python."""
    fold = F.pandas_udf(_folded, "string")
    return F.coalesce(fold(F.when(_may_fold(text), text)), text)


def ascii_lower(text: Column) -> Column:
    """Lower case for A to Z alone."""
    return let(text, lambda t: F.when(t.rlike(_OTHER), F.translate(t, _UPPER, _LOWER)).otherwise(F.lower(t)))


def collapse_whitespace(text: Column) -> Column:
    """Runs of Unicode white space become one space; none stays at the ends."""
    return let(text, lambda t: F.trim(F.when(t.rlike(r"(?U)[\s&&[^ ]]|  "), F.regexp_replace(t, r"(?U)\s+", " ")).otherwise(t)))


def normalize(text: Column, cfg: Normalization = Normalization()) -> Column:
    """The steps that cfg has on, in this order. With all off the text stays as it is."""
    if cfg.nfkc and cfg.lower:  # both in one visit to Python, for the rows that go there
        fold = F.pandas_udf(_folded_lower, "string")
        text = F.coalesce(fold(F.when(_may_fold(text), text)), ascii_lower(text))
    elif cfg.nfkc:
        text = nfkc(text)
    elif cfg.lower:
        text = ascii_lower(text)
    return collapse_whitespace(text) if cfg.whitespace else text


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Latin letters with marks, and their letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        base, *marks = unicodedata.normalize("NFD", c)
        if marks and base.isascii() and base.isalpha() and all(unicodedata.category(m) == "Mn" for m in marks):
            pairs.append((c, base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def strip_accents(text: Column) -> Column:
    """Latin letters without their marks, and no combining marks."""
    bare = let(text, lambda t: F.when(t.rlike("[À-ɏḀ-ỿ]"), F.translate(t, *_accents())).otherwise(t))
    return let(bare, lambda t: F.when(t.rlike(_OTHER), F.regexp_replace(t, r"\p{Mn}+", "")).otherwise(t))


def terms(text: Column) -> Column:
    """The terms of a text in order: runs of letters, digits and private characters, case and accents folded."""
    return F.regexp_extract_all(strip_accents(F.lower(text)), F.lit(r"[\p{L}\p{N}\p{Co}]+"), F.lit(0))


def trigrams(text: Column) -> Column:
    """All runs of three characters, in order; none for a shorter text."""
    n = F.char_length(text)
    return F.when(n >= 3, F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(text, i, F.lit(3)))).otherwise(F.array().cast("array<string>"))
