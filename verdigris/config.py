"""Settings of the retrieval operators, as immutable values that become literals of a plan."""

from __future__ import annotations

import json
import math
from collections.abc import Mapping
from dataclasses import dataclass, field

SOURCES = ("fts", "vector")

#: Texts put before what is embedded, by purpose.
PREFIXES = {"query": "検索クエリ: ", "document": "検索文書: ", "topic": "トピック: ", "semantic": ""}

MAX_SEQ_LEN, SPECIAL_TOKENS, EOS_ID = 8192, 2, 2
CHUNK_OVERLAP = 2048
BUCKET_BOUNDS = (128, 512, 2048, 8192)
TOKEN_BUDGET = 256_000


def max_content(prefix_len: int) -> int:
    """Tokens of content that fit beside a prefix and the special tokens."""
    return MAX_SEQ_LEN - SPECIAL_TOKENS - prefix_len


@dataclass(frozen=True)
class Normalization:
    nfkc: bool = True
    lower: bool = True
    whitespace: bool = True

    @staticmethod
    def disabled() -> Normalization:
        return Normalization(False, False, False)

    @staticmethod
    def from_json(text: str | None) -> Normalization:
        """From a settings file's block; a missing block is of a time before normalization, so all is off."""
        if text is None:
            return Normalization.disabled()
        return Normalization(**{k: bool(v) for k, v in json.loads(text).items() if k in ("nfkc", "lower", "whitespace")})


@dataclass(frozen=True)
class Hybrid:
    """Fusion of ranks: the constant k, and each source's weight (0 where it is missing)."""

    k: float = 60.0
    weights: Mapping[str, float] = field(default_factory=lambda: {"fts": 1.0, "vector": 1.0})


@dataclass(frozen=True)
class Recency:
    weight: float = 0.0
    half_life_days: float = 30.0

    @property
    def active(self) -> bool:
        return self.weight != 0.0 and math.isfinite(self.weight)
