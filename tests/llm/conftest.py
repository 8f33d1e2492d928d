import random

import pytest

#: The columns of documents, and some whose names operators could use themselves.
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, seed string, x string, h1 bigint, slot bigint, tokens string, size int, __vd_text string, m map<string,int>"


def rows_of(texts, langs=None, sources=None, ids=None):
    return [
        (ids[i] if ids else i, t, langs[i] if langs else "en", sources[i] if sources else f"src{i % 3}", None if t is None else len(t), 7, "s", None, i, 1, "t", 3, "own", {"a": i % 2})
        for i, t in enumerate(texts)
    ]


@pytest.fixture(scope="session")
def make(spark):
    """Texts (and languages, sources, ids) to a table like documents, with more columns."""
    return lambda texts, **k: spark.createDataFrame(rows_of(texts, **k), SCHEMA)


@pytest.fixture(scope="session")
def prose():
    """n texts of invented words, alike in style."""

    def write(n, words=40, seed=0):
        rng = random.Random(seed)
        parts = ["th", "er", "on", "an", "re", "in", "ed", "nd", "at", "es", "or", "ti", "he", "en", "of", "st"]
        return [" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(words // 2, words * 2))) for _ in range(n)]

    return write


#: What a column of texts may hold: null, empty, blank, no words, very long, other scripts, control characters.
ODD = [None, "", " ", "\n\n", "###", "a", "word " * 30_000, "x" * 200_000, "日本語のテキスト 😀 é", "\x00\x02\x01", "a", "a", None, ""]


@pytest.fixture(scope="session")
def odd():
    return list(ODD)


def empty_like(df):
    return df.limit(0)


