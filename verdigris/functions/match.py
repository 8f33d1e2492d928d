"""From what a user types to a query that full-text search can run safely, as expressions over a column."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

OPERATORS = ("AND", "OR", "NOT")
EMPTY_INPUT, NO_TERMS = "EmptyInput", "NoSearchableTerms"
VOCAB_LIMIT = 25


class SearchError(ValueError):
    """What can be wrong with a query."""


class InvalidVocabTable(SearchError):
    pass


def check_identifier(name: str) -> str:
    """name, if it is a plain identifier; else InvalidVocabTable."""
    if re.fullmatch(r"[A-Za-z_][A-Za-z0-9_]*", name, re.ASCII) is None:
        raise InvalidVocabTable(name)
    return name


def let(value: Column, body) -> Column:
    """body(value), where value is evaluated once and stands in the plan once, however often body has it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_words(text: Column) -> Column:
    """Words between Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def is_operator(word: Column) -> Column:
    return F.upper(word).isin(*OPERATORS)


def _closed(word: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, F.lit(")"), F.lit("")))


def _opened(word: Column) -> Column:
    return F.length(word) - F.length(F.replace(word, F.lit("("), F.lit("")))


def strip_near(words: Column) -> Column:
    """Without NEAR groups. Inside a group only closing parentheses count; an open group takes all that follows."""
    start = F.struct(F.lit(0).alias("depth"), F.array().cast("array<string>").alias("kept"))

    def step(state: Column, word: Column) -> Column:
        near = F.upper(word).startswith("NEAR(") | F.upper(word).startswith("NEAR/")
        depth = F.when(near, F.greatest(state.depth + _opened(word) - _closed(word), F.lit(0))).otherwise(F.greatest(state.depth - _closed(word), F.lit(0)))
        keep = ~near & (state.depth == 0)
        return F.struct(F.when(near | (state.depth > 0), depth).otherwise(F.lit(0)).alias("depth"), F.when(keep, F.concat(state.kept, F.array(word))).otherwise(state.kept).alias("kept"))

    return F.aggregate(words, start, step, lambda state: state.kept)


def clean_word(word: Column) -> Column:
    """Without leading ^ + -, then without parentheses at the ends; quoted where a colon or hyphen is in it."""


    def quoted(bare: Column) -> Column:
        return F.when(bare.rlike("[:-]") & ~bare.startswith('"'), F.concat(F.lit('"'), F.replace(bare, F.lit('"'), F.lit("")), F.lit('"'))).otherwise(bare)

    return let(F.regexp_replace(F.regexp_replace(word, r"^[\^+\-]+", ""), r"^[()]+|[()]+$", ""), quoted)


def drop_dangling(words: Column) -> Column:
    """Without operators that don't stand between two other words, all judged by the list as it was."""

    def stays(word: Column, i: Column) -> Column:
        left, right = F.get(words, i - 1), F.get(words, i + 1)
        return ~is_operator(word) | (left.isNotNull() & ~is_operator(left) & right.isNotNull() & ~is_operator(right))

    return F.filter(words, stays)


def sanitize(query: Column) -> Column:
    """The query without special syntax, or null where nothing is left of it (see sanitize_error)."""
    cleaned = F.filter(F.transform(strip_near(split_words(query)), clean_word), lambda w: w != "")

    def balanced(joined: Column) -> Column:
        odd = (F.length(joined) - F.length(F.replace(joined, F.lit('"'), F.lit("")))) % 2 == 1
        return F.when(joined != "", F.when(odd, F.concat(joined, F.lit('"'))).otherwise(joined))

    return let(F.array_join(let(cleaned, drop_dangling), " "), balanced)


def sanitize_error(query: Column, sanitized: Column) -> Column:
    """Why there is no sanitized query: EmptyInput, NoSearchableTerms, or null."""
    blank = query.isNull() | (F.regexp_replace(query, r"(?U)\s+", "") == "")
    return F.when(blank, F.lit(EMPTY_INPUT)).when(sanitized.isNull(), F.lit(NO_TERMS))


def quote(text: Column) -> Column:
    """In double quotes, those inside doubled."""
    return F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))


def is_short(word: Column) -> Column:
    """Words that are looked up in the vocabulary: of one or two characters, and no operators."""
    return (F.char_length(word) < 3) & ~is_operator(word)
