"""Chunks: of texts by bytes, and of tokens with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.config import CHUNK_OVERLAP, EOS_ID, MAX_SEQ_LEN, SPECIAL_TOKENS, max_content


def fragments(text: str, max_bytes: int) -> list[str]:
    """A text in pieces of at most max_bytes of UTF-8, cut after the last blank line in reach, else after the last line, else between characters. End to end they are the text. Under 4 bytes nothing is cut."""
    raw = text.encode()
    if max_bytes < 4 or len(raw) <= max_bytes:
        return [text]
    out, at = [], 0
    while len(raw) - at > max_bytes:
        end = at + max_bytes
        while raw[end] & 0xC0 == 0x80:
            end -= 1
        for mark in (b"\n\n", b"\n"):
            if (found := raw.rfind(mark, at, end)) >= 0:
                end = found + len(mark)
                break
        out.append(raw[at:end].decode())
        at = end
    return [*out, raw[at:].decode()] if at < len(raw) else out


def split_text(docs: DataFrame, max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, frag_idx, fragment, n_bytes). An empty text is one empty fragment; a null one has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, parts = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                pieces = [] if text is None else fragments(text, max_bytes)
                ids += [row] * len(pieces)
                index += range(len(pieces))
                parts += pieces
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(index, pa.int32()), pa.array(parts, pa.string())], names=["doc_id", "frag_idx", "fragment"])

    given = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, frag_idx int, fragment string").withColumn("n_bytes", F.octet_length("fragment"))


def truncate_with_eos(ids: Column, max_len: int, eos: int = EOS_ID) -> Column:
    """At most max_len tokens, the last of a cut list being the end token. 0 cuts nothing."""
    if max_len == 0:
        return ids
    return F.when(F.size(ids) > max_len, F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(eos)))).otherwise(ids)


def truncate_mask(mask: Column, max_len: int) -> Column:
    return mask if max_len == 0 else F.when(F.size(mask) > max_len, F.slice(mask, 1, max_len)).otherwise(mask)


def chunk_starts(n: Column, content: int, overlap: int) -> Column:
    """Where chunks of content tokens begin in a list of n: each overlap tokens before the end of the last, until one reaches the end. No overlap that would stand still is followed: then there is one chunk."""
    step = content - overlap
    more = F.when(n <= content, F.lit(0)).otherwise(F.ceil((n - content) / F.lit(float(max(step, 1))))).cast("int")
    return F.transform(F.sequence(F.lit(0), more if step > 0 else F.lit(0)), lambda i: i * step)


def plan_chunks(tokens: DataFrame, prefix_len: int = 0, content: int | None = None, overlap: int = CHUNK_OVERLAP, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, chunk_id, chunk_idx, start, tokens): short lists as one chunk, long ones with overlap."""
    content = max_content(prefix_len) if content is None else content
    starts = tokens.select(F.col(id_col).alias("doc_id"), F.col(tokens_col).alias("all"), F.posexplode(chunk_starts(F.size(tokens_col), content, overlap)).alias("chunk_idx", "start"))
    return starts.select("doc_id", chunk_id(F.col("chunk_idx")).alias("chunk_id"), "chunk_idx", "start", F.slice("all", F.col("start") + 1, F.lit(content)).alias("tokens"))


def chunk_id(index: Column) -> Column:
    return F.concat(F.lit("c"), index.cast("string"))


def shrink_to_fit(size_of, start: int, end: int, most: int = MAX_SEQ_LEN) -> int:
    """The largest end for which size_of(start, end), the tokens after encoding again with specials, is at most `most`; for tokenizers that merge across a cut. An empty range is an error."""
    while end > start and size_of(start, end) > most:
        end -= 1
    if end <= start:
        raise ValueError("no token fits")
    return end


def is_short(n_tokens: Column, prefix_len: int) -> Column:
    """Whether a text of n tokens, prefix and specials included, is one chunk."""
    return F.greatest(n_tokens - (SPECIAL_TOKENS + prefix_len), F.lit(0)) <= max_content(prefix_len)
