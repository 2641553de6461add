"""Token counts and token windows by a byte-level rank file, whose path is a parameter."""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A pattern that splits text before merging, for rank files that come without one.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The tokeniser library breaks down on very long white space; longer texts are taken in parts.
PART = 100_000


@functools.cache
def _coder(packed: bytes, pattern: str):
    """Once a worker."""
    import tiktoken

    ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, packed.splitlines())}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _tokens(coder, text: str) -> list[int]:
    """Tokens of a text. Parts are cut before a blank that follows no blank, where no match of the pattern goes on; without
    such a place in ``PART`` characters, which no prompt has, the cut may cost a token."""
    out, at = [], 0
    while at < len(text):
        end = at + PART
        if end < len(text):
            end = text.rfind(" ", at + 1, end)
            while end > at and text[end - 1].isspace():
                end = text.rfind(" ", at + 1, end)
            end = end if end > at else at + PART
        out += coder.encode_ordinary(text[at:end])
        at = end
    return out


def _packed(df: DataFrame, path: str):
    with open(path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())  # a vocabulary is a few MB


def token_counts(texts: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id, tokens); null text has none."""
    sent = _packed(texts, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, pattern)
        for batch in batches:
            counts = [len(_tokens(coder, x.as_py() or "")) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], ["id", "tokens"])

    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, tokens long").withColumnRenamed("id", id_col)


def chunk_tokens(docs: DataFrame, path: str, size: int = 1200, overlap: int = 100, id_col: str = "doc_id", text_col: str = "text", pattern: str = PATTERN) -> DataFrame:
    """(id, chunk_idx, chunk, n_tokens): windows of ``size`` tokens that start every ``size - overlap``; a cut character is replaced."""
    step = size - overlap
    if step < 1:
        raise ValueError("overlap must be smaller than size")
    sent = _packed(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(sent.value, pattern)
        for batch in batches:
            for key, x in zip(batch.column(0), batch.column(1), strict=True):
                ids = _tokens(coder, x.as_py() or "")
                parts = [ids[at : at + size] for at in range(0, len(ids), step)]
                texts = [coder.decode_bytes(p).decode("utf-8", "replace") for p in parts]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key.as_py()] * len(parts), key.type), pa.array(range(len(parts)), pa.int32()), pa.array(texts, pa.string()), pa.array(map(len, parts), pa.int32())], ["id", "chunk_idx", "chunk", "n_tokens"]
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(rows.dtypes)['id']}, chunk_idx int, chunk string, n_tokens int").withColumnRenamed("id", id_col)
