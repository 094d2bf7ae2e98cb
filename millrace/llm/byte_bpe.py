"""Byte-level BPE encoding and decoding with a local rank file.

One narrow pass each; a worker reads the rank file once. Long texts are cut only where every match of
the split pattern ends anyhow: before an ASCII blank or line feed that follows a non-space.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.common import AFTER_LETTER, as_binary, slices, texts

#: characters that are encoded at once
PIECE_CHARS = 1 << 16
#: a place before a blank or line feed that follows a non-space, or between a letter and closing punctuation
SAFE = re.compile(r"(?<=[^\s])(?=[ \n])|" + AFTER_LETTER.pattern)


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding(rank_file, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int = PIECE_CHARS) -> Iterator[str]:
    """Cuts of at least ``size`` characters at safe places; together they are the text."""
    start = 0
    while len(text) - start > size and (found := SAFE.search(text, start + size)):
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(coder, text: str) -> list[int]:
    if len(text) <= PIECE_CHARS:
        return coder.encode_ordinary(text)
    return [i for piece in pieces(text) for i in coder.encode_ordinary(piece)]


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for every row; special tokens don't exist. Null and empty texts give an empty array, repeated rows
    repeat, other columns are ignored, an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in slices(batches):
            ids = [encode_text(coder, t) for t in batch.column(1).to_pylist()]
            ends = np.cumsum([0, *map(len, ids)], dtype=np.int64)
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(ends[-1]))
            yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return texts(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Adds decoded, the raw bytes of ids (doc_id, ids); an id without a rank is an error. Null ids give no bytes; repeated rows repeat; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoding(rank_file, pattern)
        for batch in slices(batches):
            yield pa.record_batch([*batch.columns, as_binary([coder.decode_bytes(x or []) for x in batch.column(1).to_pylist()])], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
