"""Token counts of a public tokenizer (a byte-level vocabulary of ranks)."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.operators.worker import kept

#: The vocabulary file (a parameter; see /opt/tokenizers/README.md) and, fixed, the pattern that belongs to it.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    """The tokenizer of this process."""

    def make():
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    return kept("encoder " + path, make)


def widths(path: str = VOCABULARY) -> np.ndarray:
    """The bytes of each token, by its number."""

    def make():
        with open(path, "rb") as f:
            size = {int(b): len(base64.b64decode(a)) for a, b in map(bytes.split, f)}
        out = np.zeros(max(size) + 1, np.int64)
        out[list(size)] = list(size.values())
        return out

    return kept("widths " + path, make)


def source_name(c: Column) -> Column:
    """One spelling per source: trimmed, lower case, "_" for "-" and white space; null where nothing is left."""
    seen = F.lower(F.regexp_replace(c, r"^[\p{Z}\p{Cc}\p{Cf}]+|[\p{Z}\p{Cc}\p{Cf}]+$", ""))
    return F.nullif(F.regexp_replace(seen, r"(?U)[\s\-_]+", "_"), F.lit(""))


def sized(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, source, tokens`` of the documents with a text; null and empty texts have no tokens and are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for b in batches:
            n = pa.array([len(encode(t)) for t in b.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), n], ["doc_id", "source", "tokens"])

    own = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("bigint").alias("doc_id"), source_name(F.col("source").cast("string")).alias("source"), "text")
    return own.mapInArrow(count, "doc_id bigint, source string, tokens bigint")
