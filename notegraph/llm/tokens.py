"""Encoding of texts with a byte-level BPE of a local rank file, and decoding back to the same bytes."""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

RANK_FILE = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits a text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Texts of more code points are encoded piece by piece.
PIECE = 1 << 16
#: A word's last character before a space or line end. No token of the pattern reaches across, and none looks back.
_BOUNDARY = regex.compile(r"\S(?=[ \n])")


@lru_cache(maxsize=4)
def _encoding(ranks: bytes) -> tiktoken.Encoding:
    table = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def pieces(text: str, size: int = PIECE) -> list[str]:
    """``text`` cut at the first safe boundary after each ``size`` code points; the pieces encode as the whole does."""
    out, start = [], 0
    while len(text) - start > size:
        cut = _BOUNDARY.search(text, start + size)
        if cut is None:
            break
        out.append(text[start : cut.end()])
        start = cut.end()
    return [*out, text[start:]]


def encode_text(encoding: tiktoken.Encoding, text: str | None) -> np.ndarray:
    if not text:
        return np.empty(0, dtype=np.uint32)
    if len(text) <= PIECE:
        return encoding.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([encoding.encode_to_numpy(piece, disallowed_special=()) for piece in pieces(text)])


def _shared_ranks(spark: SparkSession, rank_file: str):
    with open(rank_file, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encoder(spark: SparkSession, rank_file: str = RANK_FILE):
    """Column function text -> array of token ids, without special tokens; a null or empty text has no ids: ``[]``."""
    ranks = _shared_ranks(spark, rank_file)

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        encoding = _encoding(ranks.value)
        ids = [encode_text(encoding, text) for text in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        flat = np.concatenate(ids).astype(np.int32) if ids else np.empty(0, dtype=np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    return encode


def token_counter(spark: SparkSession, rank_file: str = RANK_FILE):
    """Column function text -> number of token ids; 0 for a null or empty text."""
    ranks = _shared_ranks(spark, rank_file)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        encoding = _encoding(ranks.value)
        return pa.array([len(encode_text(encoding, text)) for text in texts.to_pylist()], pa.int64())

    return count


def decoder(spark: SparkSession, rank_file: str = RANK_FILE):
    """Column function ids -> binary: the bytes of the ids one after the other, empty for null or no ids.

    The bytes of one id need not be whole characters; cast the result of a whole text to string.
    """
    ranks = _shared_ranks(spark, rank_file)

    @F.arrow_udf("binary")
    def decode(ids: pa.Array) -> pa.Array:
        encoding = _encoding(ranks.value)
        return pa.array([encoding.decode_bytes(x) if x else b"" for x in ids.to_pylist()], pa.binary())

    return decode


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))
