"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file."""

from __future__ import annotations

import base64
import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_columns, texts_of

#: Characters after which a text is cut at the next safe boundary.
PIECE_CHARS = 1 << 16
#: Python counts these as space, Unicode's White_Space doesn't.
NOT_WHITE = "\x1c\x1d\x1e\x1f"


@functools.lru_cache(maxsize=4)
def encoder(rank_file: str, pattern: str):
    """The tiktoken encoding of a rank file (a line: base64 of the bytes, rank), without special tokens."""
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(maxsize=4)
def token_bytes(rank_file: str, pattern: str) -> dict[int, bytes]:
    with open(rank_file, "rb") as f:
        return {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in f if line.strip())}


def split_safely(text: str, size: int = PIECE_CHARS) -> list[str]:
    """Pieces of about ``size`` characters that the pattern matches as it would the whole.

    No match of the pattern holds a character that isn't white space followed by one that is, and none looks behind, so
    the place between two such characters is always an end of a match, whose neighbours match alike without each other.
    Without such a place the piece goes on.
    """
    if len(text) <= size:
        return [text]
    out, at = [], 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and not (text[cut].isspace() and text[cut] not in NOT_WHITE and not text[cut - 1].isspace()):
            cut += 1
        out.append(text[at:cut])
        at = cut
    if at < len(text):
        out.append(text[at:])
    return out


def encode_text(text: str, enc) -> np.ndarray:
    return np.array([i for piece in split_safely(text) for i in enc.encode_ordinary(piece)], dtype="<u4")


def encode(df: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """df with ``ids``: the token ids of the whole text as little-endian unsigned 32-bit integers in one binary value.

    Null or empty text: no ids, an empty value. Lone surrogates can't occur in Spark's UTF-8. The pass has no shuffle
    and no state; a repeated row is encoded again; a column named ``ids`` is replaced.
    """

    def make():
        enc = encoder(rank_file, pattern)
        return lambda batch: [pa.array([encode_text(x, enc).tobytes() for x in texts_of(batch, text)], pa.binary())]

    return append_columns(df, [T.StructField(ids, T.BinaryType())], make)


def decode(df: DataFrame, rank_file: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with ``out``: the bytes of the ids, joined raw. They need not be valid UTF-8. Null ids: no bytes."""

    def make():
        table = token_bytes(rank_file, pattern)

        def step(batch):
            values = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            return [pa.array([b"".join(map(table.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in values], pa.binary())]

        return step

    return append_columns(df, [T.StructField(out, T.BinaryType())], make)


def n_tokens(ids: Column) -> Column:
    return (F.length(ids) / 4).cast("long")
