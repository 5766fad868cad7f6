"""Byte-level BPE with the tiktoken library and a local rank file.

Long texts are split first where a new match of the pattern is certain whatever comes before: ahead of white space
that follows something else, and between letters and digits. Encoding and decoding run in Arrow batches inside tasks.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, functions as F

from .common import text_of, unused

#: Texts above this many characters are split before encoding.
SPLIT_ABOVE = 16_384
#: A place before which every match ends: plain white space after something else, or a change of letter and digit.
BOUNDARY = regex.compile(r"(?<=[^\s\x1c-\x1f])(?=[ \t\r\n])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")


@functools.lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    with open(ranks_path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def split_long(text: str, size: int = SPLIT_ABOVE) -> Iterator[str]:
    """The text in parts of about ``size`` characters, cut at safe boundaries only; longer where there is none."""
    start, n = 0, len(text)
    while n - start > size:
        found = BOUNDARY.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


def encode_text(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """Ids as unsigned 32-bit integers; strings of special tokens are ordinary text."""
    if len(text) <= SPLIT_ABOVE:
        return enc.encode_to_numpy(text, disallowed_special=())
    return np.concatenate([enc.encode_to_numpy(part, disallowed_special=()) for part in split_long(text)])


def encode(ranks_path: str, pattern: str, column: Column) -> Column:
    """Ids of a text column as array<int>; null counts as empty."""

    @F.arrow_udf("array<int>")
    def run(texts: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        return pa.array([encode_text(enc, t).view(np.int32) for t in texts.to_pylist()], pa.list_(pa.int32()))

    return run(F.coalesce(column.cast("string"), F.lit("")))


def decode(ranks_path: str, pattern: str, column: Column) -> Column:
    """Raw bytes of an array<int> column (they need not be UTF-8 where a text was cut between ids); null stays null."""

    @F.arrow_udf("binary")
    def run(ids: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        return pa.array([None if x is None else enc.decode_bytes(x) for x in ids.to_pylist()], pa.binary())

    return run(column)


def digested(ranks_path: str, pattern: str, column: Column) -> Column:
    """Struct (n_tokens, ids_sha256, decoded_sha256) of a text column without null.

    Each text is encoded once and its ids are decoded once, in one function: columns that feed one function into
    another would encode again for every use. Digests are SHA-256 in lowercase hex, of the ids as little-endian
    unsigned 32-bit integers and of the decoded bytes.
    """
    kind = pa.struct([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    @F.arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(texts: pa.Array) -> pa.Array:
        enc = encoding(ranks_path, pattern)
        rows = []
        for text in texts:
            ids = encode_text(enc, text.as_py())
            rows.append((
                len(ids), hashlib.sha256(ids.astype("<u4", copy=False).tobytes()).hexdigest(),
                hashlib.sha256(enc.decode_bytes(ids.tolist())).hexdigest()))
        return pa.StructArray.from_arrays(
            [pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], fields=list(kind))

    return run(column)


def encoded(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", into: str = "ids") -> DataFrame:
    """All columns and the ids; a column already called ``into`` is kept and the ids get underscores in front."""
    return df.withColumn(unused(into, df.columns), encode(ranks_path, pattern, F.col(text_col)))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_tokens, digests of its ids and of the bytes they decode to.

    Null texts count as empty (no ids, digest of nothing). A text of any length is encoded whole; one without a safe
    boundary in one piece. Repeated rows and null ids are kept as they are, an empty table gives no rows, other
    columns are ignored.
    """
    found = df.select(F.col(id_col), digested(ranks_path, pattern, text_of(text_col)).alias("_found"))
    return found.select(id_col, "_found.n_tokens", "_found.ids_sha256", "_found.decoded_sha256")
