"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

A text is encoded piece by piece: long texts are cut before the regex runs, at places where no match of the pattern can
span the cut, so one call never holds the ids of more than about `PIECE` characters. Decoding works on raw bytes, so a
token that holds part of a character needs no care.

Cases: a null text counts as empty and gives zero ids; a text without any safe cut is encoded in one piece; equal texts
give equal rows; extra columns of the input are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlark.llm.common import text_of

#: Characters after which the next safe cut is taken.
PIECE = 1 << 16
#: An ASCII letter ends each match that holds it when no letter follows, so the place between the two is always a match boundary.
_SAFE = re.compile(r"(?<=[A-Za-z])(?=[\x20\n\t.,;:0-9])")
_encoders: dict = {}


def rank_bytes(path: str | None = None) -> bytes:
    """The rank file's bytes (under a megabyte), read once on the driver and shipped with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        return f.read()


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encoder(ranks: bytes, pattern: str):
    """One tiktoken encoding for each worker process and rank file."""
    key = (hash(ranks), pattern)
    if key not in _encoders:
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        _encoders[key] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={})
    return _encoders[key]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """The text in pieces of about `size` characters, cut at match boundaries only."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:]


def encode(enc, text: str, size: int = PIECE) -> Iterator[list[int]]:
    for piece in pieces(text, size):
        yield enc.encode_ordinary(piece)


def decode(enc, ids) -> bytes:
    return enc.decode_bytes(ids)


def _digests(enc, text: str) -> tuple[int, str, str]:
    n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
    for ids in encode(enc, text):
        n += len(ids)
        of_ids.update(np.asarray(ids, dtype="<u4").tobytes())
        of_bytes.update(decode(enc, ids))
    return n, of_ids.hexdigest(), of_bytes.hexdigest()


def token_digests(docs: DataFrame, text_col: str = "text", ranks: bytes | None = None, pattern: str | None = None):
    """Column expression: struct(n_tokens, ids_sha256, decoded_sha256) of each whole text."""
    shipped = docs.sparkSession.sparkContext.broadcast((ranks or rank_bytes(), pattern or split_pattern()))

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pd.Series) -> pd.DataFrame:
        enc = encoder(*shipped.value)
        return pd.DataFrame([_digests(enc, t) for t in texts], columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return digests(text_of(text_col))


def token_ids(docs: DataFrame, text_col: str = "text", ranks: bytes | None = None, pattern: str | None = None):
    """Column expression: the ids themselves, array<int>."""
    shipped = docs.sparkSession.sparkContext.broadcast((ranks or rank_bytes(), pattern or split_pattern()))

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        enc = encoder(*shipped.value)
        return pd.Series([[i for part in encode(enc, t) for i in part] for t in texts], dtype=object)

    return ids(text_of(text_col))


def decoded(docs: DataFrame, ids_col: str = "ids", ranks: bytes | None = None, pattern: str | None = None):
    """Column expression: the raw bytes of an id array (null: empty), binary."""
    shipped = docs.sparkSession.sparkContext.broadcast((ranks or rank_bytes(), pattern or split_pattern()))

    @F.pandas_udf("binary")
    def raw(ids: pd.Series) -> pd.Series:
        enc = encoder(*shipped.value)
        return pd.Series([decode(enc, [int(i) for i in x]) if x is not None else b"" for x in ids], dtype=object)

    return raw(F.col(ids_col))


def encode_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks: bytes | None = None) -> DataFrame:
    """One row a document: (id, n_tokens, ids_sha256, decoded_sha256)."""
    return docs.select(F.col(id_col), token_digests(docs, text_col, ranks).alias("_t")).select(id_col, "_t.*")
