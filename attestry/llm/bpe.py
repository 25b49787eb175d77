"""Byte-level BPE encoding and decoding with a local rank file.

Texts go to the tiktoken library as they are; a long text is first cut where its pattern must end
a match whatever stands on the other side, so that each call is short and the ids are the same.
Decoding joins the raw bytes of the ids, which need not be valid UTF-8 on their own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import append_columns

CHUNK = 65_536
#: A match never goes on from a character that isn't white space to one that is, nor from an
#: ASCII letter to a digit or back. Python's \\s holds all that the tokenizer's \\s holds.
SAFE = re.compile(r"(?<=\S)(?=[ \n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def safe_parts(text: str, size: int = CHUNK) -> Iterator[str]:
    """Cut ``text`` at the first safe place from every ``size`` characters on; nothing is lost."""
    start = 0
    while len(text) - start > size:
        cut = SAFE.search(text, start + size)
        if cut is None:
            break
        yield text[start : cut.start()]
        start = cut.start()
    yield text[start:]


@lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The encoding of a rank file; one per worker process."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode_text(text: str | None, path: str, pattern: str) -> np.ndarray:
    if not text:
        return np.empty(0, dtype="<u4")
    own = codec(path, pattern)
    parts = [np.asarray(own.encode_ordinary(p), dtype="<u4") for p in safe_parts(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def decode_ids(ids: np.ndarray, path: str, pattern: str) -> bytes:
    return codec(path, pattern).decode_bytes(ids.tolist())


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text as array<int>; null and empty texts give an empty array."""
    at = docs.columns.index(text_col)

    def ids(batch: pa.RecordBatch) -> list:
        return [pa.array([encode_text(t, path, pattern).astype(np.int32) for t in batch.column(at).to_pylist()],
                         pa.list_(pa.int32()))]

    return append_columns(docs, [T.StructField(out, T.ArrayType(T.IntegerType()))], ids)


def decode(tokens: DataFrame, path: str, pattern: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the raw bytes of each row's ids; null gives empty bytes, unknown ids fail."""
    at = tokens.columns.index(ids_col)

    def raw(batch: pa.RecordBatch) -> list:
        return [pa.array([decode_ids(np.asarray(i or [], dtype=np.uint32), path, pattern)
                          for i in batch.column(at).to_pylist()], pa.binary())]

    return append_columns(tokens, [T.StructField(out, T.BinaryType())], raw)


def round_trip(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, decode its ids, and return the counts and digests of both.

    One row per row of ``docs``: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers), decoded_sha256. Null counts as the empty text; repeated rows are repeated;
    an empty table gives no rows; other columns aren't read. Ids never leave the task.
    """
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("__text"))
    fields = [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]

    def both(batch: pa.RecordBatch) -> list:
        counts, ids_hash, text_hash = [], [], []
        for text in batch.column(1):
            ids = encode_text(text.as_py(), path, pattern)
            counts.append(len(ids))
            ids_hash.append(hashlib.sha256(ids.tobytes()).hexdigest())
            text_hash.append(hashlib.sha256(decode_ids(ids, path, pattern)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(text_hash, pa.string())]

    return append_columns(narrow, fields, both, drop=("__text",))
