"""Vector functions (E2, E3, E5-E7) and the embedding plug point."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def cosine_distance(a: Column, b: Column) -> Column:
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.lit(1.0) - F.when(norm == 0, F.lit(0.0)).otherwise(_dot(a, b) / norm)


def l2_distance(a: Column, b: Column) -> Column:
    squares = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x))


def vector_distance(a: Column, b: Column, kind: str = "cosine") -> Column:
    """E5: cosine, l2, or negative inner product, for vectors that are already side by side."""
    if kind == "cosine":
        return cosine_distance(a, b)
    return l2_distance(a, b) if kind == "l2" else -_dot(a, b)


def distance_to_score(distance: Column | str, kind: str = "cosine") -> Column:
    """Score in [0, 1], six decimals."""
    d = T.col(distance)
    raw = {
        "cosine": F.lit(1.0) - d / 2,
        "ip": (F.lit(1.0) - d) / 2,
        "l2": F.lit(1.0) / (F.lit(1.0) + F.greatest(d, F.lit(0.0))),
    }[kind]
    return T.clamp(T.js_round(raw, 6))


def is_valid_vector(v: Column | str, dim: int) -> Column:
    """Right length and finite everywhere."""
    big = F.lit(float("inf"))
    finite = F.forall(T.col(v), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < big))
    return F.coalesce((F.size(T.col(v)) == dim) & finite, F.lit(False))


def input_prefix(model: str, input_type: str | None) -> str:
    """Prompts two model families expect before queries and passages."""
    name = model.lower()
    if "e5" in name:
        return {"query": "query: ", "passage": "passage: "}.get(input_type or "", "")
    if "qwen3" in name and "embed" in name.split("qwen3", 1)[1] and input_type == "query":
        return "Instruct: Given a question, retrieve passages that answer it\nQuery: "
    return ""


def embed_column(
    c: Column | str,
    provider: Callable[[list[str]], np.ndarray],
    model: str = "",
    input_type: str | None = None,
    batch: int = 96,
) -> Column:
    """Call ``provider`` on batches of prefixed texts inside Spark tasks."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in parts:
            out: list = []
            values = texts.fillna("").tolist()
            for i in range(0, len(values), batch):
                out += [np.asarray(v, dtype="float32") for v in provider(values[i : i + batch])]
            yield pd.Series(out)

    return run(F.concat(F.lit(input_prefix(model, input_type)), T.col(c)))


def hash_vectors(texts: list[str], dim: int = 64) -> np.ndarray:
    """Unit vectors drawn from a xoshiro128 stream seeded with each text's sha256."""
    seeds = np.array(
        [
            np.frombuffer(hashlib.sha256(x.encode("utf-8")).digest()[:16], dtype="<u4")
            for x in texts
        ],
        dtype=np.uint32,
    ).reshape(-1, 4)
    state = [np.where(seeds[:, i] == 0, np.uint32(i + 1), seeds[:, i]) for i in range(4)]
    out = np.empty((len(texts), dim))
    for j in range(dim):
        a, b, c, d = state
        out[:, j] = (a + d).astype(np.uint32) / 4294967296.0 * 2 - 1
        shifted = b << np.uint32(9)
        c = c ^ a
        d = d ^ b
        b = b ^ c
        a = a ^ d
        c = c ^ shifted
        d = (d << np.uint32(11)) | (d >> np.uint32(21))
        state = [a, b, c, d]
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def hash_embedding(c: Column | str, dim: int = 64, **kw) -> Column:
    """E2 as a column: the deterministic test provider behind E1."""
    return embed_column(c, lambda texts: hash_vectors(texts, dim), **kw)


def embedding_tokens(c: Column | str) -> Column:
    """A quarter of the characters, rounded up."""
    return F.ceil(T.utf16_length(T.col(c)) / 4).cast("long")


def embedding_summary(
    vectors: DataFrame, keys: list[str], vec: str = "embedding", dim: int | None = None
) -> DataFrame:
    """Per ``keys`` (such as document, provider and model) and dimension: vectors, valid ones, their mean norm.

    Valid are finite vectors of ``dim`` components, or of any number if that isn't given.
    """
    own = F.size(T.col(vec))
    valid = is_valid_vector(vec, dim) if dim is not None else is_valid_vector(vec, own)
    norm = F.sqrt(F.aggregate(F.col(vec).cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x))
    return vectors.groupBy(*keys, own.alias("dimensions")).agg(
        F.count(F.lit(1)).alias("vectors"),
        F.count_if(valid).alias("valid"),
        F.round(F.avg(F.when(valid, norm)), 4).alias("mean_norm"),
    )
