"""Language identification: averaged hashed subword embeddings with a linear softmax.

A text is the mean of the embeddings of its hashed subwords (byte n-grams of its words, with the
spaces around them), followed by a linear layer and a softmax. Both layers are trained together by
stochastic gradient descent in numpy. A held-back part of the sample sets the temperature and the
probability below which a prediction is rejected. Training reads a bounded sample of labelled
rows; whole texts are used, and only the hashed counts of the sample come to the driver.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import append_columns

BUCKET_BITS = 15
ORDERS = (2, 3, 4)
PIECE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
#: Bytes of ASCII characters other than letters become spaces.
SPACED = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))


@dataclass
class Model:
    """``table`` holds, for each bucket, its share of every language's logit."""

    langs: list[str] = field(default_factory=list)
    table: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    reject_below: float = 0.0


def subwords(data: np.ndarray) -> np.ndarray:
    """Buckets of all n-grams of ``data`` (bytes) that hold no space but at their ends."""
    found = []
    space = data == 32
    wide = data.astype(np.uint32)
    for n in ORDERS:
        count = len(data) - n + 1
        if count <= 0:
            break
        h = np.full(count, n * 0x9E3779B1 & 0xFFFFFFFF, dtype=np.uint32)
        for k in range(n):
            h = (h ^ wide[k : k + count]) * np.uint32(0x01000193)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        inside = np.zeros(count, dtype=bool)
        for k in range(1, n - 1):
            inside |= space[k : k + count]
        if n == 2:
            inside = space[:count] & space[1 : 1 + count]
        found.append((h >> np.uint32(32 - BUCKET_BITS))[~inside])
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint32)


def pieces(text: str):
    """Lower-cased bytes of the whole text, in overlapping pieces for very long ones."""
    data = np.frombuffer((b" " + text.lower().encode("utf-8", "replace") + b" ").translate(SPACED), dtype=np.uint8)
    step = PIECE - max(ORDERS) + 1
    for start in range(0, max(1, len(data) - max(ORDERS) + 1), step):
        yield data[start : start + PIECE]


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of the whole text and their shares."""
    total = np.zeros(1 << BUCKET_BITS)
    for piece in pieces(text):
        total += np.bincount(subwords(piece), minlength=1 << BUCKET_BITS)
    at = np.flatnonzero(total)
    return at.astype(np.int32), (total[at] / max(total.sum(), 1)).astype(np.float32)


def logits(text: str, model: Model) -> np.ndarray:
    summed, n = np.zeros(len(model.langs)), 0
    for piece in pieces(text):
        at = subwords(piece)
        n += len(at)
        for c in range(len(model.langs)):
            summed[c] += model.table[c].take(at).sum(dtype=np.float64)
    return summed / max(n, 1) + model.bias


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], dim: int = 16, epochs: int = 12,
        rate: float = 0.8, seed: int = 7, wanted_error: float = 0.01) -> Model:
    """Train on (language, buckets, shares) rows; every fifth is held back for calibration."""
    langs = sorted({r[0] for r in rows})
    if not langs:
        return Model()
    number = {lang: i for i, lang in enumerate(langs)}
    held = rows[::5] if len(rows) >= 50 else rows
    used = [r for i, r in enumerate(rows) if i % 5] if len(rows) >= 50 else rows
    rng = np.random.default_rng(seed)
    size = 1 << BUCKET_BITS
    embed = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    out = np.zeros((len(langs), dim), dtype=np.float32)
    bias = np.zeros(len(langs), dtype=np.float32)
    steps, done = epochs * len(used), 0
    for _ in range(epochs):
        for i in rng.permutation(len(used)):
            lang, at, share = used[i]
            own = rate * (1 - done / steps)
            done += 1
            hidden = share @ embed[at]
            grad = softmax(out @ hidden + bias)
            grad[number[lang]] -= 1
            back = grad @ out
            out -= own * np.outer(grad, hidden)
            bias -= np.float32(own * 0.1) * grad
            embed[at] -= own * np.outer(share * len(share) ** 0.5, back)
    table = np.ascontiguousarray((embed @ out.T).T, dtype=np.float32)
    raw = np.array([[(table[c].take(at) * share).sum() for c in range(len(langs))] for _, at, share in held]) + bias
    truth = np.array([number[r[0]] for r in held])
    scales = np.geomspace(0.05, 20, 60)
    loss = [-np.log(softmax(raw / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in scales]
    temperature = float(scales[int(np.argmin(loss))])
    p = softmax(raw / temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best, kind="stable")
    errors = np.cumsum(~right[order]) / np.arange(1, len(order) + 1)
    fine = np.flatnonzero(errors <= wanted_error)
    reject = float(best[order[fine[-1]]]) if len(fine) else 1.0
    return Model(langs, table, bias.astype(np.float64), temperature, reject)


def train(docs: DataFrame, usable: Column, rows_per_lang: int = 600, id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on at most ``rows_per_lang`` rows of each language among those that are ``usable``.

    Rows are drawn by a hash of their id, at a rate set by the language's count, and then cut to
    the bound by the same hash; nothing but the drawn rows is shuffled.
    """
    usable = usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()
    labelled = docs.filter(usable).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col)).alias("draw"),
    )
    sizes = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    if not sizes:
        return Model()
    rates = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], int(1.3e6 * rows_per_lang / r["n"]))])
    drawn = labelled.filter(F.pmod("draw", F.lit(1_000_000)) < F.element_at(rates, F.col("lang")))

    def features(batch: pa.RecordBatch) -> list:
        got = [counts(t) for t in batch.column(1).to_pylist()]
        return [pa.array([g[0] for g in got], pa.list_(pa.int32())),
                pa.array([g[1] for g in got], pa.list_(pa.float32()))]

    fields = [T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("share", T.ArrayType(T.FloatType()))]
    few = append_columns(drawn.select("lang", "text", "draw"), fields, features, drop=("text",))
    ranked = few.withColumn("k", F.row_number().over(W.partitionBy("lang").orderBy("draw")))
    local = ranked.filter(F.col("k") <= rows_per_lang).toArrow().sort_by([("draw", "ascending"), ("lang", "ascending")])
    rows = [(lang, np.asarray(at.values), np.asarray(share.values)) for lang, at, share in
            zip(local["lang"].to_pylist(), local["at"], local["share"]) if len(at)]
    return fit(rows)


def predict(docs: DataFrame, model: Model, text_col: str = "text", drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with lang_pred, score (probability) and accepted.

    A null text, or one without a letter, is ``und`` with score 0 and isn't accepted; so is every
    text if no language was learned. ``accepted`` is whether the probability reaches the level at
    which the held-back rows had the wanted error. Ties go to the first language by name.
    """
    at = docs.columns.index(text_col)

    def scored(batch: pa.RecordBatch) -> list:
        langs, scores, accepted = [], [], []
        for text in batch.column(at):
            text = text.as_py()
            if not text or not model.langs or not LETTER.search(text):
                langs.append("und")
                scores.append(0.0)
                accepted.append(False)
                continue
            p = softmax(logits(text, model) / model.temperature)
            best = int(p.argmax())
            langs.append(model.langs[best])
            scores.append(min(1.0, float(p[best])))
            accepted.append(bool(p[best] >= model.reject_below))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(accepted, pa.bool_())]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("accepted", T.BooleanType())]
    return append_columns(docs, fields, scored, drop)
