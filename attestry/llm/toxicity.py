"""Toxicity: a support vector machine over a gap-weighted subsequence kernel of sentence windows.

Two strings are alike by the symbol triples they share as subsequences; a triple that spans more
symbols counts less, by a power of ``DECAY``, and one that spans more than ``SPAN`` not at all. An
insult with characters put in or left out, or split by spaces, therefore stays close to itself. Strings are
windows that begin before each word of a sentence, whatever its language, and hold that word or, with
the words behind it, ``WINDOW`` symbols:
letters are symbols by their code points, hashed over ``SYMBOLS``, other characters are dropped,
look-alikes between two letters count as letters, white space is one symbol, and runs of single letters are
joined. The kernel is approximated by Nystroem landmarks, drawn from toxic and clean windows, on whose
features a linear machine with squared hinge loss is trained. Since every landmark's triples
are known, the machine folds into one weight for each triple (hashed over ``BUCKETS``), and a text is
scored in one pass over its symbols, without visiting landmarks.

Labels are given for texts. A toxic text is a bag of windows of which some are toxic: the machine
learns from the worst windows of toxic texts against the worst and some other windows of clean texts,
and worst ones are chosen anew in every round. The first choice goes by the log odds of the
windows' five-symbol groups, counted over texts; near copies count once, by their least hashes.
A text's score is that of its worst window.

Results for odd rows: null texts and texts without letters get the lowest score; texts of any length
are read whole, in pieces that overlap; repeated rows score alike; an id with several labels is
toxic if one of them is; without rows of both classes all texts score low; empty tables give no rows;
other columns stay as they are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import append_columns, staged

DECAY = 0.9
SPAN = 6
WINDOW = 12
SYMBOLS = 64
BUCKETS = 1 << 16
GROUP, GROUPS = 5, 1 << 18
PIECE, OVERLAP = 1 << 20, 64
ROWS = 2048
FLOOR = -3.0
GAPS = [(a, b) for a in range(1, SPAN) for b in range(1, SPAN) if a + b < SPAN]
#: The norm of a window by its length (texts may end before it), as if all its triples were different.
NORMS = np.sqrt([
    max(sum(max(n - a - b, 0) * DECAY ** (2 * (a + b + 1)) for a, b in GAPS), DECAY**6) for n in range(WINDOW + 1)
])
AFTER = 255
#: Characters that stand for letters in disguised words.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}


def symbol(letter: str) -> int:
    """1 to 26 for a to z, of both cases; other letters are hashed over the rest; 0 if it is none."""
    if not letter.isalpha():
        return 0
    code = ord(letter.lower()[0])
    return code - 96 if 97 <= code <= 122 else 27 + (code * 2654435761 >> 7) % (SYMBOLS - 27)


BELOW = 0x3000
LETTERS = np.array([symbol(chr(c)) for c in range(BELOW)], np.uint8)
DISGUISED = np.array([symbol(LOOKALIKES[chr(c)]) if chr(c) in LOOKALIKES else 0 for c in range(128)], np.uint8)


def encoded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols in one array, each text followed by ``WINDOW`` zeros, and where those begin.

    White space is 0. From ``BELOW`` on, where letters of most scripts have no case, every character counts as one.
    """
    joined = "".join(t.replace("\x00", " ") + "\x00" for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    low = points < BELOW
    sym = np.where(
        low, LETTERS[np.where(low, points, 0)], 27 + (points.astype(np.uint64) * np.uint64(2654435761) >> np.uint64(7)) % np.uint64(SYMBOLS - 27)
    ).astype(np.uint8)
    sign = np.where(points < 128, DISGUISED[np.minimum(points, 127)], 0)
    end = points == 0
    space = ~end & ((points <= 32) | (points == 0xA0))
    before, after = np.r_[0, sym[:-1]], np.r_[sym[1:], 0]
    sym = np.where((sym == 0) & (before > 0) & (after > 0), sign, sym).astype(np.uint8)
    keep = (sym > 0) | space | end
    sym, end = sym[keep], end[keep]
    gap = sym == 0
    sym, end = without(sym, end, gap & ~end & (np.r_[True, gap[:-1]] | np.r_[end[1:], False]))
    # an end that follows a single letter and one that begins a text part words as well
    borders = np.flatnonzero(sym == 0)
    single = np.diff(np.r_[-1, borders]) == 2
    inner = borders[:-1][single[:-1] & single[1:]] if len(borders) > 1 else borders[:0]
    drop = np.zeros(len(sym), bool)
    drop[inner] = True
    sym, end = without(sym, end, drop & ~end)
    ends = np.flatnonzero(end) + np.arange(end.sum()) * (WINDOW - 1) + 1
    return np.r_[np.uint8(0), np.repeat(sym, np.where(end, WINDOW, 1))], ends


def without(sym: np.ndarray, end: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return sym[~drop], end[~drop]


def windows_of(sym: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begin, length) of all windows: from the zero before each word to the one behind it, and of full length.

    Both are at most ``WINDOW`` symbols and end with the zero that ends the text.
    """
    zeros = np.flatnonzero(sym == 0)
    starts = zeros[:-1][sym[zeros[:-1] + 1] > 0] if len(zeros) else zeros
    word = zeros[np.searchsorted(zeros, starts, side="right")] + 1 - starts if len(starts) else starts
    full = ends[np.searchsorted(ends, starts, side="right")] + 1 - starts
    return np.r_[starts, starts], np.minimum(np.r_[word, full], WINDOW)


def hashed(code: np.ndarray) -> np.ndarray:
    return (code * 0x9E3779B1 >> 9) & (BUCKETS - 1)


def margins(sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each window's triples, over the window's norm."""
    out = np.zeros(len(starts))
    for at in range(0, len(sym), PIECE):
        own = (starts >= at) & (starts < at + PIECE)
        if not own.any():
            continue
        x = np.zeros(PIECE + WINDOW, np.int64)
        part = sym[at : at + PIECE + WINDOW]
        x[: len(part)] = part
        x = x[: len(part) + WINDOW]
        begin = starts[own] - at
        total = np.zeros(len(begin))
        for a, b in GAPS:
            n = len(x) - a - b
            sums = np.r_[0.0, np.cumsum(weights[hashed((x[:n] * SYMBOLS + x[a : a + n]) * SYMBOLS + x[a + b :])])]
            stop = begin + np.maximum(lengths[own] - a - b, 0)
            total += DECAY ** (a + b + 1) * (sums[stop] - sums[begin])
        out[own] = total / NORMS[lengths[own]]
    return out


def group_codes(sym: np.ndarray) -> np.ndarray:
    n = max(0, len(sym) - GROUP + 1)
    code = np.zeros(n, np.int64)
    for k in range(GROUP):
        code = code * SYMBOLS + sym[k : k + n]
    return (code * 0x9E3779B1 >> 11) & (GROUPS - 1)


def group_margins(sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """The greatest log odds of each window's groups."""
    own = np.r_[odds[group_codes(sym)], np.full(WINDOW, odds.min())]
    out = np.full(len(starts), odds.min())
    for k in range(WINDOW - GROUP + 1):
        inside = lengths >= k + GROUP
        out[inside] = np.maximum(out[inside], own[np.minimum(starts[inside] + k, len(own) - 1)])
    return out


def features(windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window number, bucket, weight) of all triples, over the norm; ``AFTER`` lies behind a text."""
    x = windows.astype(np.int64)
    norm = NORMS[(windows != AFTER).sum(axis=1)]
    rows, codes, weights = [], [], []
    for a, b in GAPS:
        n = WINDOW - a - b
        code = hashed((x[:, :n] * SYMBOLS + x[:, a : a + n]) * SYMBOLS + x[:, a + b :])
        inside = x[:, a + b :] != AFTER
        row = np.broadcast_to(np.arange(len(x))[:, None], code.shape)[inside]
        rows.append(row)
        codes.append(code[inside])
        weights.append(DECAY ** (a + b + 1) / norm[row])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


@dataclass
class Model:
    """``weights`` by triple, the machine's ``bias``, and the slope and offset of the logistic."""

    weights: np.ndarray | None = None
    bias: float = FLOOR
    slope: float = 6.0
    offset: float = 0.0

    def windows(self, sym: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        return np.maximum(margins(sym, starts, lengths, self.weights) + self.bias, FLOOR)

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.offset, -50, 50)))

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """The margin of the worst window of each text."""
        out = np.full(len(texts), FLOOR)
        if self.weights is None:
            return out
        for numbers, parts in batches_of(texts):
            sym, ends = encoded(parts)
            starts, lengths = windows_of(sym, ends)
            if len(starts):
                owner = np.asarray(numbers)[np.searchsorted(ends, starts, side="right")]
                np.maximum.at(out, owner, self.windows(sym, starts, lengths))
        return out


def batches_of(texts: list[str | None], size: int = PIECE) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, texts or pieces of them) of about ``size`` characters.

    Longer texts are cut at white space, if there is any, and pieces begin ``OVERLAP`` characters early.
    """
    numbers, parts, n = [], [], 0
    for i, text in enumerate(texts):
        at = 0
        while text and at < len(text):
            cut = len(text)
            if cut - at > size:
                space = text.rfind(" ", at + size // 2, at + size)
                cut = space if space > 0 else at + size
            early = max(0, text.rfind(" ", 0, max(0, at - OVERLAP))) if at else 0
            part = text[max(early, at - 2 * OVERLAP) : cut]
            if n and n + len(part) > size:
                yield numbers, parts
                numbers, parts, n = [], [], 0
            numbers.append(i)
            parts.append(part)
            n += len(part) + WINDOW
            at = cut
    if numbers:
        yield numbers, parts


def fit(toxic: np.ndarray, clean: np.ndarray, landmarks: int = 384, penalty: float = 1e-4) -> Model:
    """Train on windows (rows of symbols) of both classes, which weigh the same in all."""
    windows = np.concatenate([toxic, clean])
    y = np.where(np.arange(len(windows)) < len(toxic), 1.0, -1.0)

    def spread(first: int, n: int) -> np.ndarray:
        return first + np.unique(np.linspace(0, n - 1, min(landmarks // 2, n)).astype(int))

    chosen = np.r_[spread(0, len(toxic)), spread(len(toxic), len(clean))]
    owner, code, value = features(windows[chosen])
    marks = np.zeros((len(chosen), BUCKETS), np.float32)
    np.add.at(marks, (owner, code), value)

    def kernel(part: np.ndarray) -> np.ndarray:
        owner, code, value = features(part)
        return np.stack([np.bincount(owner, value * m[code], minlength=len(part)) for m in marks], axis=1)

    values, vectors = np.linalg.eigh(kernel(windows[chosen]))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    # in blocks, as the driver's memory is small
    x = np.ones((len(windows), root.shape[1] + 1))
    cuts = [slice(i, min(i + ROWS, len(windows))) for i in range(0, len(windows), ROWS)]
    for cut in cuts:
        x[cut, :-1] = kernel(windows[cut]) @ root
    weight = np.where(y > 0, 0.5 / len(toxic), 0.5 / len(clean))
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the squared hinge loss
        grad, curve = penalty * w, penalty * np.eye(len(w))
        for cut in cuts:
            part = x[cut]
            slack = np.maximum(0, 1 - y[cut] * (part @ w))
            active = slack > 0
            part, share = part[active], weight[cut][active]
            grad -= part.T @ (share * y[cut][active] * slack[active])
            curve += part.T @ (share[:, None] * part)
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return Model(((root @ w[:-1]) @ marks).astype(np.float64), float(w[-1]))


def calibrate(model: Model, worst: np.ndarray, toxic: np.ndarray) -> Model:
    """Put 0.5 where labelled texts part best, a share of clean texts above it counting sixteen times."""
    if not len(worst) or toxic.all():
        return model
    order = np.argsort(-worst, kind="stable")
    hit, miss = np.cumsum(toxic[order]) / toxic.sum(), np.cumsum(~toxic[order]) / (~toxic).sum()
    ends = np.append(worst[order][:-1] > worst[order][1:], True)  # not between equal margins
    best = int(np.argmax(np.where(ends, hit - 16 * miss, -np.inf)))
    low = worst[order[best + 1]] if best + 1 < len(order) else FLOOR
    middle = low + 0.8 * (worst[order[best]] - low)
    return Model(model.weights, model.bias, model.slope, float(-model.slope * middle))


def chosen_windows(sample: DataFrame, rate: Callable[..., np.ndarray], near: float = 0.9) -> tuple:
    """(windows of toxic texts, windows of clean texts, worst margins, toxic, held back) by the margins ``rate``.

    Of a toxic text the worst window and up to five others that come ``near`` it, of a clean one the three
    worst and one drawn by its id's hash. No window is taken of a fourth of the clean texts, which is held
    back to set the threshold. The sample is bounded, and so is what returns.
    """
    schema = "doc_id string, toxic boolean, place int, margin double, symbols binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for name, toxic, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                sym = np.frombuffer(raw, np.uint8)
                starts, lengths = windows_of(sym, np.array([len(sym) - WINDOW]))
                if not len(starts):
                    rows.append((name, toxic, 0, FLOOR, bytes(WINDOW)))
                    continue
                rated = rate(sym, starts, lengths)
                order = np.argsort(-rated, kind="stable")[:6]
                picked = [i for i in order if rated[i] >= rated[order[0]] - near] if toxic else [
                    *order[:3], zlib.crc32(name.encode()) % len(starts)
                ]
                for k, i in enumerate(picked):
                    window = sym[starts[i] : starts[i] + lengths[i]].tobytes()
                    rows.append((name, toxic, k, float(rated[i]), window.ljust(WINDOW, bytes([AFTER]))))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.string(), pa.bool_(), pa.int32(), pa.float64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "toxic", "place", "margin", "symbols"],
            )

    got = sample.select("doc_id", "toxic", "symbols").mapInArrow(run, schema).toArrow()
    got = got.sort_by([("doc_id", "ascending"), ("place", "ascending")])
    toxic = np.array(got["toxic"].to_pylist(), bool)
    windows = np.frombuffer(b"".join(got["symbols"].to_pylist()), np.uint8).reshape(-1, WINDOW)
    first = np.array(got["place"].to_pylist()) == 0
    margin = np.array(got["margin"].to_pylist(), float)
    some = windows.any(axis=1)
    held = ~toxic & np.array([zlib.crc32(n.encode()) % 4 == 3 for n in got["doc_id"].to_pylist()], bool)
    return windows[toxic & some], windows[~toxic & some & ~held], margin[first], toxic[first], held[first]


def group_odds(sample: DataFrame) -> np.ndarray:
    """Cautious log odds of toxic over clean texts with each group: less than the estimate by 1.5 deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, GROUPS), np.int64)
        for batch in batches:
            for toxic, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts[int(toxic)][np.unique(group_codes(np.frombuffer(raw, np.uint8)))] += 1
        used = np.flatnonzero(counts.any(axis=0))
        if len(used):
            yield pa.RecordBatch.from_arrays(
                [pa.array(used, pa.int32()), pa.array(counts[1][used]), pa.array(counts[0][used])], names=["code", "pos", "neg"]
            )

    parts = sample.select("toxic", "symbols").mapInArrow(run, "code int, pos long, neg long")
    sums = parts.groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    pos, neg = np.full(GROUPS, 0.5), np.full(GROUPS, 0.5)
    code = sums["code"].to_numpy()
    pos[code] += sums["pos"].to_numpy()
    neg[code] += sums["neg"].to_numpy()
    return np.log(pos / neg) - 1.5 * np.sqrt(1 / pos + 1 / neg)


def train(docs: DataFrame, labels: DataFrame, usable: Column, most_toxic: int = 2_000, most_clean: int = 8_000,
          rounds: int = 6, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fit on about ``most_toxic`` and ``most_clean`` labelled rows whose ids are ``usable``.

    Rows are drawn by a hash of their id, at a rate set by the size of the class, and read whole. Of rows of
    one class whose texts have the same two least group hashes, as near copies mostly do, one is used.
    """
    marked = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic"))
        .filter(usable & F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    )
    sizes = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sizes) < 2:
        return Model()
    rate = F.when(F.col("toxic"), min(1.0, most_toxic / sizes[True])).otherwise(min(1.0, most_clean / sizes[False]))
    drawn = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < rate * 1_000_000)
    sample = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).join(
        F.broadcast(drawn), "doc_id"
    ).select(F.col("doc_id").cast("string").alias("doc_id"), "toxic", "text")

    def read_symbols(batch: pa.RecordBatch) -> list:
        made, marks = [], []
        for text in batch.column(2).to_pylist():
            sym, _ = encoded([text or ""])
            least = np.unique(group_codes(sym) * 0x85EBCA6B & 0xFFFFFFFF)[:2]
            made.append(sym.tobytes())
            marks.append(least.tobytes())
        return [pa.array(made, pa.binary()), pa.array(marks, pa.binary())]

    fields = [T.StructField("symbols", T.BinaryType()), T.StructField("mark", T.BinaryType())]
    sample = append_columns(sample, fields, read_symbols, drop=("text",))
    sample = staged(sample.groupBy("toxic", "mark").agg(F.min(F.struct("doc_id", "symbols")).alias("d")).select(
        "toxic", "d.doc_id", "d.symbols"
    ))
    odds = group_odds(sample)
    toxic, clean, *_ = chosen_windows(sample, lambda *window: group_margins(*window, odds), 2.0)
    if not len(toxic) or not len(clean):
        return Model()
    seen = clean
    for _ in range(rounds):
        model = fit(toxic, seen)
        toxic, clean, worst, is_toxic, held = chosen_windows(sample, model.windows)
        seen = np.concatenate([seen, clean])[-3 * most_clean - len(clean) :]
    told = is_toxic | held if held.any() else is_toxic | True
    return calibrate(model, worst[told], is_toxic[told])


def score(docs: DataFrame, model: Model, text_col: str = "text", out: str = "score",
          drop: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with the probability, 0 to 1, that the whole text is toxic."""
    at = docs.columns.index(text_col)

    def scored(batch: pa.RecordBatch) -> list:
        return [pa.array(model.probability(model.worst(batch.column(at).to_pylist())), pa.float64())]

    return append_columns(docs, [T.StructField(out, T.DoubleType())], scored, drop)
