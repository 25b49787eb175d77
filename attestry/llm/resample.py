"""Importance resampling towards a target, with an Aho-Corasick dictionary of checksums.

A feature's bucket is the CRC-32 of its bytes modulo ``buckets``. No feature is ever spelled out: the
CRC of two joined strings follows from both CRCs and the second's length. Texts are taken in pieces of
at most ``PIECE`` bytes (or one word). The distinct words of the pieces at hand, each between two delimiters, are the
dictionary of an automaton; a word's payload is a number that stands for its CRC, the CRC of the word
after a space, and that one's length. One scan emits the payloads of all words in order, neighbours
are composed into the CRCs of runs of two and three words, and those give the buckets. Words over
``LONG`` bytes stand in the dictionary under a short name, so that it stays small.
Pieces of one text overlap by two words and count each run once.

Every task adds up its buckets before the shuffle, so two tables of ``buckets`` counts are all that
reaches the driver, and the gains, one number a bucket, all that goes back to the tasks. Ranks of
the drawn rows come from range slices, never from one sorted task.

Results for odd rows: a null or empty text has no features, weight 0, and is never drawn; long texts
are read whole; repeated rows count each, and equal scores go to the smaller id (then fewer
features, smaller weight); a null id counts as the empty text in the hash and comes last among ties; empty
tables, of documents or of the target, count as zero features; extra columns aren't used.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import staged
from attestry.session import rank_within

PIECE = 1 << 22
LONG = 255
LOW_BITS = 6

#: Bytes of words as they are, capitals folded, every other one a space.
FOLDED = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20 for c in range(256)
)


class Joined:
    """CRC-32 of joined strings, for arrays: shifting a CRC by n bytes is linear over its bits."""

    def __init__(self) -> None:
        byte = np.array([zlib.crc32(bytes([b])) for b in range(256)], np.uint32)
        # the CRC of one byte holds the start value's part; the linear part alone has none for byte 0
        self.byte = byte ^ byte[0]
        tables = [np.array([[b << 8 * j for b in range(256)] for j in range(4)], np.uint32)]
        for _ in range((1 << LOW_BITS) - 1):
            last = tables[-1]
            tables.append((last >> np.uint32(8)) ^ self.byte[last & np.uint32(255)])
        last = tables[-1]
        self.low = np.stack(tables)
        self.high = [(last >> np.uint32(8)) ^ self.byte[last & np.uint32(255)]]
        for _ in range(40 - LOW_BITS):
            self.high.append(self.apply(self.high[-1], self.high[-1]))

    @staticmethod
    def apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return (
            table[0][crc & np.uint32(255)] ^ table[1][crc >> np.uint32(8) & np.uint32(255)]
            ^ table[2][crc >> np.uint32(16) & np.uint32(255)] ^ table[3][crc >> np.uint32(24)]
        )

    def __call__(self, first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
        """CRCs of strings whose parts have the CRCs ``first`` and ``second``; the second's bytes are ``length``."""
        low = length & ((1 << LOW_BITS) - 1)
        out = self.low[low, 0, first & np.uint32(255)]
        for j in (1, 2, 3):
            out = out ^ self.low[low, j, first >> np.uint32(8 * j) & np.uint32(255)]
        rest = length >> LOW_BITS
        for table in self.high:
            if not rest.any():
                break
            odd = (rest & 1).astype(bool)
            out[odd] = self.apply(table, out[odd])
            rest = rest >> 1
        return out ^ second


def pieces(texts: Iterator[bytes], size: int = PIECE) -> Iterator[tuple[int, bytes, int]]:
    """(number of the text, a piece of its folded bytes, how many words at its start were counted before)."""
    for number, text in enumerate(texts):
        text = text.translate(FOLDED)
        if len(text) <= size:
            yield number, text, 0
            continue
        at, before = 0, b""
        while at < len(text):
            cut = len(text) if len(text) - at <= size else text.rfind(b" ", at, at + size) + 1
            if cut <= at:
                cut = text.find(b" ", at + size) + 1 or len(text)
            piece = before + b" " + text[at:cut]
            yield number, piece, len(before.split())
            # only the last words matter, and white space may hold many bytes
            before = b" ".join(piece.rsplit(None, 2)[-2:] if piece.rstrip().count(b" ") else piece.split())
            at = cut


def groups(parts: Iterator[tuple[int, bytes, int]], size: int = PIECE) -> Iterator[list[tuple[int, bytes, int]]]:
    """Runs of pieces of about ``size`` bytes, each at least one piece."""
    held, n = [], 0
    for part in parts:
        if held and n + len(part[1]) > size:
            yield held
            held, n = [], 0
        held.append(part)
        n += len(part[1]) + 64
    if held:
        yield held


class Scanner:
    """Buckets of all runs of 1 to 3 words of texts, by a dictionary made for each group of pieces."""

    BREAK = b"\n"

    def __init__(self, buckets: int, size: int = PIECE) -> None:
        self.buckets, self.size, self.joined = buckets, size, Joined()

    def scan(self, texts: Iterator[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(bucket of each feature, number of its text, whether it is one word), group by group."""
        for group in groups(pieces(texts, self.size), self.size):
            yield self.group(group)

    def group(self, group: list[tuple[int, bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        import ahocorasick

        split = [part.split() for _, part, _ in group]
        distinct = list(set().union(*split))
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        automaton.add_word(" \n ", 0)
        names = {}
        for i, word in enumerate(distinct, 1):
            if len(word) > LONG:
                names[word] = b"\n%d" % i
            automaton.add_word(f" {names.get(word, word).decode('latin-1')} ", i)
        automaton.make_automaton()
        crc = np.array([0, *(zlib.crc32(w) for w in distinct)], np.uint32)
        spaced = np.array([0, *(zlib.crc32(w, zlib.crc32(b" ")) for w in distinct)], np.uint32)
        length = np.array([0, *(len(w) + 1 for w in distinct)], np.int64)

        if names:
            split = [[names.get(w, w) for w in words] for words in split]
        line = b" " + b" ".join(b" ".join([*words, self.BREAK]) for words in split) + b" "
        found = np.fromiter(map(itemgetter(1), automaton.iter(line.decode("latin-1"))), np.int64)

        ends = found == 0
        part = np.cumsum(ends) - ends
        starts = np.concatenate([[0], np.flatnonzero(ends)[:-1] + 1])
        number = np.array([g[0] for g in group], np.int64)[part]
        fresh = np.arange(len(found)) - starts[part] >= np.array([g[2] for g in group], np.int64)[part]
        word = ~ends
        two = word[1:] & word[:-1]
        three = two[1:] & two[:-1]
        at2, at3 = np.flatnonzero(two) + 1, np.flatnonzero(three) + 2
        pair = np.zeros(len(found), np.uint32)
        pair[at2] = self.joined(crc[found[at2 - 1]], spaced[found[at2]], length[found[at2]])
        triple = self.joined(pair[at3 - 1], spaced[found[at3]], length[found[at3]])
        at1 = np.flatnonzero(word)
        at = np.concatenate([at1, at2, at3])
        codes = np.concatenate([crc[found[at1]], pair[at2], triple])
        single = np.arange(len(at)) < len(at1)
        new = fresh[at]
        return codes[new].astype(np.int64) % self.buckets, number[at][new], single[new]


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    for value in column:
        yield value.as_py() or b""


def bucket_counts(df: DataFrame, text: str, buckets: int) -> np.ndarray:
    """How many features of the table fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner, counts = Scanner(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for bucket, _, _ in scanner.scan(raw_texts(batch.column(0))):
                counts += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(counts)
        if len(used):
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used], pa.int64())], names=["bucket", "n"])

    parts = df.select(F.encode(F.col(text), "UTF-8").alias("t")).mapInArrow(run, "bucket int, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over its share in the source, one added to each."""
    buckets, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000.0 * math.log((float(t) + 1.0) * (s_all + buckets) / ((float(s) + 1.0) * (t_all + buckets))))
        for s, t in zip(source, target)
    ], np.int64)


def weighed(df: DataFrame, gain: np.ndarray, text: str) -> DataFrame:
    """``df`` without ``text``, with n_features, weight and __words (its number of words)."""
    buckets = len(gain)
    kept = [c for c in df.columns if c != text]
    fields = [T.StructField(n, T.LongType()) for n in ("n_features", "weight", "__words")]
    schema = T.StructType([*df.select(*kept).schema.fields, *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(buckets)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sums = np.zeros((3, n), np.int64)
            for bucket, number, single in scanner.scan(raw_texts(batch.column(len(kept)))):
                sums[0] += np.bincount(number, minlength=n)
                np.add.at(sums[1], number, gain[bucket])
                sums[2] += np.bincount(number[single], minlength=n)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(i) for i in range(len(kept))], *[pa.array(s) for s in sums]], names=schema.names
            )

    return df.select(*kept, F.encode(F.col(text), "UTF-8").alias("__text")).mapInArrow(run, schema)


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", share: int = 5, seed: int = 42,
    buckets: int = 10_000, least_words: int = 20,
) -> DataFrame:
    """Per document: doc_id, n_features, weight, score, and its rank if it is drawn.

    The score is the weight plus Gumbel noise from a hash of the id, so that the highest scores are a draw
    without replacement in proportion to exp(weight / 1000). ``share`` percent of the
    documents with at least ``least_words`` words are drawn.
    """
    gain = gains(bucket_counts(docs, text, buckets), bucket_counts(target, text, buckets))
    rows = weighed(docs.select(doc_id, text), gain, text)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(doc_id).cast("string"), F.lit("")))
    h = F.conv(F.left(F.sha2(F.encode(name, "UTF-8"), 256), F.lit(8)), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    usable = F.col("__words") >= least_words
    scored = staged(rows.withColumn("score", F.col("weight") + noise))
    draws = share * scored.filter(usable).count() // 100
    ordered = scored.select(
        "*", (~usable).alias("__off"), (-F.col("score")).alias("__down"), F.col(doc_id).isNull().alias("__last"),
    )
    ranked = rank_within(ordered, [], ["__off", "__down", "__last", doc_id, "n_features", "weight"], "__rank")
    return ranked.select(
        doc_id, "n_features", "weight", "score",
        F.when(usable & (F.col("__rank") <= draws), F.col("__rank")).alias("rank"),
    )
