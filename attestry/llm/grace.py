"""Exact dedup by Grace hashing.

Every task keeps the contents it has met in an open-addressing table that compares complete
contents. What no longer fits goes to spill files by the next bits of the hash, and each file is
worked off the same way, until all is resolved. The first pass runs on the rows as they are read,
so that a text copied a million times leaves each task once; only those rows are shuffled by hash
and resolved by the same table again. Spill files live in a task's own folder and go with it; all
that later stages need is in a stage table in the shared folder.
"""

from __future__ import annotations

import hashlib
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import staged

TABLE_BYTES = 64 << 20
FAN_OUT = 16
BITS = 4


class ContentTable:
    """Linear probing over a power-of-two array of entry numbers; grows up to its byte budget."""

    def __init__(self, budget: int):
        self.budget, self.used = budget, 0
        self.slots = [-1] * 256
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.owners: list[int] = []

    def find(self, h: int, content: bytes) -> int:
        """The slot that holds ``content``, or the free one where it would go."""
        mask = len(self.slots) - 1
        at = h & mask
        while (entry := self.slots[at]) >= 0:
            if self.hashes[entry] == h and self.contents[entry] == content:
                break
            at = (at + 1) & mask
        return at

    def resolve(self, h: int, content: bytes, row: int) -> int | None:
        """The first row with this content; None if it is new and there is no room for it."""
        at = self.find(h, content)
        if self.slots[at] >= 0:
            return self.owners[self.slots[at]]
        if self.contents and self.used + len(content) > self.budget:
            return None
        if 2 * len(self.contents) >= len(self.slots):
            self._grow()
            at = self.find(h, content)
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.owners.append(row)
        self.used += len(content) + 100
        return row

    def _grow(self) -> None:
        self.slots = [-1] * (4 * len(self.slots))
        mask = len(self.slots) - 1
        for entry, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry


def normalised(texts: pa.Array) -> list[bytes]:
    """Texts with A-Z lowered, in UTF-8; null counts as empty."""
    lowered = pc.ascii_lower(pc.fill_null(texts, ""))
    return lowered.cast(pa.large_binary() if pa.types.is_large_string(lowered.type) else pa.binary()).to_pylist()


def resolve(
    batches: Iterator[pa.RecordBatch], text_at: int, row_at: int, budget: int, folder: str, level: int = 0
) -> Iterator[tuple[pa.RecordBatch, list[int], list[bytes]]]:
    """Batches with, for each row, the first row number of its content and the content's SHA-256.

    Rows for which the table has no room are spilled and come out of the recursion.
    """
    table = ContentTable(budget)
    spills: dict[int, tuple] = {}
    for batch in batches:
        rows = batch.column(row_at).to_pylist()
        done, owners, digests, later = [], [], [], {}
        for i, content in enumerate(normalised(batch.column(text_at))):
            digest = hashlib.sha256(content).digest()
            h = int.from_bytes(digest[:8], "little")
            owner = table.resolve(h, content, rows[i])
            if owner is None:
                later.setdefault((h >> (60 - BITS * (level % 15))) % FAN_OUT, []).append(i)
            else:
                done.append(i)
                owners.append(owner)
                digests.append(digest)
        for bucket, picked in later.items():
            if bucket not in spills:
                path = os.path.join(folder, f"{level}-{bucket}-{len(os.listdir(folder))}")
                sink = pa.OSFile(path, "wb")
                spills[bucket] = (path, sink, pa.ipc.new_stream(sink, batch.schema))
            spills[bucket][2].write_batch(batch.take(pa.array(picked)))
        if done:
            yield (batch if len(done) == batch.num_rows else batch.take(pa.array(done))), owners, digests
    del table
    for path, sink, writer in spills.values():
        writer.close()
        sink.close()
    for path, _, _ in spills.values():
        with pa.OSFile(path, "rb") as source:
            yield from resolve(iter(pa.ipc.open_stream(source)), text_at, row_at, budget, folder, level + 1)
        os.remove(path)


def _resolver(text_at: int, row_at: int, kept: list[int], names: list[str], with_digest: bool, budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="grace-") as folder:
            some = (b for b in batches if b.num_rows)
            for batch, owners, digests in resolve(some, text_at, row_at, budget, folder):
                out = [batch.column(i) for i in kept] + [pa.array(owners, pa.int64())]
                if with_digest:
                    out.append(pa.array([d.hex() for d in digests], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return run


def mark_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES
) -> tuple[DataFrame, DataFrame]:
    """Two frames: the rows of ``docs`` with ``__row`` and ``__first`` columns, and their groups.

    ``rows`` has the columns of ``docs``, then __row (a number of the row), __first (of the first
    row with its content in the same input split) and __sha. ``groups`` has, for each __first,
    keep_row, keep_id and group_size of its whole group. Equal means identical after lowering A-Z;
    null counts as empty. The largest id stays, null ids are smaller than any other; of rows
    with the same id and text the first read stays. Empty tables give two empty frames.
    """
    numbered = docs.select(docs["*"], F.monotonically_increasing_id().alias("__row"))
    fields = [*numbered.schema.fields, T.StructField("__first", T.LongType()), T.StructField("__sha", T.StringType())]
    schema = T.StructType(fields)
    width = len(numbered.columns)
    first_pass = _resolver(docs.columns.index(text_col), width - 1, list(range(width)),
                           [f.name for f in fields], True, table_bytes)
    rows = staged(numbered.mapInArrow(first_pass, schema))

    firsts = (
        rows.filter(F.col("__first") == F.col("__row"))
        .select("__row", F.col(text_col).cast("string").alias("__text"), "__sha")
        .repartition("__sha")
    )
    second_pass = _resolver(1, 0, [0], ["__first", "__class"], False, table_bytes)
    classes = firsts.mapInArrow(second_pass, "__first long, __class long")
    here = rows.groupBy("__first").agg(
        F.count(F.lit(1)).alias("__n"),
        F.max(F.struct(F.col(id_col).alias("id"), (-F.col("__row")).alias("back"))).alias("__best"),
    )
    members = staged(classes.join(here, "__first"))
    totals = members.groupBy("__class").agg(F.sum("__n").alias("group_size"), F.max("__best").alias("__best"))
    groups = members.select("__first", "__class").join(totals, "__class").select(
        "__first",
        (-F.col("__best.back")).alias("keep_row"),
        F.col("__best.id").alias("keep_id"),
        "group_size",
    )
    return rows, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows, groups = mark_copies(narrow, table_bytes=table_bytes)
    return rows.select("doc_id", "__row", "__first", "__sha").join(groups, "__first").select(
        "doc_id", "keep_id", "group_size",
        (F.col("__row") == F.col("keep_row")).alias("kept"),
        F.col("__sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with the same columns."""
    rows, groups = mark_copies(docs, id_col, text_col, table_bytes)
    keep = groups.select(F.col("keep_row").alias("__row")).distinct()
    return rows.join(keep, "__row", "left_semi").select(*docs.columns)
