"""Sharding: a Feistel permutation of global row numbers gives each row its shard and slot.

Rows are numbered 0..n-1 in the order of their keys. A Feistel network over the pairs
(L, R) in Z_a x Z_b, with a*b the least such product of near-equal sides that is not below n,
permutes the numbers; a number that leaves 0..n-1 is permuted again (cycle walking). The place p
of a row then tells its shard (p mod shards) and slot (p div shards), so that shards differ by
one row at most, slots have no gaps, and any worker can compute a row's place from its number.
Only DataFrame functions are used.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.session import rank_within

PRIME = 2_147_483_647
ROUNDS = 8


def div(x: Column, by: int) -> Column:
    """Whole-number division of a non-negative long, exact for all longs."""
    return F.call_function("div", x, F.lit(by).cast("long"))


@dataclass(frozen=True)
class Permutation:
    """A keyed bijection of 0..n-1; ``depth`` bounds the steps that cycle walking takes."""

    n: int
    a: int
    b: int
    keys: tuple[tuple[int, int, int], ...]
    depth: int = 0

    @staticmethod
    def sides(n: int) -> tuple[int, int]:
        a = max(1, isqrt(max(n - 1, 0)) + 1)
        return a, max(1, -(-n // a))

    @classmethod
    def build(cls, spark: SparkSession, n: int, seed: int) -> Permutation:
        a, b = cls.sides(n)
        keys = []
        state = (seed * 1_000_003 + 12_345) % PRIME
        for i in range(ROUNDS):
            row = []
            for _ in range(2):
                state = (state * 48_271 + 11) % PRIME
                row.append(1 + state % (PRIME - 1))
            keys.append((row[0], row[1], (a, b)[i % 2]))
        perm = cls(n, a, b, tuple(keys))
        return cls(n, a, b, perm.keys, perm._longest_walk(spark))

    def _longest_walk(self, spark: SparkSession) -> int:
        """Steps until every number of n..a*b-1 that can get back below n is there.

        Fewer than a + b numbers lie outside, about the square root of n. Numbers that are still
        outside after a step that freed none move on closed cycles that no row can enter.
        """
        outside = spark.range(self.n, self.a * self.b).select(F.col("id").alias("p"))
        steps, left = 0, self.a * self.b - self.n
        while left:
            steps += 1
            outside = outside.select(self.once(F.col("p")).alias("p")).filter(F.col("p") >= self.n)
            now = outside.count()
            if now == left:
                break
            left = now
        return steps

    def once(self, x: Column) -> Column:
        """One pass of the network over 0..a*b-1."""
        table = F.array(
            *[F.struct(F.lit(m).cast("long").alias("m"), F.lit(k).cast("long").alias("k"),
                       F.lit(q).cast("long").alias("q")) for m, k, q in self.keys]
        )
        start = F.struct(
            div(x, self.b).alias("x"),
            (x % self.b).cast("long").alias("y"),
        )

        def step(acc: Column, key: Column) -> Column:
            t = (acc["y"] * key["m"] + key["k"]) % PRIME
            mixed = ((t * t + key["k"]) % PRIME * key["m"]) % PRIME
            return F.struct(acc["y"].alias("x"), ((acc["x"] + mixed) % key["q"]).alias("y"))

        return F.aggregate(table, start, step, lambda s: s["x"] * self.b + s["y"])

    def place(self, x: Column) -> Column:
        """The place of row number ``x``: walk along the cycle until it is below n."""
        first = self.once(x)
        if not self.depth:
            return first
        return F.aggregate(
            F.sequence(F.lit(1), F.lit(self.depth)),
            first,
            lambda p, _: F.when(p < self.n, p).otherwise(self.once(p)),
        )


def shard_rows(
    docs: DataFrame, shards: int = 24, seed: int = 42, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, size, text_crc32, row_number, law, shard, slot and grown_shard of every row.

    Law ``rows``: shard sizes differ by one at most. Rows are numbered by (id, size, CRC), nulls
    first. A null text has no bytes: size 8, CRC 0. A null id is a key like any other. Rows equal
    in id, size and CRC get neighbouring numbers, which of them gets which is open. An empty table
    gives no rows. Other columns of ``docs`` aren't read. ``grown_shard`` is null under this law.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    spark = docs.sparkSession
    text = F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8")
    digests = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text).cast("long").alias("text_crc32"),
    )
    n = docs.count()
    numbered = rank_within(digests, [], ["doc_id", "size", "text_crc32"], out="row_number")
    perm = Permutation.build(spark, n, seed)
    placed = numbered.withColumn("row_number", F.col("row_number") - 1).withColumn(
        "place", perm.place(F.col("row_number"))
    )
    return placed.select(
        "doc_id", "size", "text_crc32", "row_number",
        F.lit("rows").alias("law"),
        (F.col("place") % shards).cast("int").alias("shard"),
        div(F.col("place"), shards).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, places: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` below ``path``, one folder per shard, rows in the order of their slots.

    ``places`` comes from ``shard_rows``; ids must be unique here. The shuffle is by shard and a
    range of slots, so that a shard may be written by many tasks.
    """
    slots = places.select(F.col("doc_id").alias("__id"), F.col("shard").alias("__shard"),
                          F.col("slot").alias("__slot"))
    joined = docs.join(slots, docs[id_col].eqNullSafe(F.col("__id"))).drop("__id")
    (
        joined.repartitionByRange("__shard", "__slot")
        .sortWithinPartitions("__shard", "__slot")
        .withColumn("shard_number", F.col("__shard")).drop("__shard")
        .withColumnRenamed("__slot", "slot_number")
        .write.partitionBy("shard_number").parquet(path)
    )
