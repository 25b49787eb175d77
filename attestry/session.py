"""Session set-up and the few physical-layout helpers shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "attestry", master: str | None = None, **conf: str) -> SparkSession:
    """Return a session with the settings the operators rely on.

    Nothing here is needed for right results; a cluster session made elsewhere works too.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only for local runs that have none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        sc.setCheckpointDir(configured)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a shared folder on a cluster")


def work_folder(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder, for tables that a job writes and reads again."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: the result survives lost executors and is computed once."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go as soon as it is written, not with the next collection."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def written(df: DataFrame, name: str = "rows") -> DataFrame:
    """``df`` by way of a compressed Parquet table in the shared folder; its shuffle files go at once.

    Cuts the lineage as ``cut_lineage`` does, for large tables: columns that aren't read later cost nothing,
    but rows are dealt anew by the table's splits.
    """
    spark = df.sparkSession
    folder = work_folder(spark, name)
    with shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def spread_hot(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str | Column],
    salts: int = 16,
    sizes: DataFrame | None = None,
    heavy: int = 10_000,
) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``_salt`` that differs from 0 only inside the hot keys of ``left``.

    Hot are keys of ``heavy`` rows or more, at most four for each shuffle partition: any key beyond
    those holds less than a quarter of a partition's share. That list is all that is broadcast. Rows of
    the right side are copied once per salt for hot keys, rows of other keys stay single. Rows
    with a null in their key match nothing and are dealt over the salts. ``sizes`` (``on``, ``_n``)
    gives known counts; otherwise the rows of ``left`` are counted, with partial sums.
    """
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("_n")) if sizes is None else sizes
    most = 4 * shuffle_partitions(left.sparkSession)
    hot = F.broadcast(
        counts.where(F.col("_n") >= heavy)
        .orderBy(F.desc("_n"), *on)
        .limit(most)
        .select(*on, F.lit(True).alias("_hot"))
    )
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int")
    unmatched = F.lit(False)
    for c in on:
        unmatched = unmatched | F.col(c).isNull()
    dealt = left.join(hot, on, "left").withColumn(
        "_salt", F.when(F.col("_hot") | unmatched, salt).otherwise(0)
    )
    all_salts = F.sequence(F.lit(0), F.lit(salts - 1))
    copied = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.when(F.col("_hot"), all_salts).otherwise(F.array(F.lit(0))))
    )
    return dealt.drop("_hot"), copied.drop("_hot")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    spread: list[str | Column],
    salts: int = 16,
    how: str = "inner",
    sizes: DataFrame | None = None,
    heavy: int = 10_000,
) -> DataFrame:
    """Equi-join whose left side may hold one key in a third of its rows.

    Left rows of a hot key get a salt from ``spread`` (columns that differ inside it), and the right
    rows of that key are copied once per salt, so it is served by ``salts`` tasks; all other
    keys join plainly (see ``spread_hot``). The right side should be the smaller one.
    """
    dealt, copied = spread_hot(left, right, on, spread, salts, sizes, heavy)
    return dealt.join(copied, on + ["_salt"], how).drop("_salt")


def rank_within(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    out: str = "rank",
    sums: dict[str, str] | None = None,
) -> DataFrame:
    """Exact ``row_number`` (from 1) inside ``keys`` that never puts a whole key in one task.

    Rows are range-partitioned by ``keys + order``; each slice is ranked on its own and shifted
    by the size of the earlier slices of the same key. ``sums`` maps an output name to a column
    whose inclusive running sum is wanted as well. ``order`` must be unique inside a key.
    The sliced rows are checkpointed once, so every later use sees the same slices.
    """
    from pyspark.sql import Window as W

    sums = sums or {}
    n = shuffle_partitions(df.sparkSession)
    sliced = df.repartitionByRange(n, *[F.col(c) for c in keys + order]).withColumn(
        "_slice", F.spark_partition_id()
    )
    sliced = cut_lineage(sliced)
    totals = sliced.groupBy(*keys, "_slice").agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.sum(c).alias(f"_sum_{o}") for o, c in sums.items()],
    )
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_slice",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(before), F.lit(0)).alias(f"_off_{o}") for o in sums],
    )
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    running = inside.rowsBetween(W.unboundedPreceding, W.currentRow)
    ranked = sliced.select(
        "*",
        F.row_number().over(inside).alias("_local"),
        *[F.sum(c).over(running).alias(f"_local_{o}") for o, c in sums.items()],
    )
    joined = ranked.join(offsets, keys + ["_slice"])
    result = joined.withColumn(out, (F.col("_local") + F.col("_off")).cast("long"))
    for o in sums:
        result = result.withColumn(o, F.col(f"_local_{o}") + F.col(f"_off_{o}"))
    drop = ["_slice", "_local", "_off"]
    for o in sums:
        drop += [f"_local_{o}", f"_off_{o}"]
    return result.drop(*drop)
