"""Table-level sinks and edits: replace, upsert, page, delete, report.

Writes go to Parquet folders partitioned by a hash bucket of the owner id, so replacing the parts
of some documents rewrites only their buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKETS = 64


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``new`` win over rows of ``old`` with the same key; both sides keyed uniquely."""
    kept = old.join(new.select(*keys), keys, "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def latest_wins(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """S9 within one feed: the last write per key, by partial aggregation rather than a window."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r"))
    return picked.select(*keys, "_r.*")


def list_page(
    df: DataFrame, filters: list[Column], order: list[Column], take: int, skip: int = 0
) -> DataFrame:
    """One ordered page with the filtered total on each row."""
    for condition in filters:
        df = df.where(condition)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    page = df.orderBy(*order).offset(skip).limit(take)
    return page.join(F.broadcast(total))  # one row


def cascade_delete(
    parts: dict[str, DataFrame], gone: DataFrame, key: str
) -> dict[str, DataFrame]:
    """Anti-join every table that hangs off the deleted ids."""
    ids = gone.select(key).distinct()
    return {name: df.join(ids, key, "left_anti") for name, df in parts.items()}


def with_bucket(df: DataFrame, owner: str, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(owner), F.lit(buckets)).cast("int"))


def write_parts(df: DataFrame, path: str, owner: str, buckets: int = BUCKETS) -> None:
    """First write of a bucketed part table; big buckets split by owner, not by one writer."""
    (
        with_bucket(df, owner, buckets)
        .repartition("bucket", owner)
        .write.mode("overwrite")
        .partitionBy("bucket")
        .parquet(path)
    )


def _replace(path: str, staging: str, merged: DataFrame, touched: DataFrame) -> None:
    """Write what the touched buckets shall hold next to the table first, since the plan reads it.

    Once both parts of ``staging`` are complete, ``finish_replace`` brings the table to its new
    state, and may be called again after a failure.
    """
    merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{staging}/rows")
    touched.write.mode("overwrite").parquet(f"{staging}/touched")
    finish_replace(merged.sparkSession, path, staging, merged.schema)


def finish_replace(spark: SparkSession, path: str, staging: str, schema: T.StructType) -> None:
    """Overwrite the touched buckets from ``staging`` and remove those that are empty now."""
    rows = spark.read.schema(schema).parquet(f"{staging}/rows")
    (
        rows.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("bucket")
        .parquet(path)
    )
    touched = spark.read.schema("bucket int").parquet(f"{staging}/touched")
    emptied = touched.join(rows.select("bucket").distinct(), "bucket", "left_anti").collect()  # at most all buckets
    jvm = spark.sparkContext._jvm
    for row in emptied:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={row['bucket']}")
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def _swap(new: DataFrame, gone: DataFrame, path: str, staging: str, owner: str, buckets: int) -> None:
    """Rows of ``new`` take the place of all rows with a key in ``gone``."""
    keys = gone.columns
    touched = with_bucket(gone, owner, buckets).select("bucket").distinct()
    placed = with_bucket(new, owner, buckets)
    old = new.sparkSession.read.schema(placed.schema).parquet(path).join(touched, "bucket", "left_semi")
    kept = old.join(gone, keys, "left_anti").select(*placed.columns)
    _replace(path, staging, kept.unionByName(placed), touched)


def replace_chunks(
    chunks: DataFrame, path: str, staging: str, owner: str = "doc_id", buckets: int = BUCKETS,
    owners: DataFrame | None = None,
) -> None:
    """The documents in ``owners`` get exactly these rows, or none; others are untouched.

    ``owners`` lists the documents that were chunked again, by default those with chunks.
    """
    ids = chunks.select(owner) if owners is None else owners.select(owner).union(chunks.select(owner))
    _swap(chunks, ids.distinct(), path, staging, owner, buckets)


def replace_embeddings(
    vectors: DataFrame, path: str, staging: str, buckets: int = BUCKETS, owners: DataFrame | None = None,
) -> None:
    """(chunk_id, model) rows are replaced, or removed if only ``owners`` has them; other
    models of the chunk stay."""
    keys = ["chunk_id", "model"]
    ids = vectors.select(*keys) if owners is None else owners.select(*keys).union(vectors.select(*keys))
    _swap(vectors, ids.distinct(), path, staging, "chunk_id", buckets)


def write_report(df: DataFrame, path: str) -> None:
    """A comparison table as JSON lines."""
    df.write.mode("overwrite").json(path)
