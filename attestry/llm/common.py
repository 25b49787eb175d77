"""Helpers shared by the operators: stage tables, appended columns, stable fold numbers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.session import ensure_checkpoint_dir


#: Folders of the operators' inner tables, in the order they were made.
STAGE_FOLDERS: list[str] = []


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the shared one of the session; it goes when the session ends.

    Only a local run that names no ``spark.checkpoint.dir`` gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        ensure_checkpoint_dir(spark)
        base = tempfile.mkdtemp(prefix="spark-")
    folder = f"{base.rstrip('/')}/stage-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def handed_over(df: DataFrame) -> DataFrame:
    """Write ``df`` to a Parquet table in the shared folder and read it from there."""
    folder = shared_folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def staged(df: DataFrame) -> DataFrame:
    """As ``handed_over``, for the inner tables of an operator, which ``delete_folders`` may end early."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    STAGE_FOLDERS.append(folder)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def delete_folders(spark: SparkSession, folders: list[str]) -> None:
    """Delete inner tables; only once what was made from them is written or not needed."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


def append_columns(
    df: DataFrame,
    fields: list[T.StructField],
    fn: Callable[[pa.RecordBatch], list],
    drop: tuple[str, ...] = (),
) -> DataFrame:
    """``df`` with further columns that ``fn`` derives from each Arrow batch, without ``drop``."""
    kept = [i for i, f in enumerate(df.schema.fields) if f.name not in drop]
    schema = T.StructType([*[df.schema.fields[i] for i in kept], *fields])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                own = [batch.column(i) for i in kept]
                yield pa.RecordBatch.from_arrays([*own, *fn(batch)], names=names)

    return df.mapInArrow(run, schema)


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id's decimal text modulo ``folds``; a null id counts as the empty text."""
    text = F.coalesce(doc_id.cast("string"), F.lit(""))
    return F.crc32(F.encode(text, "UTF-8")) % folds
