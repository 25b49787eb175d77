"""Duplicate detection.

A copied text may make up a third of the table, so groups are reduced with a partial aggregate
first and joined back with a salt; no window ever holds a whole group of copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.session import rank_within, salted_join

DEAD = ["REJECTED", "FAILED"]
STALE_SECONDS = 15 * 60


def _is_blocking(df: DataFrame, now: Column | None, stale_seconds: int) -> Column:
    """A row blocks later copies when it is live: completed, or in progress and still fresh."""
    if "status" not in df.columns:
        return F.lit(True)
    live = ~F.col("status").isin(DEAD)
    if now is None or "updated_at" not in df.columns:
        return live
    age = F.unix_timestamp(now) - F.unix_timestamp("updated_at")
    return live & ((F.col("status") == "COMPLETED") | (age <= stale_seconds))


def first_blocker(
    df: DataFrame,
    key: str,
    id_col: str,
    order: list[str],
    out: str,
    now: Column | None = None,
    stale_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """Add ``out`` = id of the oldest blocking row with the same ``key`` that is older than us."""
    place = F.struct(*[F.col(c) for c in order + [id_col]])
    blocking = _is_blocking(df, now, stale_seconds)
    groups = (
        df.where(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.min(F.when(blocking, place)).alias("_first"),
            F.count(F.lit(1)).alias("_copies"),
        )
        .where("_copies > 1 and _first is not null")
    )
    sizes = groups.select(key, F.col("_copies").alias("_n"))
    joined = salted_join(
        df, groups.select(key, "_first"), [key], [id_col], how="left", sizes=sizes
    )
    return joined.withColumn(
        out, F.when(F.col("_first") < place, F.col(f"_first.{id_col}"))
    ).drop("_first")


def exact_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    order: list[str] | None = None,
    checksum: str = "checksum",
    now: Column | None = None,
) -> DataFrame:
    """Same bytes as an older live document."""
    return first_blocker(df, checksum, id_col, order or [], "exact_duplicate_of", now)


def near_duplicates(
    df: DataFrame,
    id_col: str = "doc_id",
    order: list[str] | None = None,
    normalized: str = "normalized_hash",
    now: Column | None = None,
) -> DataFrame:
    """Same normalised text as an older live document, reported only for non-exact rows."""
    found = first_blocker(df, normalized, id_col, order or [], "near_duplicate_of", now)
    if "exact_duplicate_of" in df.columns:
        found = found.withColumn(
            "near_duplicate_of",
            F.when(F.col("exact_duplicate_of").isNull(), F.col("near_duplicate_of")),
        )
    return found


def reclaim_stale(
    df: DataFrame,
    now: Column,
    key: str = "checksum",
    stale_seconds: int = STALE_SECONDS,
) -> DataFrame:
    """D3: in-progress rows past the limit become FAILED when no live row of the key blocks."""
    blocking = _is_blocking(df, now, stale_seconds)
    blocked = df.groupBy(key).agg(F.max(blocking).alias("_blocked")).where("_blocked")
    joined = salted_join(df, blocked, [key], list(df.columns), how="left")
    orphan = (
        ~F.col("status").isin(DEAD + ["COMPLETED"])
        & ~blocking
        & F.col("_blocked").isNull()
    )
    return joined.select(
        *[c for c in df.columns if c != "status"],
        F.when(orphan, "FAILED").otherwise(F.col("status")).alias("status"),
        orphan.alias("reclaimed"),
    )


def duplicate_chunks(
    chunks: DataFrame, doc: str = "doc_id", seq: str = "seq", content_hash: str = "content_hash"
) -> DataFrame:
    """``is_duplicate`` marks the second and later chunk of a document with one hash.

    Rows without an id or hash are groups of their own kind, and of rows that share a place (an id that
    occurs twice) one stays. Rows are sorted and numbered as they pass, so no group is held.
    """
    from pyspark.sql import Window as W

    place = F.row_number().over(W.partitionBy(doc, content_hash).orderBy(seq))
    return chunks.withColumn("is_duplicate", place > 1)


def assign_version(
    df: DataFrame, order: list[str], checksum: str = "checksum", out: str = "version"
) -> DataFrame:
    """1 + number of earlier rows with the same bytes. ``order`` must be unique."""
    return rank_within(df, [checksum], order, out)


def corpus_dedupe(cases: DataFrame) -> DataFrame:
    """One row per (source, text) over the corpora of all cases."""
    return (
        cases.select(F.explode("corpus").alias("d"))
        .select("d.title", "d.source", "d.text")
        .dropDuplicates(["source", "text"])
    )


def duplicate_questions(
    cases: DataFrame, question: str = "question", exempt: Column | None = None
) -> DataFrame:
    """Cases whose diacritic-free question also occurs in another case."""
    normed = cases.withColumn("question_norm", T.strip_diacritics(question))
    if exempt is not None:
        normed = normed.where(~exempt)
    repeated = (
        normed.groupBy("question_norm").agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")
    )
    sizes = repeated.select("question_norm", F.col("copies").alias("_n"))
    return salted_join(normed, repeated, ["question_norm"], ["id"], sizes=sizes)


def dedupe_claims(claims: DataFrame, answer: list[str], order: str, text: str) -> DataFrame:
    """First of equal claims per answer, renumbered ``c1..cn`` in order."""
    from pyspark.sql import Window as W

    keyed = claims.withColumn("_key", T.squeeze(T.simple_lower(T.nfc(T.js_trim(F.col(text))))))
    first = keyed.where(F.col("_key") != "").groupBy(*answer, "_key").agg(
        F.min_by(F.struct(order, text), order).alias("_c")
    )
    rank = F.row_number().over(W.partitionBy(*answer).orderBy(f"_c.{order}"))
    return first.select(
        *answer,
        F.concat(F.lit("c"), rank).alias("claim_id"),
        F.col(f"_c.{text}").alias("claim_text"),
    )
