"""Registered queries over chunking and embeddings (K, Q5, D4, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.functions import vectors as V
from attestry.operators import chunking, dedupe
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return src.spread(src.table(spark, sf, "documents").select("doc_id", "lang", "text"))


def _summary(df: DataFrame) -> DataFrame:
    """K13 by document; the tallies of flags as one text, since maps have no order."""
    tallies = F.transform(
        F.array_sort(F.map_entries("flag_counts")), lambda t: F.concat_ws(":", t["key"], t["value"])
    )
    return chunking.chunking_summary(df, ["doc_id"]).withColumn("flag_counts", F.array_join(tallies, ","))


@query("chunk_structure")
def chunk_structure(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(chunking.chunk_documents(documents(spark, sf), "structure"))


@query("chunk_fixed")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(chunking.chunk_documents(documents(spark, sf), "fixed"))


@query("chunk_semantic")
def chunk_semantic(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    return _summary(
        chunking.chunk_documents(docs, "semantic", embed=lambda c: V.hash_embedding(c, 32))
    )


@query("compare_chunkers")
def compare_chunkers(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf)
    a = chunking.chunk_documents(docs, "structure").select("strategy", "tokens", "heading")
    b = chunking.chunk_documents(docs, "fixed").select("strategy", "tokens", "heading")
    return chunking.compare_chunkers(a.unionByName(b))


_PARAGRAPHS = rf"""parts AS (SELECT doc_id, p, i FROM (SELECT doc_id, unnest(ps) AS p,
  generate_subscripts(ps, 1) AS i FROM (SELECT doc_id, list_filter(list_transform(
  string_split_regex(CASE WHEN lang = 'fr' THEN text || chr(10) || chr(10) || upper(text) ELSE text END,
  '\n{{2,}}'), lambda x: {S.trim('x')}), lambda x: x <> '') AS ps FROM documents))),
para AS (SELECT doc_id, (i - 1)::BIGINT AS seq, p AS content,
  len(regexp_extract_all(p, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{S.WS}]'))::BIGINT AS tokens,
  sha256({S.trim(S.squeeze('lower(nfc_normalize(p))'))}) AS content_hash FROM parts),
marked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, content_hash ORDER BY seq) > 1
  AS is_duplicate FROM para)"""


def marked_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Paragraphs; those of French documents come twice, the second time in capitals."""
    docs = documents(spark, sf)
    twice = F.concat("text", F.lit("\n\n"), T.simple_upper("text"))
    docs = docs.withColumn("text", F.when(F.col("lang") == "fr", twice).otherwise(F.col("text")))
    parts = chunking.paragraph_chunks(docs)
    parts = parts.withColumn("content_hash", T.normalized_hash("content"))
    return dedupe.duplicate_chunks(parts)


@query(
    "duplicate_chunks",
    f"WITH {_PARAGRAPHS} SELECT doc_id, seq, content_hash FROM marked WHERE is_duplicate",
)
def duplicate_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return (
        marked_paragraphs(spark, sf).where("is_duplicate").select("doc_id", "seq", "content_hash")
    )


_NOISE = S.chars("content", rf"^\p{{L}}\p{{N}}{S.WS}.,;:!?()\"''%\-/|")
_FLAGS = rf"""flagged AS (SELECT *, tokens < 8 AS f1, tokens > 40 * 1.15::DOUBLE AS f2, true AS f3,
  is_duplicate AS f4, regexp_matches(content, '^\p{{Ll}}') AS f5,
  NOT regexp_matches(right(content, 1), '[.!?…:;)"”»\]|]') AS f6,
  {_NOISE}::DOUBLE / {S.utf16('content')} > 0.35 AS f7 FROM marked),
judged AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(1.0::DOUBLE
  - CASE WHEN f1 THEN 0.3 ELSE 0 END::DOUBLE - CASE WHEN f2 THEN 0.25 ELSE 0 END::DOUBLE
  - CASE WHEN f3 THEN 0.2 ELSE 0 END::DOUBLE - CASE WHEN f4 THEN 0.5 ELSE 0 END::DOUBLE
  - CASE WHEN f5 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN f6 THEN 0.15 ELSE 0 END::DOUBLE
  - CASE WHEN f7 THEN 0.3 ELSE 0 END::DOUBLE, 3))) AS quality_score,
  list_filter([CASE WHEN f1 THEN 'TOO_SHORT' END, CASE WHEN f2 THEN 'TOO_LONG' END,
  'MISSING_CONTEXT', CASE WHEN f4 THEN 'DUPLICATE' END,
  CASE WHEN f5 THEN 'STARTS_MID_SENTENCE' END, CASE WHEN f6 THEN 'ENDS_MID_SENTENCE' END,
  CASE WHEN f7 THEN 'HIGH_NOISE' END], lambda x: x IS NOT NULL) AS flags FROM flagged)"""


def judged_paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    """Bounds of 8 and 40 tokens suit paragraphs; chunks use the defaults."""
    return chunking.chunk_quality(marked_paragraphs(spark, sf), least=8, size=40)


@query(
    "chunk_quality",
    f"WITH {_PARAGRAPHS}, {_FLAGS} SELECT doc_id, seq, tokens, quality_score, "
    "array_to_string(flags, ',') AS flags FROM judged",
)
def chunk_quality(spark: SparkSession, sf: str) -> DataFrame:
    return judged_paragraphs(spark, sf).select(
        "doc_id", "seq", "tokens", "quality_score",
        F.array_join("quality_flags", ",").alias("flags"),
    )


_TALLIES = ", ".join(
    f"CASE WHEN count(*) FILTER (WHERE {f}) > 0 THEN '{flag}:' || count(*) FILTER (WHERE {f}) END"
    for flag, f in sorted(
        zip([flag for flag, _ in chunking.CHUNK_PENALTIES], ["f1", "f2", "f3", "f4", "f5", "f6", "f7"])
    )
)


@query(
    "chunking_summary",
    f"WITH {_PARAGRAPHS}, {_FLAGS} SELECT doc_id, count(*) AS chunks, "
    "sum(tokens)::BIGINT AS total_tokens, floor(avg(tokens) + 0.5)::BIGINT AS avg_tokens, "
    "round(avg(quality_score), 3) AS avg_quality, "
    "count(*) FILTER (WHERE is_duplicate) AS duplicate_chunks, "
    f"concat_ws(',', {_TALLIES}) AS flag_counts FROM judged GROUP BY doc_id",
)
def chunking_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _summary(judged_paragraphs(spark, sf))


@query(
    "chunk_flag_counts",
    f"WITH {_PARAGRAPHS}, {_FLAGS} SELECT flag, count(*) AS chunks FROM "
    "(SELECT unnest(flags) AS flag FROM judged) GROUP BY flag",
)
def chunk_flag_counts(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.flag_counts(judged_paragraphs(spark, sf), [])


@query(
    "embedding_summary",
    "SELECT CASE WHEN label < 7 THEN 'a' ELSE 'b' END AS model, label::INT AS label, len(embedding)::INT AS dimensions, "
    "count(*) AS vectors, count(*) FILTER (WHERE ok) AS valid, round(avg(n) FILTER (WHERE ok), 4) AS mean_norm FROM "
    "(SELECT *, len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: isfinite(x))) AS ok, "
    "sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS n FROM embeddings) GROUP BY ALL",
)
def embedding_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors per model, label and dimension, and how many pass validation."""
    rows = src.table(spark, sf, "embeddings").withColumn(
        "model", F.when(F.col("label") < 7, "a").otherwise("b")
    )
    return V.embedding_summary(rows, ["model", "label"], dim=64)


@query(
    "embedding_usage",
    "SELECT lang, count(*) AS texts, sum(ceil(length(text) / 4.0))::BIGINT AS tokens, "
    "round(sum(ceil(length(text) / 4.0))::DOUBLE / 1000 * 0.00002, 6) AS cost "
    "FROM documents GROUP BY lang",
)
def embedding_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Estimated tokens and cost of embedding every document."""
    docs = src.table(spark, sf, "documents")
    return docs.groupBy("lang").agg(
        F.count(F.lit(1)).alias("texts"),
        F.sum(V.embedding_tokens("text")).alias("tokens"),
        F.round(F.sum(V.embedding_tokens("text")) / 1000 * 0.00002, 6).alias("cost"),
    )


@query("embed_documents")
def embed_documents(spark: SparkSession, sf: str) -> DataFrame:
    """The deterministic provider over every document, validated."""
    docs = documents(spark, sf)
    rows = docs.select(
        "doc_id", "lang",
        V.hash_embedding("text", 64, model="e5-test", input_type="passage").alias("embedding"),
    )
    return (
        cut_lineage(rows)
        .where(V.is_valid_vector("embedding", 64))
        .groupBy("lang")
        .agg(F.count(F.lit(1)).alias("vectors"))
    )
