"""Registered queries over corpus preparation (S, P, C, Q, D)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import dedupe, ingest
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage, ensure_checkpoint_dir
from attestry.sources import documents as src
from attestry.sources import tables

QUERIES, ORACLES, query = registry()


# --- building blocks ------------------------------------------------------------------------------
def normalized(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "lang", "source", "text"))
    return ingest.normalize_text(docs.withColumn("raw_checksum", F.sha2("text", 256)))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.clean_text(normalized(spark, sf))


def quality(spark: SparkSession, sf: str) -> DataFrame:
    """Documents have no title; a constant one avoids charging every row for it."""
    docs = cleaned(spark, sf).withColumn("title", F.lit("document"))
    return ingest.document_quality(docs)


def gated(spark: SparkSession, sf: str) -> DataFrame:
    docs = quality(spark, sf).select(
        "doc_id",
        "lang",
        "source",
        F.col("raw_checksum").alias("checksum"),
        T.normalized_hash("text", compose=False).alias("normalized_hash"),
        "quality_score",
        "quality_valid",
        "quality_issues",
        F.when(F.col("quality_valid"), "VALIDATING").otherwise("REJECTED").alias("status"),
    )
    # Stage boundary: the text work is done once, later joins see narrow rows only.
    docs = cut_lineage(docs)
    docs = dedupe.exact_duplicates(docs)
    docs = dedupe.near_duplicates(docs)
    live = F.col("quality_valid")
    docs = docs.withColumns(
        {
            "exact_duplicate_of": F.when(live, F.col("exact_duplicate_of")),
            "near_duplicate_of": F.when(live, F.col("near_duplicate_of")),
        }
    ).drop("status")
    return ingest.quality_gate(docs)


# --- queries ------------------------------------------------------------------------------------------
_PAGE_TEXT = "html"
for _p, _to in [
    (r"<!--(?s:.*?)-->", ""),
    (r"(?i)<script(?s:.*?)</script>|<style(?s:.*?)</style>|<head(?s:.*?)</head>", ""),
    (r"(?i)</(?:p|div|section|article|li|h[1-6]|tr|br)>", "\n"),
    (rf"(?i)<br[{S.WS}]*/?>", "\n"),
    (r"<[^>]+>", ""),
    ("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'),
    ("&#39;", "'"),
    (r"[ \t]+\n", "\n"),
    (r"\n{3,}", "\n\n"),
]:
    _PAGE_TEXT = S.rep(_PAGE_TEXT, _p, _to)
_PAGE_TEXT = S.trim(_PAGE_TEXT)


@query(
    "html_to_text",
    f"SELECT page_id, url, sha256(x) AS text_sha, length(x)::BIGINT AS text_length "
    f"FROM (SELECT page_id, url, {_PAGE_TEXT} AS x FROM pages)",
)
def html_to_text(spark: SparkSession, sf: str) -> DataFrame:
    pages = src.table(spark, sf, "pages")
    return pages.select("page_id", "url", src.html_to_text("html").alias("x")).select(
        "page_id",
        "url",
        F.sha2("x", 256).alias("text_sha"),
        F.length("x").cast("long").alias("text_length"),
    )


@query(
    "parse_documents",
    f"""SELECT kind, id, title, source, checksum, parser, parse_error, sha256(x) AS text_sha FROM (
  SELECT 'document' AS kind, doc_id AS id, 'untitled' AS title, source,
    sha256(text) AS checksum,
    CASE WHEN lang = 'de' THEN NULL ELSE 'plaintext' END AS parser,
    CASE WHEN lang = 'de' THEN 'PARSER_UNAVAILABLE'
         WHEN {S.trim('text')} = '' THEN 'EMPTY_OUTPUT' END AS parse_error,
    CASE WHEN lang <> 'de' AND {S.trim('text')} <> ''
         THEN {S.rep('text', chr(92) + 'r' + chr(92) + 'n', chr(10))} END AS x
  FROM documents
  UNION ALL
  SELECT 'page', page_id, 'untitled', 'api', sha256(html), 'html',
    CASE WHEN {S.trim('html')} = '' THEN 'EMPTY_OUTPUT' END,
    CASE WHEN {S.trim('html')} <> '' THEN {_PAGE_TEXT} END
  FROM pages)""",
)
def parse_documents(spark: SparkSession, sf: str) -> DataFrame:
    """Mixed uploads. German files stand for PDFs, which need an external converter."""
    docs = src.table(spark, sf, "documents").select(
        F.lit("document").alias("kind"),
        F.col("doc_id").alias("id"),
        "source",
        F.encode("text", "UTF-8").alias("content"),
        F.when(F.col("lang") == "de", "application/pdf")
        .when(F.col("lang") == "fr", "text/markdown; charset=utf-8")
        .otherwise("text/plain")
        .alias("mime_type"),
    )
    pages = src.table(spark, sf, "pages").select(
        F.lit("page").alias("kind"),
        F.col("page_id").alias("id"),
        F.lit(None).cast("string").alias("source"),
        F.encode("html", "UTF-8").alias("content"),
        F.lit("text/html").alias("mime_type"),
    )
    parsed = src.parse_documents(src.with_checksum(src.with_defaults(docs.unionByName(pages))))
    return parsed.select(
        "kind", "id", "title", "source", "checksum", "parser", "parse_error",
        F.sha2("text", 256).alias("text_sha"),
    )


@query(
    "normalize_documents",
    f"WITH {S.normalized_ctes()} SELECT doc_id, sha256(t) AS text_sha, "
    "length(t)::BIGINT AS text_length, substr(tr, 2) AS transformations FROM norm",
)
def normalize_documents(spark: SparkSession, sf: str) -> DataFrame:
    return normalized(spark, sf).select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha"),
        F.length("text").cast("long").alias("text_length"),
        F.array_join("transformations", "|").alias("transformations"),
    )


@query(
    "clean_documents",
    f"WITH {S.normalized_ctes()}, {S.cleaned_ctes()} SELECT doc_id, sha256(t) AS text_sha, "
    "length(t)::BIGINT AS text_length, substr(tr, 2) AS transformations FROM cleaned",
)
def clean_documents(spark: SparkSession, sf: str) -> DataFrame:
    return cleaned(spark, sf).select(
        "doc_id",
        F.sha2("text", 256).alias("text_sha"),
        F.length("text").cast("long").alias("text_length"),
        F.array_join("transformations", "|").alias("transformations"),
    )


_SCORED = f"WITH {S.normalized_ctes()}, {S.cleaned_ctes()}, {S.quality_ctes()}"
_GATED = f"{_SCORED}, {S.gate_ctes()}"


@query(
    "document_quality",
    f"{_SCORED} SELECT doc_id, chars::BIGINT AS chars, words::BIGINT AS words, "
    "lines::BIGINT AS lines, round(alpha_ratio, 6) AS alpha_ratio, "
    "round(symbol_ratio, 6) AS symbol_ratio, round(repetition_ratio, 6) AS repetition_ratio, "
    "quality_score, quality_valid, issues FROM scored",
)
def document_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality(spark, sf).select(
        "doc_id",
        F.col("chars").cast("long").alias("chars"),
        F.col("words").cast("long").alias("words"),
        F.col("lines").cast("long").alias("lines"),
        F.round("alpha_ratio", 6).alias("alpha_ratio"),
        F.round("symbol_ratio", 6).alias("symbol_ratio"),
        F.round("repetition_ratio", 6).alias("repetition_ratio"),
        "quality_score",
        "quality_valid",
        F.array_join(F.transform("quality_issues", lambda s: s["type"]), ",").alias("issues"),
    )


@query(
    "quality_gate",
    f"{_GATED} SELECT doc_id, lang, status, rejected_reason, exact_duplicate_of, "
    "near_duplicate_of, quality_score FROM gated",
)
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    return gated(spark, sf).select(
        "doc_id", "lang", "status", "rejected_reason", "exact_duplicate_of",
        "near_duplicate_of", "quality_score",
    )


_REPORT = (
    "count(*) AS documents, count(*) FILTER (WHERE status = 'VALIDATING') AS accepted, "
    "count(*) FILTER (WHERE rejected_reason = 'EXACT_DUPLICATE') AS exact_duplicates, "
    "count(*) FILTER (WHERE near_duplicate_of IS NOT NULL) AS near_duplicates, "
    "count(*) FILTER (WHERE rejected_reason = 'LOW_QUALITY') AS low_quality, "
    f"{S.js_round('avg(quality_score)')} AS mean_score"
)


@query("ingest_report", f"{_GATED} SELECT lang, {_REPORT} FROM gated GROUP BY lang")
def ingest_report(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: acceptance per language after the whole preparation chain."""
    return ingest.quality_report(gated(spark, sf), ["lang"])


@query(
    "quality_issue_counts",
    f"{_GATED}, x AS (SELECT source, unnest(string_split(issues, ',')) AS issue FROM gated "
    "WHERE issues <> '' UNION ALL SELECT source, 'DUPLICATE_CONTENT' FROM gated "
    "WHERE near_duplicate_of IS NOT NULL) "
    "SELECT source, issue, count(*) AS documents FROM x GROUP BY ALL",
)
def quality_issue_counts(spark: SparkSession, sf: str) -> DataFrame:
    return ingest.issue_counts(gated(spark, sf), ["source"])


@query(
    "quality_vs_labels",
    f"{_SCORED} SELECT l.quality::INT AS label, s.quality_valid, count(*) AS documents, "
    f"{S.js_round('avg(s.quality_score)')} AS mean_score FROM scored s "
    "JOIN labels l USING (doc_id) GROUP BY ALL",
)
def quality_vs_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Q3 against the given labels as a confusion table."""
    labels = src.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return (
        quality(spark, sf)
        .select("doc_id", "quality_valid", "quality_score")
        .join(labels, "doc_id")
        .groupBy("label", "quality_valid")
        .agg(
            F.count(F.lit(1)).alias("documents"),
            T.js_round(F.avg("quality_score")).alias("mean_score"),
        )
    )


@query(
    "exact_duplicates",
    "SELECT doc_id, f AS exact_duplicate_of FROM (SELECT doc_id, min(doc_id) OVER "
    "(PARTITION BY sha256(text)) AS f FROM documents) WHERE f < doc_id",
)
def exact_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("checksum")
    )
    return (
        dedupe.exact_duplicates(docs)
        .where("exact_duplicate_of is not null")
        .select("doc_id", "exact_duplicate_of")
    )


_NORM_KEY = S.trim(S.squeeze("lower(nfc_normalize(text))"))


@query(
    "near_duplicates",
    "WITH d AS (SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000000, "
    "'  ' || upper(replace(text, ' ', '   ')) FROM documents WHERE lang = 'fr'), "
    "n AS (SELECT doc_id, nfc_normalize(text) AS text, sha256(text) AS h FROM d) "
    "SELECT doc_id, n AS near_duplicate_of FROM (SELECT doc_id, "
    "min(doc_id) OVER (PARTITION BY h) AS f, "
    f"min(doc_id) OVER (PARTITION BY sha256({_NORM_KEY})) AS n FROM n) "
    "WHERE n < doc_id AND NOT (f < doc_id)",
)
def near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    """Every French document comes once more, in capitals and with wider blanks."""
    table = src.table(spark, sf, "documents")
    wide = F.concat(F.lit("  "), T.simple_upper(F.replace(F.col("text"), F.lit(" "), F.lit("   "))))
    changed = table.where("lang = 'fr'").select((F.col("doc_id") + 1_000_000_000_000).alias("doc_id"), wide.alias("text"))
    docs = src.spread(table.select("doc_id", "text").union(changed)).select(
        "doc_id",
        F.sha2("text", 256).alias("checksum"),
        T.normalized_hash("text").alias("normalized_hash"),
    )
    docs = cut_lineage(docs)  # hash every text once; the joins below read hashes only
    return (
        dedupe.near_duplicates(dedupe.exact_duplicates(docs))
        .where("near_duplicate_of is not null")
        .select("doc_id", "near_duplicate_of")
    )


@query(
    "document_versions",
    "SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS version "
    "FROM documents",
)
def document_versions(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("checksum")
    )
    return dedupe.assign_version(docs, ["doc_id"]).select("doc_id", "version")


_JOBS = (
    "SELECT o_orderkey AS job_id, o_custkey AS checksum, o_orderdate AS updated_at, "
    "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'P' THEN 'FAILED' ELSE 'EMBEDDING' END "
    "AS status FROM orders"
)


@query(
    "reclaim_stale",
    f"WITH j AS ({_JOBS}), m AS (SELECT max(updated_at) - INTERVAL 30 DAY AS cut FROM j), "
    "b AS (SELECT j.*, status = 'COMPLETED' OR (status = 'EMBEDDING' AND updated_at >= cut) "
    "AS blocks FROM j, m), "
    "w AS (SELECT *, max(blocks::INT) OVER (PARTITION BY checksum) AS any_block FROM b) "
    "SELECT job_id, CASE WHEN status = 'EMBEDDING' AND any_block = 0 THEN 'FAILED' ELSE status "
    "END AS status, status = 'EMBEDDING' AND any_block = 0 AS reclaimed FROM w",
)
def reclaim_stale(spark: SparkSession, sf: str) -> DataFrame:
    """D3 over orders as ingestion jobs: customer = content key, open order = in progress."""
    jobs = src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("checksum"),
        F.col("o_orderdate").cast("timestamp").alias("updated_at"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED")
        .when(F.col("o_orderstatus") == "P", "FAILED")
        .otherwise("EMBEDDING")
        .alias("status"),
    )
    clock = jobs.agg(F.max("updated_at").alias("_now"))
    jobs = jobs.join(F.broadcast(clock))  # one row
    out = dedupe.reclaim_stale(jobs, F.col("_now"), stale_seconds=30 * 86400)
    return out.select("job_id", "status", "reclaimed")


@query(
    "update_document_content",
    f"WITH {S.normalized_ctes()} SELECT d.doc_id, "
    "CASE WHEN n.t <> d.text THEN 2 ELSE 1 END::BIGINT AS version, "
    "CASE WHEN n.t <> d.text THEN 'QUEUED' ELSE 'COMPLETED' END AS status, "
    "sha256(n.t) AS checksum, n.t = d.text AS unchanged "
    "FROM documents d JOIN norm n USING (doc_id)",
)
def update_document_content(spark: SparkSession, sf: str) -> DataFrame:
    """The normalised text arrives as new content of every document."""
    old = src.table(spark, sf, "documents").select(
        "doc_id",
        F.sha2("text", 256).alias("checksum"),
        F.lit(1).cast("long").alias("version"),
        F.lit("COMPLETED").alias("status"),
    )
    new = ingest.normalize_text(src.table(spark, sf, "documents").select("doc_id", "text"))
    updates = new.select("doc_id", F.sha2("text", 256).alias("checksum"))
    return src.update_document_content(old, updates).select(
        "doc_id", "version", "status", "checksum", "unchanged"
    )


@query(
    "document_page",
    "SELECT doc_id, source, n_chars, (SELECT count(*) FROM documents WHERE lang = 'en') AS total "
    "FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 25 OFFSET 25",
)
def document_page(spark: SparkSession, sf: str) -> DataFrame:
    """Second page of 25 of the English documents, longest first."""
    docs = src.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    page = tables.list_page(
        docs, [F.col("lang") == "en"], [F.desc("n_chars"), F.col("doc_id")], take=25, skip=25
    )
    return page.select("doc_id", "source", "n_chars", "total")


@query(
    "upsert_labels",
    "WITH n AS (SELECT doc_id, CASE WHEN n_chars < 200 THEN 0 ELSE 1 END AS quality "
    "FROM documents WHERE lang = 'fr') "
    "SELECT coalesce(n.doc_id, l.doc_id) AS doc_id, "
    "CASE WHEN n.doc_id IS NOT NULL THEN n.quality ELSE l.quality END::INT AS quality "
    "FROM labels l FULL JOIN n ON l.doc_id = n.doc_id",
)
def upsert_labels(spark: SparkSession, sf: str) -> DataFrame:
    """New labels of the French documents replace or extend the given ones."""
    old = src.table(spark, sf, "labels").select("doc_id", "quality")
    new = (
        src.table(spark, sf, "documents")
        .where("lang = 'fr'")
        .select("doc_id", F.when(F.col("n_chars") < 200, 0).otherwise(1).alias("quality"))
    )
    return tables.upsert(old, new, ["doc_id"])


@query(
    "cascade_delete",
    "SELECT 'documents' AS part, count(*) AS kept FROM documents WHERE doc_id NOT IN "
    "(SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL SELECT 'paragraphs', count(*) FROM ("
    r"SELECT doc_id, unnest(string_split_regex(text, '\n{2,}')) AS p FROM documents) "
    "WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) UNION ALL "
    "SELECT 'labels', count(*) FROM labels WHERE toxic <> 1",
)
def cascade_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Documents labelled toxic go, with their paragraphs and labels."""
    docs = src.table(spark, sf, "documents").select("doc_id", "text")
    labels = src.table(spark, sf, "labels")
    parts = docs.select("doc_id", F.explode(F.split("text", r"\n{2,}", -1)).alias("paragraph"))
    gone = labels.where("toxic = 1").select("doc_id")
    kept = tables.cascade_delete(
        {"documents": docs, "paragraphs": parts, "labels": labels}, gone, "doc_id"
    )
    counts = [
        df.agg(F.count(F.lit(1)).alias("kept")).select(F.lit(name).alias("part"), "kept")
        for name, df in kept.items()
    ]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


# --- sinks (S7, S8, S11) ---------------------------------------------------------------------------
def _workspace(spark: SparkSession) -> str:
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}"


def _line_rows(docs: DataFrame) -> DataFrame:
    lines = docs.select("doc_id", F.posexplode(T.split_all(F.col("text"), "\n")).alias("seq", "line"))
    return lines.select("doc_id", "seq", F.sha2("line", 256).alias("line_sha"))


_LINES = (
    "SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1)::INT - 1 AS seq FROM "
    "(SELECT doc_id, string_split({0}, chr(10)) AS ls FROM documents WHERE {1})"
)


@query(
    "replace_chunks",
    f"SELECT doc_id, seq, sha256(line) AS line_sha FROM ({_LINES.format('text', "lang NOT IN ('fr', 'es')")} "
    f"UNION ALL {_LINES.format('upper(text)', "lang = 'fr'")})",
)
def replace_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """French documents are chunked again from other texts, Spanish ones to nothing."""
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "text")
    folder = _workspace(spark)
    tables.write_parts(_line_rows(docs), f"{folder}/parts", "doc_id", 8)
    again = docs.where("lang IN ('fr', 'es')").select("doc_id")
    new = _line_rows(docs.where("lang = 'fr'").withColumn("text", T.simple_upper("text")))
    tables.replace_chunks(new, f"{folder}/parts", f"{folder}/staging", buckets=8, owners=again)
    return spark.read.parquet(f"{folder}/parts").select("doc_id", "seq", "line_sha")


@query(
    "replace_embeddings",
    "SELECT vec_id AS chunk_id, 'a' AS model, label FROM embeddings WHERE label >= 5 UNION ALL "
    "SELECT vec_id, 'a', -label FROM embeddings WHERE label BETWEEN 1 AND 4 UNION ALL "
    "SELECT vec_id, 'b', label FROM embeddings",
)
def replace_embeddings(spark: SparkSession, sf: str) -> DataFrame:
    """Labels 1 to 4 get new vectors of one model, label 0 loses its; the other model stays."""
    rows = src.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "label")
    model = lambda df, m: df.select("chunk_id", F.lit(m).alias("model"), "label")
    folder = _workspace(spark)
    tables.write_parts(model(rows, "a").union(model(rows, "b")), f"{folder}/parts", "chunk_id", 8)
    again = model(rows.where("label < 5"), "a")
    new = model(rows.where("label BETWEEN 1 AND 4").withColumn("label", -F.col("label")), "a")
    tables.replace_embeddings(new, f"{folder}/parts", f"{folder}/staging", 8, owners=again)
    return spark.read.parquet(f"{folder}/parts").select("chunk_id", "model", "label")


@query(
    "write_report",
    "SELECT lang, source, count(*) AS documents FROM documents GROUP BY ALL",
)
def write_report(spark: SparkSession, sf: str) -> DataFrame:
    """A table as JSON lines, read back with its schema."""
    rows = src.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count(F.lit(1)).alias("documents"))
    folder = _workspace(spark)
    tables.write_report(rows, f"{folder}/report")
    return spark.read.schema("lang string, source string, documents long").json(f"{folder}/report")
