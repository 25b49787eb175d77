"""Registered queries over retrieval, fusion, re-ranking and context packing (R)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import text as T
from attestry.operators import fusion, retrieval
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage, work_folder
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()


# --- vector search: one query per label, its mean vector ---------------------------------------------
def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("chunk_id"), "embedding", "label"
    )


def label_queries(spark: SparkSession, sf: str, how: str = "mean") -> DataFrame:
    parts = vectors(spark, sf).select("label", F.posexplode("embedding").alias("i", "x"))
    value = F.avg(F.col("x").cast("double"))
    if how == "spread":
        value = F.max(F.col("x").cast("double")) + F.min(F.col("x").cast("double"))
    means = parts.groupBy("label", "i").agg(value.alias("m"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("qv")
    )


def _query_cte(name: str = "q", value: str = "avg(x)") -> str:
    return (
        f"{name} AS (SELECT label::INT AS query_id, list(m ORDER BY i) AS qv FROM "
        f"(SELECT label, i, {value} AS m FROM (SELECT label, generate_subscripts(embedding, 1) AS i, "
        "unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, i) GROUP BY label)"
    )


_COS = (
    "1 - list_dot_product(qv, e) / (sqrt(list_dot_product(qv, qv)) * "
    "sqrt(list_dot_product(e, e)))"
)
_DISTANCE = {
    "cosine": _COS,
    "l2": "sqrt(list_sum(list_transform(range(1, 65), "
    "lambda i: (qv[i] - e[i]) * (qv[i] - e[i]))))",
    "ip": "-list_dot_product(qv, e)",
}
_SCORE = {"cosine": "1 - distance / 2", "l2": "1 / (1 + greatest(distance, 0))",
          "ip": "(1 - distance) / 2"}


def _vector_ctes(kind: str, k: int, q: str = "q", out: str = "hits", where: str = "true") -> str:
    return (
        f"{out}_d AS (SELECT query_id, vec_id AS chunk_id, round({_DISTANCE[kind]}, 9) AS distance "
        f"FROM {q}, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE {where})), "
        f"{out} AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, "
        f"{S.js_round(_SCORE[kind], 6)})) AS score FROM (SELECT *, row_number() OVER "
        f"(PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank FROM {out}_d) "
        f"WHERE rank <= {k})"
    )


def _vector_query(kind: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        hits = retrieval.vector_topk(label_queries(spark, sf), vectors(spark, sf), 20, kind)
        return hits.select("query_id", "chunk_id", "rank", "score")

    return run


for _kind in ("cosine", "l2", "ip"):
    query(
        f"vector_topk_{_kind}",
        f"WITH {_query_cte()}, {_vector_ctes(_kind, 20)} "
        "SELECT query_id, chunk_id, rank, score FROM hits",
    )(_vector_query(_kind))


@query(
    "vector_topk_filtered",
    f"WITH {_query_cte()}, {_vector_ctes('cosine', 20, where='label IN (1, 3, 5)')} "
    "SELECT query_id, chunk_id, rank, score FROM hits",
)
def vector_topk_filtered(spark: SparkSession, sf: str) -> DataFrame:
    """The label plays the metadata key; only chunks of three labels may be returned."""
    allowed = vectors(spark, sf).where(F.col("label").isin(1, 3, 5))
    hits = retrieval.vector_topk(label_queries(spark, sf), allowed, 20)
    return hits.select("query_id", "chunk_id", "rank", "score")


_DONE = (
    "vec_id IN (SELECT e.vec_id FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id "
    "WHERE e.label < 7 AND d.lang <> 'es'{0})"
)


def completed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Labels below 7 have one model, the others another; Spanish documents were rejected."""
    table = src.table(spark, sf, "embeddings")
    own = table.select(
        F.col("vec_id").alias("chunk_id"), "embedding", F.when(F.col("label") < 7, "a").otherwise("b").alias("model")
    )
    parts = table.select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("doc_id"))
    docs = src.table(spark, sf, "documents").select(
        "doc_id", "source", "lang", F.when(F.col("lang") == "es", "REJECTED").otherwise("COMPLETED").alias("status")
    )
    return retrieval.searchable(own, parts, docs, "a")


@query(
    "vector_topk_completed",
    f"WITH {_query_cte()}, {_vector_ctes('cosine', 20, where=_DONE.format(''))} "
    "SELECT query_id, chunk_id, rank, score FROM hits",
)
def vector_topk_completed(spark: SparkSession, sf: str) -> DataFrame:
    """One model's vectors of completed documents only."""
    hits = retrieval.vector_topk(label_queries(spark, sf), completed_vectors(spark, sf), 20)
    return hits.select("query_id", "chunk_id", "rank", "score")


@query(
    "vector_topk_sources",
    f"WITH {_query_cte()}, "
    + _vector_ctes("cosine", 20, where=_DONE.format(
        " AND d.source IN ('src1', 'src2', 'src3') AND d.doc_id IN (1, 2, 3, 21, 22, 23, 41, 42, 43, 61, 62, 63) AND d.lang = 'en'"))
    + " SELECT query_id, chunk_id, rank, score FROM hits",
)
def vector_topk_sources(spark: SparkSession, sf: str) -> DataFrame:
    """R3 in full: an id list, a source list and a metadata key together."""
    ids = [1, 2, 3, 21, 22, 23, 41, 42, 43, 61, 62, 63]
    allowed = retrieval.apply_filters(
        completed_vectors(spark, sf), ids, ["src1", "src2", "src3"], {"lang": "en"}
    )
    hits = retrieval.vector_topk(label_queries(spark, sf), allowed, 20)
    return hits.select("query_id", "chunk_id", "rank", "score")


_LISTED = (
    "ld AS (SELECT query_id, vec_id AS chunk_id, round(" + _DISTANCE["cosine"] + ", 9) AS distance FROM q, "
    "(SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) WHERE vec_id % (query_id + 2) = query_id % 2), "
    "hits AS (SELECT *, greatest(0.0::DOUBLE, least(1.0::DOUBLE, " + S.js_round(_SCORE["cosine"], 6)
    + ")) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id)::INT AS rank "
    "FROM ld) WHERE rank <= 20)"
)


@query(
    "vector_topk_lists",
    f"WITH {_query_cte()}, {_LISTED} SELECT query_id, chunk_id, rank, score FROM hits",
)
def vector_topk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every query has a list of its own, from a half to a twelfth of the documents."""
    asked, x = label_queries(spark, sf), vectors(spark, sf)
    lists = asked.select("query_id").join(
        x.select(F.col("chunk_id").alias("doc_id")),
        F.expr("doc_id % (query_id + 2) = query_id % 2"),
    )
    allowed = retrieval.allowed_chunks(lists, x.select("chunk_id", F.col("chunk_id").alias("doc_id")))
    hits = retrieval.vector_topk(asked, x, 20, allowed=allowed)
    return hits.select("query_id", "chunk_id", "rank", "score")


@query(
    "vector_index",
    "SELECT true AS good_recall, (SELECT count(*) FROM embeddings) AS indexed",
)
def vector_index(spark: SparkSession, sf: str) -> DataFrame:
    """R2: an index of the even vectors, to which the odd ones are appended, finds 0.9 of the exact hits."""
    q, x = label_queries(spark, sf), vectors(spark, sf)
    path = work_folder(spark, "cells")
    retrieval.write_cell_index(x.where("chunk_id % 2 = 0"), path)
    retrieval.append_to_cell_index(x.where("chunk_id % 2 = 1"), path)
    index = retrieval.read_cell_index(spark, path)
    recall = retrieval.recall_against(
        retrieval.vector_topk(q, x, 20), retrieval.search_cells(q, index, 20)
    )
    n = index.tiles.agg(F.sum(F.size("c_ids")).alias("indexed"))
    return recall.agg((F.avg("recall") >= 0.9).alias("good_recall")).join(n)


@query(
    "vector_topk_ann",
    "SELECT true AS good_recall",
)
def vector_topk_ann(spark: SparkSession, sf: str) -> DataFrame:
    """R2 with its recall against R1."""
    q, x = label_queries(spark, sf), vectors(spark, sf)
    exact = retrieval.vector_topk(q, x, 20)
    recall = retrieval.recall_against(exact, retrieval.vector_topk_ann(q, x, 20))
    return recall.agg((F.avg("recall") >= 0.9).alias("good_recall"))


# --- keyword search: benchmark passages against all documents -----------------------------------------
def text_queries(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "benchmark").select(
        F.col("item_id").alias("query_id"), F.col("text").alias("query")
    )


def document_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return src.spread(
        src.table(spark, sf, "documents").select(
            F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), "doc_id", "source"
        )
    )


def keyword_hits(spark: SparkSession, sf: str, k: int = 20) -> DataFrame:
    terms = retrieval.query_terms(text_queries(spark, sf))
    postings = retrieval.build_postings(document_chunks(spark, sf), only=terms)
    return retrieval.keyword_topk(terms, postings, k)


_TOKENS_RE = r"[\p{L}\p{N}]+(?:[/\-.][\p{L}\p{N}]+)*"
_PHRASED = "lower(nfc_normalize(text))"
for _p in fixed.QUESTION_PHRASES:
    _PHRASED = f"replace({_PHRASED}, '{_p}', ' ')"
_STOP = S.text_list(fixed.QUERY_STOP_WORDS)
_TERM_CTE = (
    "terms AS (SELECT query_id, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS term FROM "
    "(SELECT item_id AS query_id, list_distinct(list_filter(regexp_extract_all("
    f"{_PHRASED}, '{_TOKENS_RE}'), lambda t: length(t) >= 2 AND NOT list_contains({_STOP}, t))) "
    f"AS a, list_distinct({S.words('nfc_normalize(text)')}) AS b FROM benchmark))"
)
_POSTING_CTE = (
    "postings AS (SELECT chunk_id, term, count(*) AS tf FROM (SELECT doc_id AS chunk_id, "
    f"unnest(list_concat({S.words('nfc_normalize(text)')}, regexp_extract_all("
    r"lower(nfc_normalize(text)), '[\p{L}\p{N}]+(?:[/\-.][\p{L}\p{N}]+)+'))) AS term "
    "FROM documents) GROUP BY ALL)"
)
_KEYWORD_CTES = (
    f"{_TERM_CTE}, {_POSTING_CTE}, kraw AS (SELECT query_id, chunk_id, round(sum(list_sum("
    "list_transform(range(1, tf + 1), lambda j: 1.0::DOUBLE / (j * j)))), 9) AS raw "
    "FROM terms JOIN postings USING (term) GROUP BY ALL), "
    "ktop AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, chunk_id)::INT "
    "AS rank FROM kraw), "
    "khits AS (SELECT query_id, chunk_id, rank, least(1.0::DOUBLE, "
    + S.js_round("raw / greatest(max(raw) OVER (PARTITION BY query_id), 1e-9)", 6)
    + ") AS score FROM ktop WHERE rank <= 20)"
)


@query(
    "keyword_query_terms",
    f"WITH {_TERM_CTE} SELECT query_id, term FROM terms",
)
def keyword_query_terms(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.query_terms(text_queries(spark, sf))


@query(
    "build_postings",
    f"WITH {_POSTING_CTE} SELECT term, count(*) AS chunks, sum(tf)::BIGINT AS occurrences "
    "FROM postings GROUP BY term",
)
def build_postings(spark: SparkSession, sf: str) -> DataFrame:
    postings = retrieval.build_postings(document_chunks(spark, sf))
    return postings.groupBy("term").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("tf").alias("occurrences")
    )


@query(
    "keyword_topk", f"WITH {_KEYWORD_CTES} SELECT query_id, chunk_id, rank, score FROM khits"
)
def keyword_topk(spark: SparkSession, sf: str) -> DataFrame:
    return keyword_hits(spark, sf)


_KEYWORD_LISTED = _KEYWORD_CTES.replace(
    "FROM terms JOIN postings USING (term) GROUP BY ALL",
    "FROM terms JOIN postings USING (term) JOIN documents d ON d.doc_id = chunk_id "
    "AND d.lang = ['en', 'de', 'fr', 'es'][query_id % 4 + 1] GROUP BY ALL",
)


@query(
    "keyword_topk_lists",
    f"WITH {_KEYWORD_LISTED} SELECT query_id, chunk_id, rank, score FROM khits",
)
def keyword_topk_lists(spark: SparkSession, sf: str) -> DataFrame:
    """Every query searches the documents of one language, given as its own list."""
    asked = text_queries(spark, sf)
    terms = retrieval.query_terms(asked)
    langs = F.element_at(F.array(*map(F.lit, ("en", "de", "fr", "es"))), (F.col("query_id") % 4 + 1).cast("int"))
    docs = src.table(spark, sf, "documents").select("doc_id", "lang")
    lists = asked.select("query_id", langs.alias("lang")).join(docs, "lang")
    chunks = document_chunks(spark, sf)
    postings = retrieval.build_postings(chunks, only=terms)
    allowed = retrieval.allowed_chunks(lists, chunks.select("chunk_id", "doc_id"))
    return retrieval.keyword_topk(terms, postings, 20, allowed=allowed)


@query(
    "stored_postings",
    f"WITH {_KEYWORD_CTES} SELECT query_id, chunk_id, rank, score FROM khits".replace(
        "FROM documents) GROUP BY ALL", "FROM documents WHERE doc_id % 10 <> 7) GROUP BY ALL"
    ),
)
def stored_postings(spark: SparkSession, sf: str) -> DataFrame:
    """Postings are stored with every third document reversed, which is then replaced by its
    text, and every tenth document is withdrawn; searches see what is left."""
    name = f"postings_{uuid.uuid4().hex}"
    docs = document_chunks(spark, sf)
    wrong = docs.withColumn(
        "content", F.when(F.col("doc_id") % 3 == 0, F.reverse("content")).otherwise(F.col("content"))
    )
    owners = docs.select("chunk_id", "doc_id")
    posted = lambda part: retrieval.build_postings(part, doc="doc_id", buckets=64)
    retrieval.write_postings(posted(wrong), name, owners)
    gone = docs.where("doc_id % 3 = 0 or doc_id % 10 = 7").select("doc_id")
    again = docs.where("doc_id % 3 = 0 and doc_id % 10 <> 7")
    retrieval.replace_postings(posted(again), name, owners, gone)
    hits = cut_lineage(
        retrieval.search_postings(retrieval.query_terms(text_queries(spark, sf)), spark, name)
    )
    for table in (name, f"{name}_replaced"):
        spark.sql(f"DROP TABLE {table}")
    return hits.select("query_id", "chunk_id", "rank", "score")


# --- fusion ------------------------------------------------------------------------------------------------
def two_runs(spark: SparkSession, sf: str) -> DataFrame:
    x = vectors(spark, sf)
    a = retrieval.vector_topk(label_queries(spark, sf), x, 20)
    b = retrieval.vector_topk(label_queries(spark, sf, "spread"), x, 15, "l2")
    cols = ["query_id", "chunk_id", "score"]
    return a.select(*cols, F.lit("vector").alias("source")).unionByName(
        b.select(*cols, F.lit("keyword").alias("source"))
    )


def _fusion_sql(part: str, best: str) -> str:
    return f"""WITH {_query_cte()}, {_query_cte('q2', 'max(x) + min(x)')},
{_vector_ctes('cosine', 20, 'q', 'ha')}, {_vector_ctes('l2', 15, 'q2', 'hb')},
runs AS (SELECT query_id, chunk_id, score, 'vector' AS source, 1.0::DOUBLE AS w FROM ha
  UNION ALL SELECT query_id, chunk_id, score, 'keyword', 0.7::DOUBLE FROM hb),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, source
  ORDER BY score DESC, chunk_id) AS r FROM runs),
fused AS (SELECT query_id, chunk_id, sum({part}) AS s, count(*) AS n, min(source) AS src
  FROM ranked GROUP BY ALL),
cut AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, chunk_id)
  AS rank FROM fused)
SELECT query_id, chunk_id, rank::INT AS rank,
  least(1.0::DOUBLE, {S.js_round(f's / (({best}) * 1.7)', 4)}) AS score,
  CASE WHEN n > 1 THEN 'hybrid' ELSE src END AS source FROM cut WHERE rank <= 20"""


@query("fuse_rrf", _fusion_sql("w / (60 + r)", "1.0::DOUBLE / 61"))
def fuse_rrf(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(two_runs(spark, sf)).select(
        "query_id", "chunk_id", "rank", "score", "source"
    )


@query("fuse_weighted", _fusion_sql("w * score", "1.0::DOUBLE"))
def fuse_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.fuse(two_runs(spark, sf), "weighted").select(
        "query_id", "chunk_id", "rank", "score", "source"
    )


@query(
    "retrieve_keyword_only",
    f"WITH {_KEYWORD_CTES} SELECT query_id, chunk_id, (row_number() OVER (PARTITION BY query_id "
    "ORDER BY score DESC, chunk_id))::INT AS rank, score FROM khits "
    "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 5",
)
def retrieve_keyword_only(spark: SparkSession, sf: str) -> DataFrame:
    """R7 with one source: sorted and cut, scores untouched."""
    runs = {"keyword": lambda: keyword_hits(spark, sf)}
    return retrieval.retrieve(runs, "keyword", 5).select("query_id", "chunk_id", "rank", "score")


# --- re-ranking and context -----------------------------------------------------------------------------------
def hit_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Keyword hits with query and chunk text; only texts that were hit leave the scan."""
    hits = cut_lineage(keyword_hits(spark, sf))  # read twice: to find the texts and to be joined with them
    texts = retrieval.of_keys(document_chunks(spark, sf), hits, "chunk_id")
    return hits.join(texts, "chunk_id").join(text_queries(spark, sf), "query_id")


_HIT_TEXT = (
    "ht AS (SELECT h.*, d.text AS content, d.source AS dsource, b.text AS query FROM khits h "
    "JOIN documents d ON d.doc_id = h.chunk_id JOIN benchmark b ON b.item_id = h.query_id)"
)


@query(
    "rerank_overlap",
    f"WITH {_KEYWORD_CTES}, {_HIT_TEXT}, s AS (SELECT query_id, chunk_id, rank, "
    f"len(list_intersect(list_distinct({S.words('query')}), list_distinct({S.words('content')})))"
    f"::DOUBLE / len(list_distinct({S.words('query')})) AS rs FROM ht), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) - 1 AS rr "
    "FROM s) SELECT query_id, chunk_id, rr::INT AS rerank_rank, round(rs, 6) AS rerank_score "
    "FROM r WHERE rr < 5",
)
def rerank_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.rerank_overlap(hit_texts(spark, sf)).select(
        "query_id", "chunk_id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score")
    )


@query(
    "rerank_scores",
    f"WITH {_KEYWORD_CTES}, s AS (SELECT h.query_id, h.chunk_id, h.rank, "
    "CASE WHEN d.n_chars % 5 = 0 THEN 0.0::DOUBLE "
    "WHEN (d.n_chars % 100 - 50) / 20.0::DOUBLE BETWEEN 0 AND 1 "
    "THEN (d.n_chars % 100 - 50) / 20.0::DOUBLE "
    "ELSE 1 / (1 + exp(-(d.n_chars % 100 - 50) / 20.0::DOUBLE)) END AS rs "
    "FROM khits h JOIN documents d ON d.doc_id = h.chunk_id), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, rank) - 1 AS rr "
    "FROM s) SELECT query_id, chunk_id, rr::INT AS rerank_rank, round(rs, 6) AS rerank_score "
    "FROM r WHERE rr < 5",
)
def rerank_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Raw logits derived from document length; every fifth length has no score."""
    hits = cut_lineage(keyword_hits(spark, sf))  # read twice: to be scored and to be ranked
    sizes = src.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "n_chars")
    scores = (
        hits.join(sizes, "chunk_id")
        .where("n_chars % 5 <> 0")
        .select("query_id", "chunk_id", ((F.col("n_chars") % 100 - 50) / 20.0).alias("raw"))
    )
    return fusion.rerank_scores(hits, scores).select(
        "query_id", "chunk_id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score")
    )


_COSTS = (
    "cost AS (SELECT query_id, chunk_id, score, dsource, row_number() OVER (PARTITION BY query_id "
    "ORDER BY score DESC, rank) AS o, 3 + len(regexp_extract_all('(' || dsource || ') ' || "
    rf"{S.trim('content')}, '[\p{{L}}\p{{N}}]+|[^\p{{L}}\p{{N}}{S.WS}]')) AS c FROM ht)"
)
_PACK = (
    f"{_KEYWORD_CTES}, {_HIT_TEXT}, {_COSTS}, pack AS ("
    "SELECT query_id, chunk_id, score, dsource, o, true AS kept, c AS total, 1 AS n FROM cost "
    "WHERE o = 1 UNION ALL SELECT k.query_id, k.chunk_id, k.score, k.dsource, k.o, "
    "p.total < 4000 AND p.total + k.c + 5 <= 4000, "
    "CASE WHEN p.total < 4000 AND p.total + k.c + 5 <= 4000 THEN p.total + k.c + 5 ELSE p.total END, "
    "CASE WHEN p.total < 4000 AND p.total + k.c + 5 <= 4000 THEN p.n + 1 ELSE p.n END "
    "FROM pack p JOIN cost k ON k.query_id = p.query_id AND k.o = p.o + 1)"
)


def packed(spark: SparkSession, sf: str) -> DataFrame:
    hits = hit_texts(spark, sf).withColumn("section", F.col("source"))
    return fusion.build_context(hits)


@query(
    "build_context",
    f"WITH RECURSIVE {_PACK} SELECT query_id, n::INT AS pos, chunk_id, score, "
    "(max(total) OVER (PARTITION BY query_id))::BIGINT AS total_tokens FROM pack WHERE kept",
)
def build_context(spark: SparkSession, sf: str) -> DataFrame:
    return packed(spark, sf).select("query_id", "pos", "chunk_id", "score", "total_tokens")


@query(
    "render_context",
    f"WITH RECURSIVE {_PACK} SELECT query_id, sha256(string_agg('[' || n || '] (' || dsource || "
    f"') ' || t, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY n)) AS context_sha "
    f"FROM (SELECT p.*, {S.trim('d.text')} AS t FROM pack p JOIN documents d "
    "ON d.doc_id = p.chunk_id WHERE kept) GROUP BY query_id",
)
def render_context(spark: SparkSession, sf: str) -> DataFrame:
    return fusion.render_context(packed(spark, sf)).select(
        "query_id", F.sha2("context", 256).alias("context_sha")
    )


@query(
    "validate_context",
    f"WITH RECURSIVE {_PACK}, s AS (SELECT query_id, count(*) AS chunks, max(score) AS top_score "
    "FROM pack WHERE kept GROUP BY query_id), v AS (SELECT item_id AS query_id, "
    "coalesce(chunks, 0) AS chunks, top_score FROM benchmark LEFT JOIN s ON query_id = item_id) "
    "SELECT query_id, chunks, top_score, chunks >= 2 AND top_score >= 0.15 AS proceed, "
    "CASE WHEN chunks < 2 THEN 'too_few_chunks' WHEN top_score < 0.15 THEN 'low_relevance' END "
    "AS reason FROM v",
)
def validate_context(spark: SparkSession, sf: str) -> DataFrame:
    out = fusion.validate_context(text_queries(spark, sf), packed(spark, sf), min_chunks=2)
    return out.select("query_id", "chunks", "top_score", "proceed", "reason")


@query(
    "context_sources",
    f"WITH RECURSIVE {_PACK} SELECT query_id, dsource AS doc_id, "
    "string_agg(chunk_id, ',' ORDER BY n) AS chunk_ids FROM pack WHERE kept GROUP BY ALL",
)
def context_sources(spark: SparkSession, sf: str) -> DataFrame:
    """R20 with the document source as the parent of the packed chunks."""
    rows = packed(spark, sf)
    origin = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("origin")
    )
    rows = rows.drop("doc_id").join(origin, "chunk_id").withColumnRenamed("origin", "doc_id")
    return retrieval.context_sources(rows).select(
        "query_id", "doc_id",
        F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"),
    )


@query(
    "retrieval_log",
    f"WITH {_KEYWORD_CTES} SELECT query_id, count(*) AS candidates, max(score) AS top_score, "
    "string_agg(chunk_id, ',' ORDER BY rank) AS results FROM khits GROUP BY query_id",
)
def retrieval_log(spark: SparkSession, sf: str) -> DataFrame:
    hits = keyword_hits(spark, sf).withColumn("source", F.lit("keyword"))
    ids = F.transform("results", lambda s: s["chunk_id"].cast("string"))
    return retrieval.retrieval_log(hits).select(
        "query_id", "candidates", "top_score", F.array_join(ids, ",").alias("results")
    )


@query(
    "attach_titles",
    f"WITH {_KEYWORD_CTES}, {_HIT_TEXT} SELECT query_id, chunk_id, "
    f"dsource AS title, {S.js_round('score', 4)} AS score, sha256(CASE WHEN length(content) > 1200 "
    "THEN substr(content, 1, 1200) || '…' ELSE content END) AS content_sha FROM ht",
)
def attach_titles(spark: SparkSession, sf: str) -> DataFrame:
    hits = hit_texts(spark, sf).select("query_id", "chunk_id", "doc_id", "score", "content")
    docs = src.table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"))
    return retrieval.attach_titles(hits, docs).select(
        "query_id", "chunk_id", "title", "score", F.sha2("content", 256).alias("content_sha")
    )


@query(
    "resolve_titles",
    "WITH q AS (SELECT DISTINCT p_brand AS query_id, list_distinct(regexp_extract_all(lower("
    r"strip_accents(p_brand)), '[\p{L}\p{N}]+')) AS w FROM part), t AS (SELECT p_partkey, "
    "p_name || ' ' || p_brand AS title FROM part) SELECT q.query_id, t.p_partkey AS doc_id "
    "FROM q JOIN t ON len(list_filter(w, lambda x: NOT list_contains(regexp_extract_all(lower("
    r"strip_accents(title)), '[\p{L}\p{N}]+'), x))) = 0",
)
def resolve_titles(spark: SparkSession, sf: str) -> DataFrame:
    """Parts as titled documents, brands as the asked title words."""
    part = src.table(spark, sf, "part")
    queries = part.select(F.col("p_brand").alias("query")).distinct()
    queries = queries.withColumn("query_id", F.col("query"))
    docs = part.select(
        F.col("p_partkey").alias("doc_id"), F.concat_ws(" ", "p_name", "p_brand").alias("title")
    )
    return retrieval.resolve_documents_by_title(queries, docs).select("query_id", "doc_id")
