"""Registered queries over knowledge-graph tables (G). Runs of capitalised words in a document are
its entities; neighbouring entities are related. A document is one chunk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import graph as G
from attestry.operators import retrieval
from attestry.plans import search
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage, written
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()


def names(spark: SparkSession, sf: str) -> DataFrame:
    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return docs.select("doc_id", "lang", T.proper_nouns(T.nfc("text")).alias("names"))


def entity_rows(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = names(spark, sf) if found is None else found
    rows = found.select("doc_id", F.posexplode("names").alias("ord", "name"))
    words = F.size(F.split("name", rf"[{T.WS}]+"))
    return rows.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", "ord", "name",
        F.when(words >= 2, "org").otherwise("concept").alias("type"),
        F.col("name").alias("description"),
    )


def relation_rows(spark: SparkSession, sf: str, found: DataFrame | None = None) -> DataFrame:
    found = names(spark, sf) if found is None else found
    pairs = F.arrays_zip(
        F.slice("names", 1, F.greatest(F.size("names") - 1, F.lit(0))).alias("source"),
        F.slice("names", 2, F.greatest(F.size("names") - 1, F.lit(0))).alias("target"),
    )
    rows = found.where("size(names) > 1").select(
        "doc_id", F.posexplode(pairs).alias("ord", "p")
    )
    return rows.select(
        F.col("doc_id").alias("chunk_id"), "doc_id", "ord", "p.source", "p.target",
        F.lit("next to").alias("type"), F.lit("neighbours").alias("description"),
        (F.col("ord") % 12).cast("double").alias("strength"),
    )


def graph(spark: SparkSession, sf: str, describe: bool = True, found: DataFrame | None = None) -> G.Graph:
    """Resolved graph; the stage boundary keeps text out of everything that follows. Names are parts of a
    composed text and so composed themselves.

    Queries whose result holds no description leave them out.
    """
    found = written(names(spark, sf), "names") if found is None else found
    ents, links = entity_rows(spark, sf, found), relation_rows(spark, sf, found)
    return G.resolve_graph(ents, links, ["doc_id", "ord"], describe, composed=True)


_NORM = S.trim(S.squeeze("nfc_normalize(lower({e}))"))


def _norm(e: str) -> str:
    return _NORM.replace("{e}", e)


_NAMES = rf"""runs AS (SELECT doc_id, unnest(rs) AS raw, generate_subscripts(rs, 1) AS i FROM
  (SELECT doc_id, regexp_extract_all(nfc_normalize(text),
  '\p{{Lu}}\p{{L}}*(?:[{S.WS}]+\p{{Lu}}\p{{L}}*){{0,3}}') AS rs FROM documents)),
nm0 AS (SELECT doc_id, i, {S.trim('raw')} AS name FROM runs),
nm1 AS (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(name) ORDER BY i) AS rn FROM nm0
  WHERE length(name) >= 2),
nm AS (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS ord
  FROM nm1 WHERE rn = 1),
er AS MATERIALIZED (SELECT *, CASE WHEN len(string_split_regex(name, '[{S.WS}]+')) >= 2 THEN 'ORG'
  ELSE 'CONCEPT' END AS type, {_norm('name')} AS norm FROM nm),
ek AS MATERIALIZED (SELECT *, sha256(norm || '|' || lower(type)) AS key FROM er)"""
_ENT = (
    f"{_NAMES}, dp AS (SELECT key, name AS d, min(doc_id * 1000000 + ord) AS seen FROM ek GROUP BY 1, 2), "
    "dc AS (SELECT key, d, seen, sum(length(d) + 2) OVER (PARTITION BY key ORDER BY seen, d) - 2 AS sz "
    "FROM dp), de AS (SELECT key, string_agg(d, '; ' ORDER BY seen, d) AS description FROM dc "
    "WHERE sz <= 800 GROUP BY 1), "
    "ent AS MATERIALIZED (SELECT key, arg_min(name, doc_id * 1000000 + ord) AS name, any_value(type) "
    "AS type, count(DISTINCT doc_id) AS chunks FROM ek GROUP BY 1)"
)
_REL = (
    "loc AS MATERIALIZED (SELECT doc_id, norm, arg_max(key, ord) AS k FROM ek GROUP BY 1, 2), "
    "rr AS (SELECT doc_id, ord, norm AS sn, lead(norm) OVER (PARTITION BY doc_id ORDER BY ord) AS tn "
    "FROM ek), "
    "rk AS (SELECT r.doc_id, least(a.k, b.k) AS s, greatest(a.k, b.k) AS t FROM rr r "
    "JOIN loc a ON a.doc_id = r.doc_id AND a.norm = sn JOIN loc b ON b.doc_id = r.doc_id "
    "AND b.norm = tn WHERE tn IS NOT NULL AND a.k <> b.k), "
    "rm AS MATERIALIZED (SELECT DISTINCT sha256(s || '|' || t || '|next to') AS key, s, t, doc_id FROM rk), "
    "rel AS MATERIALIZED (SELECT key, s, t, count(*)::DOUBLE AS weight FROM rm GROUP BY 1, 2, 3)"
)


@query(
    "resolve_entities",
    f"WITH {_ENT} SELECT key, name, type, chunks, sha256(coalesce(description, '')) "
    "AS description_sha FROM ent LEFT JOIN de USING (key)",
)
def resolve_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(entity_rows(spark, sf))
    entities, mentions = G.resolve_entities(rows, ["doc_id", "ord"], composed=True)
    sizes = mentions.groupBy("key").agg(F.count(F.lit(1)).alias("chunks"))
    return entities.join(sizes, "key").select(
        G.shown("key").alias("key"), "name", "type", "chunks", F.sha2("description", 256).alias("description_sha")
    )


@query(
    "resolve_relations",
    f"WITH {_ENT}, {_REL} SELECT key, s AS source_key, t AS target_key, 'NEXT_TO' AS type, weight "
    "FROM rel",
)
def resolve_relations(spark: SparkSession, sf: str) -> DataFrame:
    found = cut_lineage(names(spark, sf))
    ents, links = entity_rows(spark, sf, found), relation_rows(spark, sf, found)
    relations, _ = G.resolve_relations(links, ents, ["doc_id", "ord"], composed=True)
    keys = [G.shown(c).alias(c) for c in ("key", "source_key", "target_key")]
    return relations.select(*keys, "type", "weight")


@query(
    "validate_extractions",
    f"WITH {_NAMES} SELECT 'entity' AS kind, type, count(*) AS kept, 0.0::DOUBLE AS strength FROM er "
    "WHERE length(name) >= 2 GROUP BY 2 UNION ALL SELECT 'relation', 'NEXT_TO', count(*), "
    "sum(greatest(1, least(10, ord % 12)))::DOUBLE FROM (SELECT ord, norm, lead(norm) OVER "
    "(PARTITION BY doc_id ORDER BY ord) AS nx FROM er) WHERE nx IS NOT NULL AND nx <> norm",
)
def validate_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """G1: rows as a model would return them, checked against their chunk."""
    chunks = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")
    )
    found = cut_lineage(names(spark, sf))
    ents, rels = G.validate_extractions(
        entity_rows(spark, sf, found), relation_rows(spark, sf, found), chunks
    )
    count = F.count(F.lit(1)).alias("kept")
    a = ents.groupBy("type").agg(count, F.lit(0.0).alias("strength"))
    b = rels.groupBy("type").agg(count, F.sum("strength").alias("strength"))
    return a.select(F.lit("entity").alias("kind"), "*").unionByName(
        b.select(F.lit("relation").alias("kind"), "*")
    )


@query(
    "merge_extraction_rounds",
    f"WITH {_NAMES} SELECT doc_id AS chunk_id, count(*) AS entities FROM (SELECT DISTINCT doc_id, "
    "norm, type FROM er) GROUP BY 1",
)
def merge_extraction_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """The second round repeats every name with other blanks and adds nothing."""
    one = cut_lineage(entity_rows(spark, sf)).withColumn("round", F.lit(1))
    two = one.withColumns({"name": F.concat(F.lit(" "), "name", F.lit("\t")), "round": F.lit(2)})
    rel = relation_rows(spark, sf).withColumn("round", F.lit(1))
    ents, _ = G.merge_extraction_rounds(one.unionByName(two), rel)
    return ents.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("entities"))


@query(
    "pending_extractions",
    r"WITH l AS (SELECT doc_id, unnest(ls) AS content, generate_subscripts(ls, 1) - 1 AS seq FROM "
    r"(SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents)), "
    "c AS (SELECT DISTINCT sha256(line) AS h FROM "
    " (SELECT unnest(string_split(text, chr(10))) AS line FROM documents WHERE lang = 'fr')), "
    "m AS (SELECT doc_id, seq FROM l WHERE sha256(content) NOT IN (SELECT h FROM c)), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM m) "
    "SELECT doc_id, 2 * count(*) FILTER (WHERE 2 * n <= 40) AS calls, "
    "max(seq) FILTER (WHERE 2 * n <= 40)::INT AS last_seq, "
    "count(*) FILTER (WHERE 2 * n > 40) AS deferred FROM r GROUP BY 1",
)
def pending_extractions(spark: SparkSession, sf: str) -> DataFrame:
    """Lines as chunks, one gleaning each; French lines were extracted before."""
    docs = src.table(spark, sf, "documents").select("doc_id", "lang", "text")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n", -1)).alias("seq", "content"))
    chunks = lines.withColumn("chunk_id", F.concat_ws("-", "doc_id", "seq"))
    cache = lines.where("lang = 'fr'").select(
        F.sha2("content", 256).alias("chunk_hash"), F.lit("m").alias("model"),
        F.lit("1").alias("prompt_version"),
    ).distinct()
    _, now, later = G.pending_extractions(chunks, cache, "m", "1", budget=40, gleanings=1)
    both = now.select("doc_id", "seq", F.lit(0).alias("later")).union(
        later.select("doc_id", F.lit(None).cast("int"), F.lit(1))
    )
    return both.groupBy("doc_id").agg(
        (2 * F.sum(1 - F.col("later"))).alias("calls"), F.max("seq").alias("last_seq"),
        F.sum("later").alias("deferred"),
    )


_TOTALS = (
    "SELECT 'entities' AS part, count(*) AS rows, 0.0::DOUBLE AS weight FROM {e} UNION ALL "
    "SELECT 'mentions', count(*), 0 FROM {m} UNION ALL "
    "SELECT 'relations', count(*), sum(weight) FROM {r}"
)


def _totals(g: G.Graph) -> DataFrame:
    n = F.count(F.lit(1)).alias("rows")
    zero = F.lit(0.0).alias("weight")
    parts = [
        g.entities.agg(n, zero).select(F.lit("entities").alias("part"), "*"),
        g.mentions.agg(n, zero).select(F.lit("mentions").alias("part"), "*"),
        g.relations.agg(n, F.sum("weight").alias("weight")).select(
            F.lit("relations").alias("part"), "*"
        ),
    ]
    # one after the other, so that the shuffle files of the first are gone before the relations'
    return written(parts[0].unionByName(parts[1]), "totals").unionByName(parts[2])


def _restricted_sql(keep: str) -> str:
    return (
        f"WITH {_ENT}, {_REL}, kd AS (SELECT doc_id FROM documents WHERE {keep}), "
        "m2 AS (SELECT DISTINCT key, doc_id FROM ek WHERE doc_id IN (SELECT doc_id FROM kd)), "
        "e2 AS (SELECT DISTINCT key FROM m2), r2 AS (SELECT key, count(*)::DOUBLE AS weight FROM rm "
        "WHERE doc_id IN (SELECT doc_id FROM kd) GROUP BY 1) "
        + _TOTALS.format(e="e2", m="m2", r="r2")
    )


@query("remove_documents", _restricted_sql("lang <> 'de'"))
def remove_documents(spark: SparkSession, sf: str) -> DataFrame:
    """All German documents leave the graph."""
    gone = src.table(spark, sf, "documents").where("lang = 'de'").select("doc_id")
    return _totals(G.remove_documents(graph(spark, sf, describe=False), gone))


@query("reconcile_graph", _restricted_sql("doc_id IN (SELECT doc_id FROM labels)"))
def reconcile_graph(spark: SparkSession, sf: str) -> DataFrame:
    """Only labelled documents are live."""
    live = src.table(spark, sf, "labels").select("doc_id")
    return _totals(G.reconcile_graph(graph(spark, sf, describe=False), live))


@query(
    "merge_graph",
    f"WITH {_ENT}, {_REL}, m2 AS (SELECT DISTINCT key, doc_id FROM ek) "
    + _TOTALS.format(e="ent", m="m2", r="rel"),
)
def merge_graph(spark: SparkSession, sf: str) -> DataFrame:
    """The graphs of English and of other documents, merged, equal the graph of all."""
    whole = graph(spark, sf, describe=False)
    english = src.table(spark, sf, "documents").where("lang = 'en'").select("doc_id")
    return _totals(
        G.merge_graph(
            G.reconcile_graph(whole, english), G.remove_documents(whole, english)
        )
    )


_SEEDS = (
    "qs AS (SELECT item_id AS query_id, " + _norm("text") + " AS q FROM benchmark), "
    "qw AS (SELECT query_id, q, list_distinct(" + S.words("q") + ") AS ws FROM qs), "
    "en AS MATERIALIZED (SELECT key, name, " + _norm("name") + " AS n FROM ent), "
    "lk AS (SELECT query_id, key, name, len(list_intersect(ws, list_distinct(" + S.words("n")
    + "))) AS matched FROM qw, en WHERE contains(q, n) AND (len(string_split(n, ' ')) >= 2 OR "
    "length(n) >= 6)), sd AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id "
    "ORDER BY matched DESC, name, key) AS rank FROM lk WHERE matched > 0) WHERE rank <= 20)"
)


def seeds(spark: SparkSession, sf: str, g: G.Graph) -> DataFrame:
    return G.link_entities(search.text_queries(spark, sf), g.entities, composed=True)


@query(
    "link_entities",
    f"WITH {_ENT}, {_SEEDS} SELECT query_id, key, name, matched, rank::INT AS rank FROM sd",
)
def link_entities(spark: SparkSession, sf: str) -> DataFrame:
    rows = cut_lineage(entity_rows(spark, sf))
    entities, _ = G.resolve_entities(rows, ["doc_id", "ord"], composed=True)
    return G.link_entities(search.text_queries(spark, sf), entities, composed=True).select(
        "query_id", G.shown("key").alias("key"), "name", "matched", "rank"
    )


_PATHS = (
    f"{_ENT}, {_REL}, {_SEEDS}, bt AS (SELECT key AS edge, weight, s AS a, t AS b FROM rel UNION ALL "
    "SELECT key, weight, t, s FROM rel), dg AS MATERIALIZED (SELECT a FROM bt GROUP BY a HAVING count(*) <= 200), "
    "ed AS MATERIALIZED (SELECT * FROM bt WHERE a IN (SELECT a FROM dg) AND b IN (SELECT a FROM dg)), "
    "p1 AS (SELECT query_id, b AS nd, [edge] AS es, weight AS score FROM sd JOIN ed ON a = key), "
    "p2 AS (SELECT query_id, b AS nd, [es[1], edge] AS es, score + weight AS score FROM p1 JOIN ed "
    "ON a = nd WHERE edge <> es[1]), "
    "pa AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, "
    "array_to_string(es, ','), nd) AS rank FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2)) "
    "WHERE rank <= 10)"
)


@query(
    "khop_paths",
    f"WITH {_PATHS} SELECT query_id, rank::INT AS rank, score, array_to_string(es, ',') AS edges FROM pa",
)
def khop_paths(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf, describe=False)
    paths = G.khop_paths(seeds(spark, sf, g), g.relations)
    edges = F.array_join(F.transform("edges", G.shown), ",")
    return paths.select("query_id", "rank", "score", edges.alias("edges"))


_GRAPH_HITS = (
    f"{_PATHS}, pc AS (SELECT query_id, doc_id AS chunk_id, max(score) AS raw FROM "
    "(SELECT query_id, score, unnest(es) AS key FROM pa) u JOIN rm USING (key) GROUP BY 1, 2), "
    "mb AS (SELECT query_id, chunk_id FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION "
    "BY query_id ORDER BY chunk_id) AS n FROM (SELECT DISTINCT query_id, doc_id AS chunk_id FROM sd "
    "JOIN ek USING (key))) WHERE n <= 200), sx AS (SELECT * FROM pc UNION ALL SELECT query_id, "
    "chunk_id, 0.5 FROM mb WHERE (query_id, chunk_id) NOT IN (SELECT (query_id, chunk_id) FROM pc)), "
    "gs AS (SELECT query_id, chunk_id, "
    + S.js_round("raw / greatest(max(raw) OVER (PARTITION BY query_id), 1.0) * 0.9::DOUBLE + 0.1::DOUBLE")
    + " AS score FROM sx), gt AS (SELECT g.*, row_number() OVER (PARTITION BY query_id ORDER BY "
    "score DESC, chunk_id)::INT AS rank FROM gs g JOIN documents d ON d.doc_id = chunk_id "
    "WHERE d.lang = 'en' AND d.n_chars % 9 <> 0)"
)


@query(
    "graph_topk",
    f"WITH {_GRAPH_HITS} SELECT query_id, chunk_id, score, rank FROM gt WHERE rank <= 20",
)
def graph_topk(spark: SparkSession, sf: str) -> DataFrame:
    """G9-G12 end to end on English documents."""
    return graph_hits(spark, sf).select("query_id", "chunk_id", "score", "rank")


def graph_hits(spark: SparkSession, sf: str) -> DataFrame:
    g = graph(spark, sf, describe=False)
    linked = cut_lineage(seeds(spark, sf, g))
    paths = G.khop_paths(linked, g.relations)
    scored = cut_lineage(G.path_chunks(paths, g.relation_mentions))
    scored = G.mention_baseline(linked, g.mentions, scored)
    docs = src.table(spark, sf, "documents").select(
        F.col("doc_id").alias("chunk_id"), "doc_id", "source", "lang",
        F.when(F.col("n_chars") % 9 == 0, "FAILED").otherwise("COMPLETED").alias("status"),
    )
    return G.graph_topk(scored, docs, metadata={"lang": "en"})


@query("retrieve_hybrid")
def retrieve_hybrid(spark: SparkSession, sf: str) -> DataFrame:
    """Vector, keyword and graph search fused; vectors come from the test provider."""
    from attestry.functions.vectors import hash_embedding

    docs, asked = search.document_chunks(spark, sf), search.text_queries(spark, sf)
    runs = {
        "vector": lambda: retrieval.vector_topk(
            asked.select("query_id", hash_embedding("query", 64).alias("qv")),
            docs.select("chunk_id", hash_embedding("content", 64).alias("embedding")),
        ),
        "keyword": lambda: search.keyword_hits(spark, sf),
        "graph": lambda: graph_hits(spark, sf),
    }
    return retrieval.retrieve(runs, "hybrid", 20).select(
        "query_id", "chunk_id", "rank", "score", "source"
    )


@query(
    "graph_summary",
    f"WITH {_ENT}, {_REL}, e AS (SELECT doc_id, count(DISTINCT key) AS entities FROM ek GROUP BY 1), "
    "r AS (SELECT doc_id, count(DISTINCT key) AS relations FROM rm GROUP BY 1), "
    "x AS (SELECT DISTINCT doc_id, key FROM ek), t AS (SELECT doc_id, name, type, row_number() OVER "
    "(PARTITION BY doc_id ORDER BY name, key) AS rank FROM x JOIN ent USING (key)), "
    "b AS (SELECT doc_id, string_agg(name || '|' || type || '|1', ';' ORDER BY rank) AS top_entities FROM t "
    "WHERE rank <= 10 GROUP BY 1) SELECT doc_id, entities, coalesce(relations, 0) AS relations, "
    "coalesce(top_entities, '') AS top_entities FROM e LEFT JOIN r USING (doc_id) LEFT JOIN b USING (doc_id)",
)
def graph_summary(spark: SparkSession, sf: str) -> DataFrame:
    """A document's counts and its ten most mentioned entities as name|type|mentions, best first."""
    counts, best = G.graph_summary(graph(spark, sf, describe=False))
    said = F.struct("rank", F.concat_ws("|", "name", "type", "mentions").alias("e"))
    lists = best.groupBy("doc_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(said)), lambda r: r["e"]), ";").alias("top_entities")
    )
    return counts.join(lists, "doc_id", "left").fillna("", ["top_entities"])


@query(
    "graph_top_entities",
    f"WITH {_ENT}, x AS (SELECT DISTINCT doc_id, key FROM ek), t AS (SELECT doc_id, name, type, "
    "row_number() OVER (PARTITION BY doc_id ORDER BY name, key)::INT AS rank FROM x JOIN ent "
    "USING (key)) SELECT doc_id, rank, name, type, 1::BIGINT AS mentions FROM t WHERE rank <= 10",
)
def graph_top_entities(spark: SparkSession, sf: str) -> DataFrame:
    """One chunk per document, so names decide among equal mention counts."""
    return G.top_entities(graph(spark, sf, describe=False))


@query(
    "graph_run_metrics",
    f"WITH {_ENT}, {_REL}, e AS (SELECT doc_id, count(DISTINCT key) AS entities FROM ek GROUP BY 1), "
    "r AS (SELECT doc_id, count(DISTINCT key) AS relations FROM rm GROUP BY 1), "
    "l AS (SELECT doc_id, 1::BIGINT AS chunks, (lang = 'fr')::BIGINT AS cache_hits, n_chars AS "
    "input_tokens, floor(n_chars / 4)::BIGINT AS output_tokens, "
    + S.js_round("n_chars * 1e-6::DOUBLE", 6)
    + " AS cost FROM documents) SELECT l.*, coalesce(entities, 0) AS entities, "
    "coalesce(relations, 0) AS relations FROM l LEFT JOIN e USING (doc_id) LEFT JOIN r USING (doc_id)",
)
def graph_run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    log = src.table(spark, sf, "documents").select(
        "doc_id", F.col("doc_id").alias("chunk_id"), (F.col("lang") == "fr").alias("from_cache"),
        F.col("n_chars").alias("input_tokens"),
        F.floor(F.col("n_chars") / 4).alias("output_tokens"),
        (F.col("n_chars") * 1e-6).alias("cost"),
    )
    return G.graph_run_metrics(graph(spark, sf, describe=False), log)


@query(
    "relation_citations",
    f"WITH {_ENT}, {_REL}, cl AS (SELECT a.doc_id, a.name AS n0, b.name AS n1 FROM er a JOIN er b "
    "ON a.doc_id = b.doc_id AND a.ord = 0 AND b.ord = 1), "
    "ends AS (SELECT doc_id, e.key, e.name FROM (SELECT doc_id, unnest([lower(n0), lower(n1)]) AS ln FROM cl) "
    "JOIN ent e ON lower(e.name) = ln), "
    "pr AS (SELECT a.doc_id, a.name AS na, b.name AS nb, r.key AS rel FROM ends a JOIN ends b ON a.doc_id = b.doc_id "
    "AND a.name < b.name JOIN rel r ON r.s = least(a.key, b.key) AND r.t = greatest(a.key, b.key)), "
    "fr AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY na, nb, rel) AS k FROM pr QUALIFY k <= 5), "
    "pf AS (SELECT fr.doc_id, na, nb, rm.doc_id::VARCHAR AS chunk, (k, NOT (rm.doc_id = fr.doc_id AND fr.doc_id % 2 = 0), "
    "rm.doc_id::VARCHAR) AS place FROM fr JOIN rm ON rm.key = fr.rel) "
    "SELECT doc_id::VARCHAR AS answer_id, arg_min(chunk, place) AS chunk_id, arg_min(na, place) AS source_entity, "
    "arg_min(nb, place) AS target_entity FROM pf GROUP BY doc_id",
)
def relation_citations(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's first two names as a claim; even documents are their claim's own context."""
    found = written(names(spark, sf), "names")
    g = graph(spark, sf, describe=False, found=found)
    made = found.where("size(names) >= 2").select(
        F.col("doc_id").cast("string").alias("answer_id"), F.lit("c1").alias("claim_id"),
        F.concat(F.get("names", F.lit(0)), F.lit(" and "), F.get("names", F.lit(1))).alias("claim_text"),
    )
    context = made.where("answer_id % 2 = 0").select(
        "answer_id", F.col("answer_id").alias("chunk_id"), F.col("answer_id").alias("doc_id")
    )
    proofs = g.relation_mentions.select(
        "key", F.col("chunk_id").cast("string").alias("chunk_id"),
        F.col("doc_id").cast("string").alias("doc_id"),
    )
    g = G.Graph(g.entities, g.mentions, g.relations, proofs)
    return G.relation_citation(made, g, context).select(
        "answer_id", "chunk_id", "source_entity", "target_entity"
    )
