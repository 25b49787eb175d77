"""Knowledge-graph tables.

A graph is four tables. An entity mentioned in a third of all chunks would need an endless id list,
so chunk and document ids are kept as rows (``mentions``, ``relation_mentions``), not arrays.

Resolved keys are SHA-256 hashes as 32 bytes (``shown`` gives their hex form, in the same order). Rows are stored and
moved under the short texts that are hashed; keys are made where they are read.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import text as T
from attestry.operators.retrieval import apply_filters, of_keys, top_k
from attestry.session import cut_lineage, rank_within, salted_join, written

log = logging.getLogger(__name__)


@dataclass
class Graph:
    entities: DataFrame  # key, name, type, description
    mentions: DataFrame  # key, chunk_id, doc_id
    relations: DataFrame  # key, source_key, target_key, type, description, weight
    relation_mentions: DataFrame  # key, chunk_id, doc_id


# --- G1-G3: extraction rows -----------------------------------------------------------------------
def validate_extractions(
    entities: DataFrame, relations: DataFrame, chunks: DataFrame, types: list[str] | None = None
) -> tuple[DataFrame, DataFrame]:
    """G1: entities whose name occurs in the chunk; relations between two kept names.

    ``entities``: chunk_id, name, type, description; ``relations``: chunk_id, source, target, type,
    description, strength; ``chunks``: chunk_id, content.
    """
    allowed = fixed.ENTITY_TYPES if types is None else types
    entities = T.composed(entities, "name", "type")
    relations = T.composed(relations, "source", "target", "type")
    chunks = T.composed(chunks.select("chunk_id", "content"), "content")
    trimmed = entities.select(
        *[c for c in entities.columns if c not in ("name", "type", "description")],
        T.js_trim(F.col("name")).alias("name"),
        F.upper(T.js_trim(F.col("type"))).alias("type"),
        T.js_trim(F.coalesce("description", F.lit(""))).alias("description"),
        T.name_norm("name").alias("norm"),
    ).where(F.length("name") >= 2)
    hay = chunks.select("chunk_id", T.name_norm("content").alias("_hay"))
    kept = trimmed.join(hay, "chunk_id").where(F.contains("_hay", F.col("norm"))).drop("_hay")
    kept = kept.withColumn(
        "type", F.when(F.col("type").isin(allowed), F.col("type")).otherwise("CONCEPT")
    )
    names = kept.select("chunk_id", "norm").distinct()
    strength = F.col("strength").cast("double")
    bad = strength.isNull() | F.isnan(strength) | (F.abs(strength) == float("inf"))
    snake = T.replace(F.upper(T.js_trim(F.col("type"))), rf"[{T.WS}]+", "_")
    links = relations.select(
        *[c for c in relations.columns
          if c not in ("source", "target", "type", "description", "strength")],
        T.js_trim(F.col("source")).alias("source"),
        T.js_trim(F.col("target")).alias("target"),
        F.when(snake == "", "RELATED_TO").otherwise(snake).alias("type"),
        T.js_trim(F.coalesce("description", F.lit(""))).alias("description"),
        F.when(bad, F.lit(5.0)).otherwise(
            F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.floor(strength + 0.5).cast("double")))
        ).alias("strength"),
        T.name_norm("source").alias("_s"),
        T.name_norm("target").alias("_t"),
    ).where("_s <> _t")
    links = links.join(names.withColumnRenamed("norm", "_s"), ["chunk_id", "_s"], "left_semi")
    links = links.join(names.withColumnRenamed("norm", "_t"), ["chunk_id", "_t"], "left_semi")
    return kept.drop("norm"), links.drop("_s", "_t")


def merge_extraction_rounds(
    entities: DataFrame, relations: DataFrame, order: str = "round"
) -> tuple[DataFrame, DataFrame]:
    """First row per (chunk, name, type); relations first per undirected pair and type."""

    def first(df: DataFrame, keys: list[Column]) -> DataFrame:
        keyed = df.select("*", *[k.alias(f"_k{i}") for i, k in enumerate(keys)])
        rest = [c for c in df.columns if c != "chunk_id"]
        picked = keyed.groupBy("chunk_id", *[f"_k{i}" for i in range(len(keys))]).agg(
            F.min_by(F.struct(*rest), order).alias("_r")
        )
        return picked.select("chunk_id", "_r.*")

    norm = T.name_norm
    entities = T.composed(entities, "name", "type")
    relations = T.composed(relations, "source", "target", "type")
    pair = F.array_join(F.sort_array(F.array(norm("source"), norm("target"))), "\u0001")
    return first(entities, [norm("name"), norm("type")]), first(relations, [pair, norm("type")])


def pending_extractions(
    chunks: DataFrame, cache: DataFrame, model: str, version: str, budget: int | None = None,
    gleanings: int = 0,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cache hits, chunks to extract now, chunks deferred to a later run).

    A document may make ``budget`` calls a run, in chunk order; a chunk takes one call and one for
    each gleaning. What doesn't fit whole is deferred; without a budget nothing is.
    """
    keyed = chunks.withColumn("chunk_hash", F.sha2("content", 256))
    done = cache.where((F.col("model") == model) & (F.col("prompt_version") == version))
    hits = keyed.join(done.drop("model", "prompt_version"), "chunk_hash")
    missing = keyed.join(done.select("chunk_hash"), "chunk_hash", "left_anti")
    numbered = rank_within(missing, ["doc_id"], ["seq", "chunk_id"], "call_no")
    fits = F.lit(True) if budget is None else F.col("call_no") * (1 + gleanings) <= budget
    return hits, numbered.where(fits), numbered.where(~fits)


# --- G4, G5: resolution ----------------------------------------------------------------------------
def shown(key: Column | str) -> Column:
    """The hex form of a key."""
    return F.lower(F.hex(key))


def _hashed(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _joined_descriptions(rows: DataFrame, order: list[str]) -> DataFrame:
    """Distinct descriptions in first-seen order, joined by "; " while they fit.

    Every part takes three characters or more, so only the first few hundred can matter; the
    top-k cut runs before the shuffle and loses nothing.
    """
    limit = fixed.MAX_DESCRIPTION
    parts = rows.where("description <> ''").groupBy("key", "description").agg(
        F.min(F.struct(*order)).alias("_seen")
    )
    first = top_k(parts, ["key"], [F.col("_seen"), F.col("description")], limit // 3 + 2, "_n")
    size = F.sum(F.length("description") + 2).over(
        W.partitionBy("key").orderBy("_n").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    kept = first.select("key", "_n", "description", (size - 2).alias("_size")).where(
        F.col("_size") <= limit
    )
    texts = F.sort_array(F.collect_list(F.struct("_n", "description")))
    return kept.groupBy("key").agg(
        F.array_join(F.transform(texts, lambda s: s["description"]), "; ").alias("description")
    )


def _described(first: DataFrame, keyed: DataFrame, order: list[str], describe: bool) -> DataFrame:
    """``first`` (one row per key) with ``description``, empty where there is none."""
    if not describe:
        return first.withColumn("description", F.lit(""))
    texts = _joined_descriptions(
        keyed.withColumn("description", T.js_trim(F.coalesce("description", F.lit("")))), order
    )
    return first.join(texts, "key", "left").fillna("", ["description"])


def _named_entities(rows: DataFrame, order: list[str], describe: bool = True, composed: bool = False) -> DataFrame:
    """Extraction rows with the norm of their name and ``ident``, the text whose hash is their key.

    They are made once for all that reads them.
    """
    wanted = ("chunk_id", "doc_id", *order, "name", "type", *(["description"] if describe else []))
    kept = [c for c in dict.fromkeys(wanted) if c in rows.columns]
    named = rows.select(*kept) if composed else T.composed(rows.select(*kept), "name", "type")
    named = named.withColumn("norm", T.name_norm("name"))
    return written(named.withColumn("ident", F.concat_ws("|", "norm", T.name_norm("type"))), "entity_rows")


def _mentions(named: DataFrame, key: Column, *ident: str) -> DataFrame:
    """Distinct mentions, dealt by document, so that what counts per document moves no row again."""
    own = named.select(*ident, "chunk_id", "doc_id").repartition("doc_id").distinct()
    return own.select(key.alias("key"), "chunk_id", "doc_id")


def resolve_entities(
    rows: DataFrame, order: list[str], describe: bool = True, composed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(entities, mentions) from extraction rows; ``order`` columns fix what was seen first.

    Searches don't read descriptions; ``describe=False`` leaves them empty and saves their joins.
    ``composed`` says that names and types are in NFC already, as parts of a composed text are.
    """
    return _entities(_named_entities(rows, order, describe, composed), order, describe)


def _entities(named: DataFrame, order: list[str], describe: bool) -> tuple[DataFrame, DataFrame]:
    key = _hashed(F.col("ident"))
    first = named.groupBy("ident").agg(
        F.min_by(F.struct("name", "type"), F.struct(*order)).alias("_f")
    ).select(key.alias("key"), "_f")
    entities = _described(first, named.withColumn("key", key), order, describe).select(
        "key", T.js_trim(F.col("_f.name")).alias("name"),
        F.upper(T.js_trim(F.col("_f.type"))).alias("type"), "description",
    )
    return entities, _mentions(named, key, "ident")


def resolve_relations(
    rows: DataFrame, entity_rows: DataFrame, order: list[str], describe: bool = True, composed: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(relations, relation mentions). Endpoint names are looked up inside their chunk."""
    return _relations(rows, _named_entities(entity_rows, order, False, composed), order, describe, composed)


def _relations(
    rows: DataFrame, entities: DataFrame, order: list[str], describe: bool, composed: bool
) -> tuple[DataFrame, DataFrame]:
    local = entities.select("chunk_id", "norm", F.struct(*order).alias("_o"), "ident").repartition(
        "chunk_id", "norm"
    ).groupBy("chunk_id", "norm").agg(F.max_by("ident", "_o").alias("i"))
    # both sides are as long as the names' lists together; small files don't tell that
    local = local.hint("merge")
    carried = list(dict.fromkeys(["chunk_id", "doc_id", *order, "type", *(["description"] if describe else [])]))
    ends = rows.select(*carried, "source", "target")
    ends = (ends if composed else T.composed(ends, "source", "target", "type")).select(
        *carried, T.name_norm("type").alias("kind"), T.name_norm("source").alias("_sn"), T.name_norm("target").alias("_tn")
    )
    ends = ends.join(
        local.select("chunk_id", F.col("norm").alias("_sn"), F.col("i").alias("_s")),
        ["chunk_id", "_sn"],
    ).join(
        local.select("chunk_id", F.col("norm").alias("_tn"), F.col("i").alias("_t")),
        ["chunk_id", "_tn"],
    ).where("_s <> _t")
    both = [F.struct(F.sha2(c, 256).alias("k"), F.col(c).alias("i")) for c in ("_s", "_t")]
    ends = ends.withColumns({"_a": F.least(*both), "_b": F.greatest(*both)}).select(
        *carried, "kind", F.col("_a.i").alias("_s"), F.col("_b.i").alias("_t")
    )
    ends = written(ends, "relation_rows")
    source, target = _hashed(F.col("_s")), _hashed(F.col("_t"))
    key = _hashed(F.concat_ws("|", F.sha2("_s", 256), F.sha2("_t", 256), "kind"))
    per_chunk = ends.groupBy("_s", "_t", "kind", "chunk_id").agg(F.min(F.struct(*order, "type")).alias("_f"))
    first = per_chunk.groupBy("_s", "_t", "kind").agg(
        F.min("_f").alias("_f"), F.count(F.lit(1)).cast("double").alias("weight")
    )
    snake = T.replace(F.upper(T.js_trim(F.col("_f.type"))), rf"[{T.WS}]+", "_")
    first = written(first.select("_s", "_t", "kind", snake.alias("type"), "weight"), "relations")
    first = first.select(key.alias("key"), source.alias("source_key"), target.alias("target_key"), "type", "weight")
    relations = _described(first, ends.withColumn("key", key), order, describe).select(
        "key", "source_key", "target_key", "type", "description", "weight",
    )
    return relations, _mentions(ends, key, "_s", "_t", "kind")


def resolve_graph(
    rows: DataFrame, relations: DataFrame, order: list[str], describe: bool = True, composed: bool = False
) -> Graph:
    """G4 and G5 together: the names' texts are made once and serve both."""
    named = _named_entities(rows, order, describe, composed)
    entities, mentions = _entities(named, order, describe)
    links, proofs = _relations(relations, named, order, describe, composed)
    return Graph(written(entities, "entities"), mentions, written(links, "links") if describe else links, proofs)


def _weights(relation_mentions: DataFrame) -> DataFrame:
    per_chunk = relation_mentions.select("key", "chunk_id").distinct()
    return per_chunk.groupBy("key").agg(F.count(F.lit(1)).cast("double").alias("weight"))


# --- G6-G8: maintenance -------------------------------------------------------------------------------
def merge_graph(old: Graph, new: Graph) -> Graph:
    """Union of ids; known names and types win; the longer description is kept."""

    def merged(a: DataFrame, b: DataFrame, columns: list[str]) -> DataFrame:
        named = b.select("key", *[F.col(c).alias(f"_{c}") for c in columns])
        text = F.coalesce("description", F.lit(""))
        longer = F.when(
            F.col("_description").isNull() | (F.length(text) >= F.length("_description")), text
        ).otherwise(F.col("_description"))
        return a.join(named, "key", "full_outer").select(
            "key",
            *[F.coalesce(c, f"_{c}").alias(c) for c in columns if c != "description"],
            longer.alias("description"),
        )

    mentions = old.mentions.unionByName(new.mentions).distinct()
    relation_mentions = old.relation_mentions.unionByName(new.relation_mentions).distinct()
    relations = merged(
        old.relations, new.relations, ["source_key", "target_key", "type", "description"]
    ).join(_weights(relation_mentions), "key")
    entities = merged(old.entities, new.entities, ["name", "type", "description"])
    return Graph(entities, mentions, relations, relation_mentions)


def _restricted(graph: Graph, ids: DataFrame, keep: bool) -> Graph:
    """The graph of the documents ``ids``, or of all others; mentions without a document are among these."""
    documents = ids.select("doc_id").distinct()

    def of(mentions: DataFrame) -> DataFrame:
        known = mentions.where("doc_id is not null")
        if keep:
            return known.join(documents, "doc_id", "left_semi").select("key", "chunk_id", "doc_id")
        # the same rows meet the documents in both cases, so that graphs made of both move them once
        others = known.join(documents, "doc_id", "left_anti").select("key", "chunk_id", "doc_id")
        return others.union(mentions.where("doc_id is null").select("key", "chunk_id", "doc_id"))

    mentions, rel = of(graph.mentions), of(graph.relation_mentions)
    relations = graph.relations.drop("weight").join(_weights(rel), "key")
    entities = graph.entities.join(mentions.select("key").distinct(), "key", "left_semi")
    return Graph(entities, mentions, relations, rel)


def remove_documents(graph: Graph, ids: DataFrame) -> Graph:
    """Strip the documents; relations without chunks and orphaned entities disappear."""
    return _restricted(graph, ids, False)


def reconcile_graph(graph: Graph, live: DataFrame) -> Graph:
    """Keep only what live documents support."""
    return _restricted(graph, live, True)


# --- G9-G12: graph retrieval -----------------------------------------------------------------------------
def link_entities(
    queries: DataFrame, entities: DataFrame, most: int = 20, query: str = "query", composed: bool = False
) -> DataFrame:
    """Entities whose name occurs in the query; at most ``most`` seeds, best match first.

    Candidates share a word with the query: words meet by equi-join, the entity side salted. Entities
    without such a word are left out before any of them moves. ``composed`` says that names are in NFC already.
    """
    asked = T.composed(queries.select("query_id", query), query)
    asked = asked.select("query_id", T.name_norm(query).alias("q"))
    entities = entities.select("key", "name")
    entities = entities if composed else T.composed(entities, "name")
    words = asked.select("query_id", "q", F.explode(F.array_distinct(T.words(F.col("q")))).alias("w"))
    named = entities.select("key", "name", T.name_norm("name").alias("n"))
    long_enough = (F.size(F.split("n", " ")) >= 2) | (F.length("n") >= 6)
    posts = named.where(long_enough).select(
        "key", "name", "n", F.explode(F.array_distinct(T.words(F.col("n")))).alias("w")
    )
    found = salted_join(of_keys(posts, words, "w"), words, ["w"], ["key"]).where(F.contains("q", F.col("n")))
    scored = found.groupBy("query_id", "key", "name").agg(F.count(F.lit(1)).alias("matched"))
    return top_k(scored, ["query_id"], [F.desc("matched"), F.col("name"), F.col("key")], most)


def _edges(relations: DataFrame, max_degree: int, starts: DataFrame | None = None, steps: int = 0) -> DataFrame:
    """Both directions of every relation between nodes within the degree cap.

    With ``starts`` (a column ``a``) only edges that leave nodes up to ``steps`` steps away from one of them.
    """
    both = relations.select(
        F.col("key").alias("edge"), "weight",
        F.explode(
            F.array(
                F.struct(F.col("source_key").alias("a"), F.col("target_key").alias("b")),
                F.struct(F.col("target_key").alias("a"), F.col("source_key").alias("b")),
            )
        ).alias("e"),
    ).select("edge", "weight", "e.a", "e.b")
    crowded = both.groupBy("a").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > max_degree)
    if starts is not None:
        crowded = cut_lineage(crowded)
    busy = crowded.select("a")
    if starts is None:
        kept = salted_join(both, busy, ["a"], ["edge"], how="left_anti", sizes=crowded)
    else:
        near = starts.select("a").distinct().join(busy, "a", "left_anti")
        for _ in range(steps):
            onward = of_keys(both, near, "a").select(F.col("b").alias("a"))
            near = near.union(onward).distinct().join(busy, "a", "left_anti")
        kept = of_keys(both, near, "a")
    ends = [c.withColumnRenamed("a", "b") for c in (busy, crowded)]
    return salted_join(kept, ends[0], ["b"], ["edge"], how="left_anti", sizes=ends[1])


def adjacency(relations: DataFrame, hops: int, max_degree: int, starts: DataFrame | None = None) -> DataFrame:
    """One row per node: ``ways`` (weight, edge, b), best first, and the greatest gains of walks.

    With ``starts`` (a column ``a``) only nodes on which a path of ``hops`` edges from there can stand before
    its last edge; a gain is then exact for every node from which that many steps are left.

    The degree cap bounds ``ways``. ``gain_r`` is the greatest weight that ``r`` more steps can add,
    whatever edges were used before: an upper bound for any path that stands on the node.
    """
    edges = _edges(relations, max_degree, starts, hops - 1)
    best_first = F.array_sort(
        F.collect_list(F.struct((-F.col("weight")).alias("down"), "edge", "b", "weight"))
    )
    nodes = edges.groupBy("a").agg(best_first.alias("ways")).withColumn(
        "gain_1", F.get("ways", F.lit(0))["weight"]
    )
    nodes = cut_lineage(nodes)
    for r in range(2, hops):
        steps = nodes.select("a", F.explode("ways").alias("w")).select("a", "w.b", "w.weight")
        onward = nodes.select(F.col("a").alias("b"), f"gain_{r - 1}")
        gains = steps.join(onward, "b").groupBy("a").agg(
            F.max(F.col("weight") + F.col(f"gain_{r - 1}")).alias(f"gain_{r}")
        )
        nodes = cut_lineage(nodes.join(gains, "a"))
    return nodes


def khop_paths(
    seeds: DataFrame, relations: DataFrame, hops: int = 2, top: int = 10, max_degree: int = 200
) -> DataFrame:
    """Best undirected paths per query (``query_id, edges, score``), no edge used twice.

    Best first: a path is extended only if its score and the most that its node's remaining steps can
    add reach the query's bar, the score of the ``top``-th best path known so far. Known are
    the paths themselves and, by their node's best unused edge, one longer path each. The
    last step takes no more than ``top`` edges of a node, in their order. So what is built are the paths
    that can still enter the result, not all paths. The degree cap bounds each step; it is part of the
    operator's meaning. Row counts of the steps are logged at level INFO.
    """
    starts = cut_lineage(seeds.select("query_id", F.col("key").alias("a")).distinct())
    nodes = adjacency(relations, hops, max_degree, starts)
    text = F.col("edges") if relations.schema["key"].dataType.typeName() != "binary" else F.transform("edges", shown)
    order = [F.desc("score"), F.array_join(text, ","), F.col("at")]
    ahead = nodes.select(
        F.col("a").alias("at"), F.slice("ways", 1, hops + 1).alias("_few"),
        *[F.col(f"gain_{r}") for r in range(1, hops)],
    )

    def unused(ways: str) -> Column:
        return F.filter(ways, lambda w: ~F.array_contains("edges", w["edge"]))

    paths = starts.join(nodes.select("a", "ways"), "a").select(
        "query_id", F.explode("ways").alias("w")
    ).select(
        "query_id", F.col("w.b").alias("at"), F.array("w.edge").alias("edges"),
        F.col("w.weight").alias("score"),
    )
    known = None
    for left in range(hops - 1, -1, -1):
        if left:
            next_best = F.get(unused("_few"), F.lit(0))["weight"]
            paths = paths.join(ahead, "at", "left").select(
                "query_id", "at", "edges", "score",
                (F.col("score") + next_best).alias("_longer"),
                (F.col("score") + F.col(f"gain_{left}")).alias("_most"),
            )
        paths = cut_lineage(paths)
        log_rows("paths with %d steps left", paths, left)
        complete = paths.select("query_id", "edges", "at", "score")
        known = complete if known is None else known.unionByName(complete)
        known = top_k(known, ["query_id"], order, top, "_n").drop("_n")
        if left:
            reached = known.select("query_id", "score").unionByName(
                paths.where("_longer is not null").select("query_id", F.col("_longer").alias("score"))
            )
            bar = top_k(reached, ["query_id"], [F.desc("score")], top, "_n").where(
                F.col("_n") == top
            ).select("query_id", F.col("score").alias("_bar"))
            hopeful = paths.where("_most is not null").join(bar, "query_id", "left").where(
                "_bar is null or _most >= _bar"
            )
            log_rows("paths to extend, %d steps left", hopeful, left)
            onward = unused("ways")
            if left == 1:
                onward = F.slice(onward, 1, top)
                onward = F.filter(
                    onward,
                    lambda w: F.col("_bar").isNull()
                    | (F.col("score") + w["weight"] >= F.col("_bar")),
                )
            paths = hopeful.join(nodes.select(F.col("a").alias("at"), "ways"), "at").select(
                "query_id", "edges", "score", F.explode(onward).alias("w")
            ).select(
                "query_id", F.col("w.b").alias("at"),
                F.array_append("edges", F.col("w.edge")).alias("edges"),
                (F.col("score") + F.col("w.weight")).alias("score"),
            )
    return top_k(known, ["query_id"], order, top)


def log_rows(what: str, df: DataFrame, *args: int) -> None:
    """Log a row count, which is taken only if it will be seen."""
    if log.isEnabledFor(logging.INFO):
        log.info(what + ": %d", *args, df.count())


def path_chunks(paths: DataFrame, relation_mentions: DataFrame) -> DataFrame:
    """Chunks behind the paths' relations with their best path score."""
    used = cut_lineage(paths.select("query_id", "score", F.explode("edges").alias("key")).groupBy(
        "query_id", "key"
    ).agg(F.max("score").alias("score")))
    own = of_keys(relation_mentions.select("key", "chunk_id"), used, "key")
    return (
        salted_join(own, used, ["key"], ["chunk_id"])
        .groupBy("query_id", "chunk_id")
        .agg(F.max("score").alias("raw"))
    )


def mention_baseline(
    seeds: DataFrame, mentions: DataFrame, scored: DataFrame, most: int = 200, score: float = 0.5
) -> DataFrame:
    """Chunks that mention a seed directly get a floor score unless a path reached them."""
    own = of_keys(mentions.select("key", "chunk_id"), seeds, "key")
    direct = salted_join(
        own, seeds.select("query_id", "key").distinct(), ["key"],
        ["chunk_id"],
    ).select("query_id", "chunk_id").distinct()
    first = top_k(direct, ["query_id"], [F.col("chunk_id")], most).drop("rank")
    new = first.join(scored, ["query_id", "chunk_id"], "left_anti")
    return scored.unionByName(new.withColumn("raw", F.lit(score)))


def graph_topk(
    scored: DataFrame, chunks: DataFrame, k: int = 20, **filters
) -> DataFrame:
    """Relative score .1 + .9 raw / max, on searchable chunks that pass the filters.

    Where ``chunks`` has the status of its documents, only those of COMPLETED ones are searchable.
    """
    if "status" in chunks.columns:
        chunks = chunks.where(F.col("status") == "COMPLETED")
    most = scored.groupBy("query_id").agg(F.greatest(F.max("raw"), F.lit(1.0)).alias("_m"))
    usable = apply_filters(chunks, **filters).select("chunk_id", "doc_id")
    rows = scored.join(most, "query_id").join(usable, "chunk_id").select(
        "query_id", "chunk_id", "doc_id",
        T.js_round(F.col("raw") / F.col("_m") * 0.9 + 0.1).alias("score"),
    )
    return top_k(rows, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


# --- G13-G15 ------------------------------------------------------------------------------------------------
def graph_counts(graph: Graph) -> DataFrame:
    """Entities and relations per document."""
    ents = graph.mentions.select("doc_id", "key").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("entities")
    )
    rels = graph.relation_mentions.select("doc_id", "key").distinct().groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("relations")
    )
    return ents.join(rels, "doc_id", "full_outer").fillna(0)


def top_entities(graph: Graph, top: int = 10) -> DataFrame:
    """Each document's most mentioned entities, by name among equals."""
    per_doc = graph.mentions.groupBy("doc_id", "key").agg(F.count(F.lit(1)).alias("mentions"))
    names = graph.entities.select("key", "name", "type")
    # the mention side may be dominated by one entity
    named = salted_join(per_doc, names, ["key"], ["doc_id"])
    best = top_k(
        named, ["doc_id"], [F.desc("mentions"), F.col("name"), F.col("key")], top
    )
    return best.select("doc_id", "rank", "name", "type", "mentions")


def graph_summary(graph: Graph, top: int = 10) -> tuple[DataFrame, DataFrame]:
    """(entity and relation counts per document, its most mentioned entities)."""
    return graph_counts(graph), top_entities(graph, top)


def relation_citation(
    claims: DataFrame, graph: Graph, context: DataFrame, lookups: int = 12, rows: int = 5
) -> DataFrame:
    """A claim naming both ends of a relation cites one of the relation's chunks.

    ``claims``: answer_id, claim_id, claim_text, still without evidence. A chunk of the answer's
    context is preferred. The first ``lookups`` claims of an answer are tried.
    """
    nouns = claims.select(
        "answer_id", "claim_id", "claim_text",
        F.transform(T.proper_nouns("claim_text"), lambda n: T.simple_lower(n)).alias("names"),
    )
    number = F.regexp_extract("claim_id", "([0-9]+)$", 1).cast("int")
    tried = top_k(nouns, ["answer_id"], [number, F.col("claim_id")], lookups, "_n").where(
        "size(names) >= 2"
    )
    named = tried.select("answer_id", "claim_id", F.explode("names").alias("lname"))
    entities = graph.entities.select("key", "name", T.simple_lower("name").alias("lname"))
    ends = named.join(entities, "lname").select("answer_id", "claim_id", "key", "name")
    a = ends.select("answer_id", "claim_id", F.col("key").alias("ka"), F.col("name").alias("na"))
    links = graph.relations.where("source_key <> target_key").select(
        F.col("key").alias("rel"), "type",
        F.least("source_key", "target_key").alias("s"), F.greatest("source_key", "target_key").alias("t"),
    )
    b = ends.select("answer_id", "claim_id", F.col("key").alias("kb"), F.col("name").alias("nb"))
    # a claim's own pairs of names first: a name's relations alone may be a share of the graph
    pairs = written(a.join(b, ["answer_id", "claim_id"]).where("na < nb and ka <> kb").select(
        "answer_id", "claim_id", "na", "nb", F.least("ka", "kb").alias("s"), F.greatest("ka", "kb").alias("t")
    ), "pairs")
    full = salted_join(pairs, links, ["s", "t"], ["answer_id", "claim_id"])
    first = written(top_k(
        full, ["answer_id", "claim_id"],
        [F.col("na"), F.col("nb"), F.col("type"), F.col("rel")], rows, "_row",
    ).select("answer_id", "claim_id", "_row", "rel", "na", "nb", "type"), "tried")
    # only mentions of relations that some claim tries are read from here on
    proofs = graph.relation_mentions.withColumnRenamed("key", "rel")
    proofs = written(of_keys(proofs, first, "rel").select("rel", "chunk_id", "doc_id"), "proofs")

    def proof(kind: str, *names: str) -> DataFrame:
        """The least mention of every relation tried, and those in the answer's own context before it."""
        mention, rows = F.struct(*names), first.select("answer_id", "claim_id", "_row", "rel", "na", "nb", "type")
        least = proofs.groupBy("rel").agg(F.min(mention).alias("m")).withColumn("away", F.lit(True))
        own = context.select("answer_id", kind).distinct()
        near = rows.join(own, "answer_id").join(proofs.select("rel", *names).distinct(), ["rel", kind])
        near = near.withColumn("m", mention).withColumn("away", F.lit(False))
        far = salted_join(rows, least, ["rel"], ["answer_id", "claim_id"])
        return far.unionByName(near.select(*far.columns))

    place = F.struct("_row", "away", "m")
    chunk = proof("chunk_id", "chunk_id", "doc_id").groupBy("answer_id", "claim_id").agg(
        F.min_by(F.struct("m.chunk_id", "na", "nb", "type"), place).alias("c")
    )
    doc = proof("doc_id", "doc_id").groupBy("answer_id", "claim_id").agg(F.min_by("m.doc_id", place).alias("doc_id"))
    best = chunk.join(doc, ["answer_id", "claim_id"])
    return best.join(claims.select("answer_id", "claim_id", "claim_text"),
                     ["answer_id", "claim_id"]).select(
        "answer_id", "claim_id", "claim_text", "doc_id", F.col("c.chunk_id").alias("chunk_id"),
        F.col("c.na").alias("source_entity"), F.col("c.nb").alias("target_entity"),
        F.col("c.type").alias("relation_type"),
    )


def graph_run_metrics(graph: Graph, extraction_log: DataFrame) -> DataFrame:
    """Per document entities, relations, chunks, cache hits, tokens and cost.

    ``extraction_log``: doc_id, chunk_id, from_cache, input_tokens, output_tokens, cost.
    """
    counts = graph_counts(graph)
    log = extraction_log.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if("from_cache").alias("cache_hits"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        T.js_round(F.sum("cost"), 6).alias("cost"),
    )
    return log.join(counts, "doc_id", "left").fillna({"entities": 0, "relations": 0})
