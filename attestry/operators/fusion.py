"""Rank fusion (R8, R9), re-ranking (R11-R13), table expansion (R10) and context packing.

All groups are one query's hits, which the retrieval limit bounds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators.retrieval import top_k

WEIGHTS = {"vector": 1.0, "keyword": 0.7, "graph": 0.8}


def fuse(
    runs: DataFrame,
    method: str = "rrf",
    rrf_k: int = 60,
    weights: dict[str, float] | None = None,
    top: int = 20,
) -> DataFrame:
    """Fuse ``query_id, chunk_id, source, score`` rows.

    One shuffle by query serves the per-source ranks, the theoretical maximum over the sources
    that returned something, and the final cut. A single source passes through unscaled.
    """
    w = F.lit(1.0)
    for name, value in (WEIGHTS if weights is None else weights).items():
        w = F.when(F.col("source") == name, F.lit(float(value))).otherwise(w)
    by_source = W.partitionBy("query_id", "source").orderBy(F.desc("score"), "chunk_id")
    ranked = runs.repartition("query_id").select(
        "query_id", "chunk_id", "source", "score",
        w.alias("_w"),
        F.row_number().over(by_source).alias("_rank"),
    )
    if method == "rrf":
        part, best = F.col("_w") / (rrf_k + F.col("_rank")), F.col("_w") / (rrf_k + 1)
    else:
        part, best = F.col("_w") * T.clamp(F.col("score")), F.col("_w")
    by_query = W.partitionBy("query_id")
    first = F.col("_rank") == 1
    parts = ranked.select(
        "query_id", "chunk_id", "source", "score",
        part.alias("_part"),
        F.sum(F.when(first, best)).over(by_query).alias("_max"),
        F.count_if(first).over(by_query).alias("_sources"),
    )
    fused = parts.groupBy("query_id", "chunk_id").agg(
        F.sum("_part").alias("_sum"),
        F.first("_max").alias("_max"),
        F.first("_sources").alias("_n"),
        F.max("score").alias("_score"),
        F.sort_array(F.collect_set("source")).alias("sources"),
    )
    alone = F.col("_n") == 1
    scaled = T.clamp(T.js_round(F.col("_sum") / F.col("_max"), 4))
    order = F.when(alone, F.col("_score")).otherwise(F.round("_sum", 12))
    fused = fused.select(
        "query_id", "chunk_id", "sources",
        F.when(F.size("sources") > 1, "hybrid").otherwise(F.get("sources", F.lit(0)))
        .alias("source"),
        F.when(alone, F.col("_score")).otherwise(scaled).alias("score"),
        order.alias("_order"),
    )
    return top_k(fused, ["query_id"], [F.desc("_order"), F.col("chunk_id")], top).drop("_order")


# --- R10 ------------------------------------------------------------------------------------------
def expand_tables(hits: DataFrame, chunks: DataFrame, most: int = 8) -> DataFrame:
    """Add the missing pieces of every split table that was hit, ``most`` per query.

    ``hits`` has query_id, chunk_id, doc_id, table_group, score, source, rank; ``chunks`` has
    chunk_id, doc_id, table_group, seq.
    """
    tables = (
        hits.where("table_group is not null and table_group <> ''")
        .groupBy("query_id", "doc_id", "table_group")
        .agg(
            F.min("rank").alias("_first"),
            F.max_by(F.struct("score", "source"), F.struct("score", -F.col("rank"))).alias("_b"),
        )
    )
    siblings = chunks.where("table_group is not null").select(
        "doc_id", "table_group", "chunk_id", "seq"
    )
    missing = tables.join(siblings, ["doc_id", "table_group"]).join(
        hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti"
    )
    added = top_k(
        missing, ["query_id"], [F.col("_first"), F.col("seq"), F.col("chunk_id")], most, "_n"
    )
    last = hits.groupBy("query_id").agg(F.max("rank").alias("_last"))
    added = added.join(last, "query_id").select(
        "query_id", "chunk_id", "doc_id", "table_group",
        F.greatest(F.lit(0.0), F.col("_b.score") - 1e-4).alias("score"),
        F.col("_b.source").alias("source"),
        (F.col("_last") + F.col("_n")).alias("rank"),
        F.lit(True).alias("table_expanded"),
    )
    base = hits.select(
        "query_id", "chunk_id", "doc_id", "table_group", "score", "source", "rank",
        F.lit(False).alias("table_expanded"),
    )
    return base.unionByName(added)


# --- R11-R13 ------------------------------------------------------------------------------------------
def _rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    scored = hits.withColumn("rerank_score", score)
    order = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), "rank")
    ranked = scored.withColumn("rerank_rank", F.row_number().over(order) - 1)
    return ranked.where(F.col("rerank_rank") < k)


def rerank_overlap(
    hits: DataFrame, k: int = 5, query: str = "query", content: str = "content"
) -> DataFrame:
    """Share of the distinct query words found in the chunk; old order breaks ties."""
    asked = F.array_distinct(T.words(F.col(query)))
    shared = F.size(F.array_intersect(asked, T.words(F.col(content))))
    return _rerank(
        hits, F.when(F.size(asked) == 0, F.lit(0.0)).otherwise(shared / F.size(asked)), k
    )


def normalized_rerank_score(raw: Column, kind: str) -> Column:
    """0-10 grades become tenths; raw logits outside [0, 1] go through a sigmoid."""
    if kind == "grade":
        return raw / 10
    bad = F.isnan(raw) | (F.abs(raw) == float("inf"))
    inside = (raw >= 0) & (raw <= 1)
    return F.when(bad, F.lit(0.0)).when(inside, raw).otherwise(1 / (1 + F.exp(-raw)))


def rerank_scores(
    hits: DataFrame, scores: DataFrame, kind: str = "api", k: int = 5
) -> DataFrame:
    """Order by external ``query_id, chunk_id, raw`` scores; missing counts as 0."""
    given = scores.select("query_id", "chunk_id", F.col("raw").cast("double").alias("_raw"))
    joined = hits.join(given, ["query_id", "chunk_id"], "left")
    score = F.coalesce(normalized_rerank_score(F.col("_raw"), kind), F.lit(0.0))
    return _rerank(joined, score, k).drop("_raw")


def rerank_identity(hits: DataFrame, k: int = 5) -> DataFrame:
    """Keep the order, ranks from 0."""
    return _rerank(hits, F.lit(0.0), k).withColumn("rerank_score", F.col("score"))


def rerank_or_identity(hits: DataFrame, scores: DataFrame, kind: str = "api", k: int = 5):
    """Queries the scorer said nothing about keep their order."""
    answered = scores.select("query_id").distinct()
    done = rerank_scores(hits.join(answered, "query_id", "left_semi"), scores, kind, k)
    kept = rerank_identity(hits.join(answered, "query_id", "left_anti"), k)
    return done.withColumn("fell_back", F.lit(False)).unionByName(
        kept.withColumn("fell_back", F.lit(True))
    )


# --- R14-R16 --------------------------------------------------------------------------------------------
SEPARATOR_TOKENS = 5
LABEL_TOKENS = 3


def _crumb(hits: DataFrame) -> Column:
    section = F.col("section") if "section" in hits.columns else F.lit(None).cast("string")
    page = F.col("page") if "page" in hits.columns else F.lit(None).cast("int")
    tail = F.when(page.isNotNull() & (page != 0), F.concat(F.lit(", tr."), page.cast("string")))
    text = F.concat(F.lit("("), section, F.coalesce(tail, F.lit("")), F.lit(") "))
    return F.when(~T.is_blank(section), text).otherwise(F.lit(""))


def build_context(hits: DataFrame, budget: int = 4000, tokens: str | None = None) -> DataFrame:
    """Best score per chunk, highest first; a chunk that does not fit is skipped.

    The greedy choice runs over the query's ordered hit list inside the JVM. ``tokens`` names a
    column with the cost of a rendered chunk without its label; by default it is counted here.
    """
    carried = [c for c in hits.columns if c not in ("query_id", "chunk_id")]
    best = hits.groupBy("query_id", "chunk_id").agg(
        F.max_by(F.struct(*carried), F.struct("score", -F.col("rank"))).alias("_h")
    ).select("query_id", "chunk_id", "_h.*")
    crumb = F.concat(_crumb(best), T.js_trim(F.col("content")))
    cost = F.col(tokens) if tokens else T.approx_tokens(crumb)
    ordered = best.select(
        "query_id",
        F.struct(
            (-F.col("score")).alias("neg"), "rank", "chunk_id", "score",
            (cost + LABEL_TOKENS).cast("long").alias("cost"),
            crumb.alias("text"),
            *([F.col("doc_id")] if "doc_id" in carried else []),
        ).alias("h"),
    ).groupBy("query_id").agg(F.sort_array(F.collect_list("h")).alias("hits"))

    empty = F.struct(
        F.array().cast("array<int>").alias("kept"),
        F.lit(0).cast("long").alias("total"),
        F.lit(0).alias("at"),
    )

    def take(acc: Column, h: Column) -> Column:
        first = F.size(acc["kept"]) == 0
        cost = h["cost"] + F.when(first, F.lit(0)).otherwise(F.lit(SEPARATOR_TOKENS))
        fits = (acc["total"] < budget) & (first | (acc["total"] + cost <= budget))
        return F.struct(
            F.when(fits, F.array_append(acc["kept"], acc["at"])).otherwise(acc["kept"])
            .alias("kept"),
            F.when(fits, acc["total"] + cost).otherwise(acc["total"]).alias("total"),
            (acc["at"] + 1).alias("at"),
        )

    packed = ordered.select("query_id", "hits", F.aggregate("hits", empty, take).alias("p"))
    rows = packed.select(
        "query_id", F.col("p.total").alias("total_tokens"),
        F.posexplode(F.transform("p.kept", lambda i: F.get("hits", i))).alias("pos", "h"),
    )
    extra = [F.col("h.doc_id").alias("doc_id")] if "doc_id" in carried else []
    return rows.select(
        "query_id", (F.col("pos") + 1).alias("pos"), F.col("h.chunk_id").alias("chunk_id"), *extra,
        F.col("h.score").alias("score"), F.col("h.text").alias("text"), "total_tokens",
    )


def render_context(packed: DataFrame) -> DataFrame:
    """Numbered blocks joined by a rule."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), F.col("text"))
    parts = F.sort_array(F.collect_list(F.struct("pos", line.alias("line"))))
    return packed.groupBy("query_id").agg(
        F.array_join(F.transform(parts, lambda s: s["line"]), "\n\n---\n\n").alias("context")
    )


def validate_context(
    queries: DataFrame,
    packed: DataFrame,
    min_chunks: int = 1,
    min_relevance: float = 0.0,
    strict: bool = True,
    strict_floor: float = 0.15,
) -> DataFrame:
    """Abstain when there are too few chunks or the best score is below the floor."""
    floor = max(min_relevance, strict_floor) if strict else min_relevance
    stats = packed.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.max("score").alias("top_score")
    )
    joined = queries.select("query_id").join(stats, "query_id", "left").fillna({"chunks": 0})
    few = F.col("chunks") < min_chunks
    weak = F.col("top_score") < floor
    return joined.select(
        "query_id", "chunks", "top_score",
        (~few & ~F.coalesce(weak, F.lit(False))).alias("proceed"),
        F.when(few | F.coalesce(weak, F.lit(False)), "INSUFFICIENT_EVIDENCE").otherwise("OK")
        .alias("status"),
        F.when(few, "too_few_chunks").when(weak, "low_relevance").alias("reason"),
    )
