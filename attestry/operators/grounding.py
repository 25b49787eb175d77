"""Grounding checks over tables of answers, claims and context chunks.

Tables: answers(answer_id, answer), claims(answer_id, claim_id, claim_text). A context is either a
table (answer_id, pos, chunk_id, doc_id, content, score) or a ``SharedContext``, in which many answers
see stretches of the same chunks: those are tokenised once and packed into blocks of 64, and
an answer is a range of positions. Checks send an answer's nested claims to the blocks of its range and
judge them there, in the row; what comes back are the best few chunks of every claim. No text
of a chunk leaves its row, and no claim-chunk pairs are made.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import grounding as G
from attestry.functions import text as T
from attestry.operators import dedupe
from attestry.session import cut_lineage

BLOCK = 64


@dataclass
class SharedContext:
    """``blocks`` (ctx_id, block, low, items), ``chunks`` (ctx_id, pos, chunk_id, doc_id) and
    ``ranges`` (answer_id, ctx_id, last): an answer sees the chunks of ``ctx_id`` with pos <= last."""

    blocks: DataFrame
    chunks: DataFrame
    ranges: DataFrame

    @staticmethod
    def of(chunks: DataFrame, ranges: DataFrame, keep: bool = True) -> SharedContext:
        """From chunks (ctx_id, pos, chunk_id, doc_id, content, score), ``pos`` unique in a context.

        ``keep`` checkpoints the blocks, so that several checks read the text once.
        """
        negative, positive = G.clear_polarity(F.lower("content"))
        item = F.struct(
            "pos", "chunk_id", "score",
            T.content_tokens("content").alias("tokens"),
            T.numbers("content").alias("numbers"),
            T.numbers_with_unit("content").alias("units"),
            negative.alias("negative"), positive.alias("positive"),
        )
        rows = chunks.select("ctx_id", F.floor(F.col("pos") / BLOCK).alias("block"), item.alias("item"))
        blocks = rows.groupBy("ctx_id", "block").agg(
            F.min("item.pos").alias("low"), F.sort_array(F.collect_list("item")).alias("items")
        )
        return SharedContext(
            cut_lineage(blocks) if keep else blocks,
            chunks.select("ctx_id", "pos", "chunk_id", "doc_id"),
            ranges.select("answer_id", "ctx_id", "last"),
        )


def as_shared(context: DataFrame | SharedContext) -> SharedContext:
    """A table of packed contexts is shared by nobody: each answer has its own."""
    if isinstance(context, SharedContext):
        return context
    ranges = context.groupBy("answer_id").agg(F.max("pos").alias("last"))
    return SharedContext.of(
        context.withColumnRenamed("answer_id", "ctx_id"),
        ranges.withColumn("ctx_id", F.col("answer_id")),
        keep=False,
    )


Part = tuple[Callable[[Column], Column], Callable[[Column], Column]]


def over_context(rows: DataFrame, context: DataFrame | SharedContext, parts: dict[str, Part]) -> DataFrame:
    """``rows``, one per answer, with a column for each part of the work on the answer's context.

    A part is (what to take from the items of one block, what to make of the blocks' results in order).
    An answer without a context gets the result of one empty block.
    """
    shared = as_shared(context)
    index = shared.blocks.select("ctx_id", "block", "low")
    seen = shared.ranges.join(index, "ctx_id").where("low <= last").select(
        "answer_id", "ctx_id", "last", "block"
    )
    kind = shared.blocks.schema["items"].dataType
    visible = F.filter(F.coalesce("items", F.array().cast(kind)), lambda c: c["pos"] <= F.col("last"))
    met = rows.join(seen, "answer_id", "left").join(
        shared.blocks.drop("low"), ["ctx_id", "block"], "left"
    ).select(F.struct(*[F.col(c) for c in rows.columns]).alias("_row"), "block", visible.alias("_items"))
    taken = met.select(
        "_row", F.struct("block", *[take(F.col("_items")).alias(n) for n, (take, _) in parts.items()]).alias("_p")
    )
    merged = taken.groupBy("_row.answer_id").agg(
        F.any_value("_row").alias("_row"), F.sort_array(F.collect_list("_p")).alias("_parts")
    )
    return merged.select(
        "_row.*", *[merge(F.col(f"_parts.{n}")).alias(n) for n, (_, merge) in parts.items()]
    )


def found_in(field: str, wanted: str) -> Part:
    """The distinct ones of the array column ``wanted`` that occur in ``field`` of any chunk."""
    return (
        lambda items: F.array_intersect(F.col(f"_row.{wanted}"), F.flatten(F.transform(items, lambda c: c[field]))),
        lambda parts: F.array_distinct(F.flatten(parts)),
    )


#: How many chunks an answer sees, and the sum of their scores.
N_CHUNKS: Part = (F.size, lambda parts: F.aggregate(parts, F.lit(0), lambda a, n: a + n))
SCORES: Part = (
    lambda items: F.aggregate(
        items, F.lit(0.0), lambda a, c: a + F.coalesce(c["score"].cast("double"), F.lit(0.0))
    ),
    lambda parts: F.aggregate(parts, F.lit(0.0), lambda a, s: a + s),
)


def in_context(rows: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """``rows`` (answer_id, chunk_id, doc_id, ...) with ``_chunk_in`` and ``_doc_in``."""
    shared = as_shared(context)
    ranges = shared.ranges.select("answer_id", "ctx_id", "last")
    first = F.min("pos")
    chunks = shared.chunks.groupBy("ctx_id", "chunk_id").agg(first.alias("_cp"))
    docs = shared.chunks.groupBy("ctx_id", "doc_id").agg(first.alias("_dp"))
    joined = rows.join(ranges, "answer_id", "left").join(chunks, ["ctx_id", "chunk_id"], "left").join(
        docs, ["ctx_id", "doc_id"], "left"
    )
    return joined.select(
        *rows.columns,
        F.coalesce(F.col("_cp") <= F.col("last"), F.lit(False)).alias("_chunk_in"),
        F.coalesce(F.col("_dp") <= F.col("last"), F.lit(False)).alias("_doc_in"),
    )


# --- V6 ------------------------------------------------------------------------------------------------
def claims_with_fallback(
    answers: DataFrame, extracted: DataFrame, min_tokens: int = 6
) -> DataFrame:
    """V6: no claims for refusals; a very short answer, or one without claims, is its own claim.

    ``extracted`` has answer_id, pos, claim_text; equal claims are dropped and the rest renumbered.
    """
    usable = answers.where(~G.is_abstention("answer")).select(
        "answer_id", T.js_trim(F.col("answer")).alias("answer"),
        (F.size(T.content_tokens("answer")) < min_tokens).alias("_short"),
    )
    long_answers = usable.where("not _short")
    rows = dedupe.dedupe_claims(
        extracted.join(long_answers.select("answer_id"), "answer_id", "left_semi"),
        ["answer_id"], "pos", "claim_text",
    )
    have = rows.select("answer_id").distinct().withColumn("_has", F.lit(True))
    alone = usable.join(have, "answer_id", "left").where("_short or _has is null")
    return rows.unionByName(
        alone.select(
            "answer_id", F.lit("c1").alias("claim_id"), F.col("answer").alias("claim_text")
        )
    )


# --- V7, V12, V13 per claim ---------------------------------------------------------------------------------
def nested(claims: DataFrame) -> DataFrame:
    """One row per answer: ``claims``, each with all its columns and what the checks read of its text."""
    negative, positive = G.clear_polarity(F.lower("claim_text"))
    item = F.struct(
        F.struct(*[F.col(c) for c in claims.columns]).alias("own"),
        T.content_tokens("claim_text").alias("tokens"),
        T.numbers("claim_text").alias("numbers"),
        T.numbers_with_unit("claim_text").alias("units"),
        negative.alias("negative"), positive.alias("positive"),
    )
    return claims.select("answer_id", item.alias("c")).groupBy("answer_id").agg(
        F.collect_list("c").alias("claims")
    )


def _contradicts(claim: Column, chunk: Column) -> Column:
    return G.contradiction(
        G.overlap_ratio(claim["tokens"], chunk["tokens"]),
        (claim["negative"], claim["positive"]), (chunk["negative"], chunk["positive"]),
        claim["units"], chunk["units"],
    )


def _best_chunks(min_overlap: float, most: int, named: Column | None) -> Part:
    """Per claim: the best overlap and the best ``most`` chunks that reach the bar."""

    def score(claim: Column) -> Callable[[Column, Column], Column]:
        return lambda c, k: F.struct(
            T.js_round(F.coalesce(G.overlap_ratio(claim["tokens"], c["tokens"]), F.lit(0.0))).alias("overlap"),
            (-c["pos"]).alias("neg"), c["chunk_id"].alias("chunk_id"), k.alias("k"),
        )

    def reaches(s: Column) -> Column:
        bar = s["overlap"] >= min_overlap
        if named is None:
            return bar
        return bar | (
            (s["overlap"] >= min_overlap * 0.6) & F.array_contains(named, s["chunk_id"].cast("string"))
        )

    def take(items: Column) -> Column:
        scored = F.transform(
            "_row.claims",
            lambda c: F.struct(c.alias("claim"), F.transform(items, score(c)).alias("scored")),
        )
        return F.transform(
            scored,
            lambda x: F.struct(
                F.array_max(F.transform(x["scored"], lambda s: s["overlap"])).alias("best"),
                F.transform(
                    F.slice(F.sort_array(F.filter(x["scored"], reaches), asc=False), 1, most),
                    lambda s: F.struct(
                        s["overlap"].alias("overlap"), s["neg"].alias("neg"), s["chunk_id"].alias("chunk_id"),
                        _contradicts(x["claim"], F.get(items, s["k"])).alias("against"),
                    ),
                ).alias("top"),
            ),
        )

    def merge(parts: Column) -> Column:
        return F.transform(
            "_row.claims",
            lambda _, i: F.struct(
                F.coalesce(F.array_max(F.transform(parts, lambda p: F.get(p, i)["best"])), F.lit(0.0)).alias("best"),
                F.slice(
                    F.sort_array(F.flatten(F.transform(parts, lambda p: F.get(p, i)["top"])), asc=False), 1, most
                ).alias("top"),
            ),
        )

    return take, merge


def _figures(most: int) -> Part:
    """Per claim: which of its figures occur in the context, and the first chunks with any of them."""

    def take(items: Column) -> Column:
        def one(claim: Column) -> Column:
            backing = F.filter(items, lambda c: F.arrays_overlap(claim["numbers"], c["numbers"]))
            return F.struct(
                F.array_intersect(
                    claim["numbers"], F.flatten(F.transform(items, lambda c: c["numbers"]))
                ).alias("found"),
                F.transform(F.slice(backing, 1, most), lambda c: c["chunk_id"]).alias("backing"),
            )

        return F.transform("_row.claims", one)

    def merge(parts: Column) -> Column:
        return F.transform(
            "_row.claims",
            lambda _, i: F.struct(
                F.flatten(F.transform(parts, lambda p: F.get(p, i)["found"])).alias("found"),
                F.slice(F.flatten(F.transform(parts, lambda p: F.get(p, i)["backing"])), 1, most).alias("backing"),
            ),
        )

    return take, merge


def match_evidence(
    claims: DataFrame,
    context: DataFrame | SharedContext,
    min_overlap: float = 0.5,
    most: int = 3,
    cited: DataFrame | None = None,
) -> DataFrame:
    """V7: adds ``supported, verdict, evidence_score, evidence`` (chunk ids, best first).

    ``cited`` (answer_id, chunk_id) lowers the bar to 60% for chunks the answer named itself. The same
    pass gives ``contradicted_by`` (V13: the first chunk of the evidence that contradicts the claim), and
    ``figures_backed`` and ``backing`` (V12: whether the context has all the claim's figures, and
    the first chunks with any), which the later checks take from here.
    """
    rows = nested(claims)
    named = None
    if cited is not None:
        sets = cited.groupBy("answer_id").agg(
            F.collect_set(F.col("chunk_id").cast("string")).alias("_cited")
        )
        rows = rows.join(sets, "answer_id", "left")
        named = F.coalesce(F.col("_row._cited"), F.array().cast("array<string>"))
    met = over_context(
        rows, context, {"_m": _best_chunks(min_overlap, most, named), "_f": _figures(most)}
    )
    each = met.select(F.explode(F.arrays_zip("claims", "_m", "_f")).alias("z")).select(
        F.col("z.claims").alias("c"), F.col("z._m").alias("m"), F.col("z._f").alias("f")
    )
    some = F.size("c.tokens") > 0
    ok = (F.col("m.best") >= min_overlap) & some
    ids = F.transform("m.top", lambda t: t["chunk_id"])
    against = F.array_max(
        F.transform(
            F.filter("m.top", lambda t: t["against"]),
            lambda t: F.struct(t["neg"].alias("neg"), t["chunk_id"].alias("chunk_id")),
        )
    )["chunk_id"]
    return each.select(
        "c.own.*",
        ok.alias("supported"),
        F.when(ok, "SUPPORTED").otherwise("UNSUPPORTED").alias("verdict"),
        F.when(some, F.col("m.best")).otherwise(F.lit(0.0)).alias("evidence_score"),
        F.when(ok, ids).otherwise(F.slice(ids, 1, 0)).alias("evidence"),
        F.when(ok, against).alias("contradicted_by"),
        (F.size(F.array_except("c.numbers", "f.found")) == 0).alias("figures_backed"),
        F.col("f.backing").alias("backing"),
    )


def with_documents(rows: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """``rows`` (answer_id, chunk_id, ...) with the ``doc_id`` of the answer's chunk, null for others."""
    shared = as_shared(context)
    parents = shared.chunks.groupBy("ctx_id", "chunk_id").agg(
        F.min(F.struct("pos", "doc_id")).alias("_d")
    )
    joined = rows.join(shared.ranges, "answer_id", "left").join(
        parents, ["ctx_id", "chunk_id"], "left"
    )
    return joined.select(
        *rows.columns, F.when(F.col("_d.pos") <= F.col("last"), F.col("_d.doc_id")).alias("doc_id")
    )


# --- V8, V9, V21 -------------------------------------------------------------------------------------------
def build_citations(
    evidence: DataFrame, context: DataFrame | SharedContext, relations: DataFrame | None = None
) -> DataFrame:
    """V8: a row per (claim, evidence chunk); a claim without any gets one invalid row.

    ``relations`` are relation citations (G14) tried before a claim is declared invalid.
    """
    rows = evidence.select(
        "answer_id", "claim_id", "claim_text",
        F.explode_outer(F.when(F.col("supported"), F.col("evidence"))).alias("chunk_id"),
    )
    found = with_documents(rows, context).select(
        "answer_id", "claim_id", "claim_text", "doc_id", "chunk_id",
        F.lit("chunk").alias("kind"),
        F.col("doc_id").isNotNull().alias("valid"),
        F.lit(None).cast("string").alias("source_entity"),
        F.lit(None).cast("string").alias("target_entity"),
        F.lit(None).cast("string").alias("relation_type"),
    )
    if relations is None:
        return found
    rescued = relations.select("answer_id", "claim_id").distinct()
    keep = found.join(
        rescued.withColumn("_r", F.lit(True)), ["answer_id", "claim_id"], "left"
    ).where(F.col("valid") | F.col("_r").isNull()).drop("_r")
    open_claims = found.where("not valid").select("answer_id", "claim_id").distinct()
    extra = relations.join(open_claims, ["answer_id", "claim_id"], "left_semi")
    return keep.unionByName(
        extra.withColumns({"kind": F.lit("relationship"), "valid": F.lit(True)}).select(
            *keep.columns
        )
    )


def baseline_citations(answers: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """V9: 1-based indexes the generator named (``cited_indexes``) looked up in the context."""
    shared = as_shared(context)
    named = answers.select("answer_id", F.posexplode("cited_indexes").alias("n", "pos"))
    return named.join(shared.ranges, "answer_id").where("pos <= last").join(
        shared.chunks, ["ctx_id", "pos"]
    ).select("answer_id", "n", "chunk_id", "doc_id", F.lit(True).alias("valid"))


def citation_integrity(citations: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """Ids that are not part of the answer's context are nulled before storing."""
    return in_context(citations, context).select(
        *[c for c in citations.columns if c not in ("chunk_id", "doc_id")],
        F.when(F.col("_chunk_in"), F.col("chunk_id")).alias("chunk_id"),
        F.when(F.col("_doc_in"), F.col("doc_id")).alias("doc_id"),
    )


# --- V11, V12 ------------------------------------------------------------------------------------------------
def numeric_provenance(answers: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """Figures of the answer that no context chunk contains."""
    rows = over_context(
        answers.withColumn("_n", T.numbers("answer")), context, {"_found": found_in("numbers", "_n")}
    )
    missing = F.array_except("_n", "_found")
    return rows.select(
        *answers.columns,
        F.size("_n").alias("checked"),
        missing.alias("ungrounded"),
        ((F.size("_n") > 0) & (F.size(missing) == 0)).alias("all_grounded"),
    )


def is_generic_year(n: Column) -> Column:
    return F.regexp_like(n, F.lit(r"^(19|20)[0-9]{2}\z"))


def _rematched(
    evidence: DataFrame, context: DataFrame | SharedContext, wanted: list[str], parts: dict[str, Part]
) -> DataFrame:
    """``evidence`` with the columns of ``match_evidence`` that it lacks, from a pass of its own."""
    if all(c in evidence.columns for c in wanted):
        return evidence
    met = over_context(nested(evidence), context, parts)
    zipped = F.arrays_zip("claims", *parts)
    return met.select(F.explode(zipped).alias("z")).select("z.claims.own.*", F.col("z"))


def apply_numeric_provenance(
    evidence: DataFrame, context: DataFrame | SharedContext, most: int = 3
) -> DataFrame:
    """An unsupported claim whose figures all occur in the context becomes supported.

    Bare years do not count as proof. Adds ``rescued``; the evidence is the first chunks with any
    of the figures.
    """
    wanted = ["figures_backed", "backing"]
    rows = _rematched(evidence, context, wanted, {"_f": _figures(most)})
    if "z" in rows.columns:
        missing = F.array_except("z.claims.numbers", "z._f.found")
        rows = rows.withColumns(
            {"figures_backed": F.size(missing) == 0, "backing": F.col("z._f.backing")}
        )
    numbers = T.numbers("claim_text")
    rows = rows.withColumn("_n", numbers)
    rescued = (
        ~F.col("supported")
        & (F.col("verdict") != "CONTRADICTED")
        & (F.size("_n") > 0)
        & ~F.forall("_n", is_generic_year)
        & F.col("figures_backed")
    )
    rows = rows.withColumn("_r", rescued)
    hidden = ("supported", "verdict", "evidence", *wanted)
    return rows.select(
        *[c for c in evidence.columns if c not in hidden],
        (F.col("supported") | F.col("_r")).alias("supported"),
        F.when(F.col("_r"), "SUPPORTED").otherwise(F.col("verdict")).alias("verdict"),
        F.when(F.col("_r"), F.slice("backing", 1, most)).otherwise(F.col("evidence")).alias("evidence"),
        F.col("_r").alias("rescued"),
    )


# --- V13, V15 ---------------------------------------------------------------------------------------------------
def claim_contradictions(evidence: DataFrame, context: DataFrame | SharedContext) -> DataFrame:
    """V13 against the claim's own evidence chunks only; adds ``contradicted_by`` (first chunk)."""

    def take(items: Column) -> Column:
        def one(claim: Column) -> Column:
            own = F.filter(items, lambda c: F.array_contains(claim["own"]["evidence"], c["chunk_id"]))
            against = F.filter(own, lambda c: _contradicts(claim, c))
            return F.transform(F.slice(against, 1, 1), lambda c: c["chunk_id"])

        return F.transform("_row.claims", one)

    def merge(parts: Column) -> Column:
        return F.transform(
            "_row.claims", lambda _, i: F.get(F.flatten(F.transform(parts, lambda p: F.get(p, i))), F.lit(0))
        )

    rows = _rematched(evidence, context, ["contradicted_by"], {"_a": (take, merge)})
    if "z" in rows.columns:
        rows = rows.withColumn("contradicted_by", F.col("z._a")).drop("z")
    return rows


def context_conflicts(
    context: DataFrame | SharedContext, min_jaccard: float = 0.4
) -> DataFrame:
    """First chunk pair of a context on one subject with different figures for a unit.

    Chunks meet on a shared unit inside their context, so only candidate pairs exist, and a pair is
    compared once for all answers that see both chunks.
    """
    shared = as_shared(context)
    rows = shared.blocks.select("ctx_id", F.explode("items").alias("c")).select(
        "ctx_id", "c.pos", "c.chunk_id", "c.tokens", "c.units"
    ).where(F.size("units") > 0)
    units = rows.select(
        "ctx_id", "pos",
        F.explode(F.array_distinct(F.transform("units", lambda u: u["unit"]))).alias("unit"),
    )
    left, right = units, units.withColumnRenamed("pos", "pos_b")
    pairs = (
        left.join(right, ["ctx_id", "unit"])
        .where("pos < pos_b")
        .select("ctx_id", "pos", "pos_b")
        .distinct()
    )
    a = rows.select(
        "ctx_id", "pos", F.col("chunk_id").alias("chunk_a"), F.col("tokens").alias("ta"),
        F.col("units").alias("ua"),
    )
    b = rows.select(
        "ctx_id", F.col("pos").alias("pos_b"), F.col("chunk_id").alias("chunk_b"),
        F.col("tokens").alias("tb"), F.col("units").alias("ub"),
    )
    full = pairs.join(a, ["ctx_id", "pos"]).join(b, ["ctx_id", "pos_b"])
    clash = full.where(G.jaccard(F.col("ta"), F.col("tb")) >= min_jaccard).withColumn(
        "unit", G.disjoint_units(F.col("ua"), F.col("ub"))
    ).where("unit is not null")
    # of the pairs that end in one chunk only the first can be an answer's first
    ends = clash.groupBy("ctx_id", "pos_b").agg(
        F.min(F.struct("pos", "pos_b", "chunk_a", "chunk_b", "unit")).alias("_f")
    )
    return shared.ranges.join(ends, "ctx_id").where("pos_b <= last").groupBy("answer_id").agg(
        F.min("_f").alias("_f")
    ).select("answer_id", "_f.chunk_a", "_f.chunk_b", "_f.unit")


# --- V16-V18 ---------------------------------------------------------------------------------------------------------
def faithfulness(
    answers: DataFrame,
    evidence: DataFrame,
    context: DataFrame | SharedContext,
    mode: str = "heuristic",
    external: DataFrame | None = None,
    threshold: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """(claims with final verdicts, one row per answer with score, grounded, root cause).

    ``answers`` needs answer_id, answer, status. ``mode="heuristic"`` trusts contradictions found
    here; otherwise ``external`` (answer_id, claim_id, verdict) decides where it has a row.
    """
    judged = claim_contradictions(evidence, context)
    suspect = F.col("contradicted_by").isNotNull()
    verdict = F.col("verdict")
    if mode == "heuristic" or external is None:
        verdict = F.when(suspect, "CONTRADICTED").otherwise(verdict)
    else:
        given = external.select("answer_id", "claim_id", F.col("verdict").alias("_ext"))
        judged = judged.join(given, ["answer_id", "claim_id"], "left")
        verdict = F.coalesce(F.col("_ext"), verdict)
    claims = judged.withColumn("verdict", verdict).withColumn(
        "supported", F.col("verdict") == "SUPPORTED"
    ).select(*evidence.columns)

    tally = claims.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("verdict") == "SUPPORTED").alias("n_supported"),
        F.count_if(F.col("verdict") == "CONTRADICTED").alias("n_contradicted"),
    )
    totals = over_context(answers.select("answer_id"), context, {"n_chunks": N_CHUNKS, "_s": SCORES})
    chunks = totals.select(
        "answer_id", "n_chunks", F.when(F.col("n_chunks") > 0, F.col("_s") / F.col("n_chunks")).alias("avg_s")
    )
    clash = context_conflicts(context).select("answer_id", F.lit(True).alias("_clash"))
    rows = (
        answers.join(tally, "answer_id", "left")
        .join(chunks, "answer_id", "left")
        .join(clash, "answer_id", "left")
        .fillna({"total": 0, "n_supported": 0, "n_contradicted": 0, "n_chunks": 0})
    )
    skipped = (F.col("status") == "INSUFFICIENT_EVIDENCE") | G.is_abstention("answer")
    raw = (F.col("n_supported") - F.col("n_contradicted") * 2) / F.col("total")
    has_clash = F.coalesce("_clash", F.lit(False))
    trusted = has_clash if mode == "heuristic" else F.lit(False)
    confirmed = trusted | (has_clash & (F.col("n_contradicted") > 0))
    score = (
        F.when(skipped, F.lit(1.0))
        .when(F.col("total") == 0, F.lit(0.0))
        .otherwise(T.clamp(T.js_round(F.when(F.col("total") > 0, raw))))
    )
    rows = rows.withColumns({"score": score, "_skip": skipped, "_conf": confirmed, "_tr": trusted})
    grounded = F.col("_skip") | (
        (F.col("total") > 0)
        & (F.col("score") >= threshold)
        & (F.col("n_contradicted") == 0)
        & ~F.col("_tr")
    )
    rows = rows.withColumn("grounded", grounded)
    cause = F.when(F.col("total") == 0, "GENERATION_HALLUCINATION").otherwise(
        G.root_cause(
            F.col("n_chunks"), F.col("_conf"), F.col("avg_s"), F.col("n_contradicted"),
            F.col("n_supported"), F.col("total"),
        )
    )
    rows = rows.withColumn("root_cause", F.when(~F.col("grounded"), cause))
    return claims, rows.select(
        *answers.columns, "total", "n_supported", "n_contradicted", "n_chunks", "score",
        "grounded", "root_cause",
    )


def verify_answers(
    answers: DataFrame,
    extracted: DataFrame,
    context: DataFrame | SharedContext,
    relations: DataFrame | None = None,
    mode: str = "heuristic",
    external: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(answers with final status and text, verified claims, citations)."""
    context = as_shared(context)
    claims = claims_with_fallback(answers, extracted)
    evidence = cut_lineage(match_evidence(claims, context))
    citations = build_citations(evidence, context, relations)
    checked, faith = faithfulness(answers, evidence, context, mode, external)
    rescued = apply_numeric_provenance(checked, context)
    backed = rescued.where("rescued").select(
        "answer_id", "claim_id", "claim_text", F.explode("evidence").alias("chunk_id")
    )
    added = with_documents(backed, context).select(
        "answer_id", "claim_id", "claim_text", "doc_id", "chunk_id",
        F.lit("chunk").alias("kind"), F.lit(True).alias("valid"),
        *[
            F.lit(None).cast("string").alias(c)
            for c in ("source_entity", "target_entity", "relation_type")
        ],
    )
    tally = rescued.groupBy("answer_id").agg(
        F.count(F.lit(1)).alias("_total"),
        F.count_if("supported").alias("_sup"),
        F.count_if(F.col("verdict") == "CONTRADICTED").alias("_con"),
    )
    rows = faith.join(tally, "answer_id", "left").fillna({"_total": 0, "_sup": 0, "_con": 0})
    no_claims = F.col("_total") == 0
    status = (
        F.when(no_claims, F.lit("INSUFFICIENT_EVIDENCE"))
        .when(F.col("n_chunks") == 0, F.lit("INSUFFICIENT_EVIDENCE"))
        .otherwise(
            G.final_status(
                F.col("status"), F.col("_con"), F.col("_sup"), F.col("_total"),
                F.col("grounded"), F.col("root_cause"),
            )
        )
    )
    rows = rows.withColumn("final_status", status)
    text = F.when(
        (F.col("final_status") == "INSUFFICIENT_EVIDENCE") & ~no_claims,
        F.lit(fixed.ABSTAIN_ANSWER),
    ).otherwise(F.col("answer"))
    rows = rows.withColumn("final_answer", text).drop("_total", "_sup", "_con")
    return rows, rescued, citations.unionByName(added)
