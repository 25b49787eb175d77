"""Registered queries over grounding (V). Assistant turns are answers, the turns before them the
context, their sentences the claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import grounding as G
from attestry.functions import text as T
from attestry.operators import grounding
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()

def turns(spark: SparkSession, sf: str) -> DataFrame:
    rows = src.table(spark, sf, "conversations")
    return rows.select(
        "conv_id", "turn", "role",
        F.concat_ws("-", "conv_id", "turn").alias("answer_id"),
        T.nfc("text").alias("text"),
    )


def restated(spark: SparkSession, sf: str) -> DataFrame:
    """The turns as they would be if all of a conversation were on its first turn's subject, each with a
    figure of its own, so that answers contradict what was said before them."""
    rows = turns(spark, sf)
    first = rows.groupBy("conv_id").agg(F.min_by("text", "turn").alias("subject"))
    figure = F.concat(F.lit(" "), F.col("turn") % 2 + 2, F.lit(" tín chỉ"))
    return rows.join(first, "conv_id").withColumn("text", F.concat("subject", figure)).drop("subject")


def answers(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    rows = turns(spark, sf) if rows is None else rows
    return rows.where("role = 'assistant'").select(
        "answer_id", F.col("text").alias("answer"), F.lit("GROUNDED").alias("status")
    )


def context(spark: SparkSession, sf: str) -> DataFrame:
    """All turns before an answer."""
    rows = turns(spark, sf)
    asked = rows.where("role = 'assistant'").select("answer_id", "conv_id", F.col("turn").alias("asked"))
    found = rows.select(
        "conv_id", "turn", "role", F.col("answer_id").alias("chunk_id"),
        F.col("text").alias("content"),
    )
    return asked.join(found, "conv_id").where("turn < asked").select(
        "answer_id",
        (F.col("turn") + 1).alias("pos"),
        "chunk_id",
        F.col("conv_id").cast("string").alias("doc_id"),
        "content",
        "role",
        F.lit(0.5).alias("score"),
    )


def shared(
    spark: SparkSession, sf: str, keep: bool = True, rows: DataFrame | None = None
) -> grounding.SharedContext:
    """The same contexts as ranges: the turns of a conversation once, and up to which one each answer sees."""
    rows = turns(spark, sf) if rows is None else rows
    chunks = rows.select(
        F.col("conv_id").alias("ctx_id"), (F.col("turn") + 1).alias("pos"),
        F.col("answer_id").alias("chunk_id"), F.col("conv_id").cast("string").alias("doc_id"),
        F.col("text").alias("content"), F.lit(0.5).alias("score"),
    )
    ranges = rows.where("role = 'assistant'").select(
        "answer_id", F.col("conv_id").alias("ctx_id"), F.col("turn").alias("last")
    )
    return grounding.SharedContext.of(chunks, ranges, keep)


def extracted(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return answers(spark, sf, rows).select(
        "answer_id", F.posexplode(T.split_sentences_by_line("answer")).alias("pos", "claim_text")
    )


def claims(spark: SparkSession, sf: str, rows: DataFrame | None = None) -> DataFrame:
    return grounding.claims_with_fallback(answers(spark, sf, rows), extracted(spark, sf, rows))


_ANS = (
    "turns AS (SELECT conv_id, turn, role, conv_id || '-' || turn AS answer_id, "
    "nfc_normalize(text) AS text FROM conversations), "
    "ans AS (SELECT answer_id, conv_id, turn, text AS answer FROM turns WHERE role = 'assistant'), "
    "ctx AS (SELECT a.answer_id, c.turn + 1 AS pos, c.answer_id AS chunk_id, "
    f"c.conv_id::VARCHAR AS doc_id, c.role AS crole, c.text AS content, {S.content_tokens('c.text')} AS ctok FROM "
    f"ans a JOIN turns c ON c.conv_id = a.conv_id AND c.turn < a.turn)"
)
_RESTATED = (
    "FROM (SELECT c.conv_id, c.turn, c.role, f.text || ' ' || (c.turn % 2 + 2) || ' tín chỉ' AS text FROM "
    "conversations c JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations GROUP BY 1) f USING (conv_id))"
)


def _on_restated(sql: str) -> str:
    return sql.replace("FROM conversations)", f"{_RESTATED})", 1)


_LOWER = S.trim("lower(answer)")
_STRONG = " OR ".join(f"contains({_LOWER}, '{p}')" for p in fixed.STRONG_ABSTENTION)
_WEAK = " OR ".join(f"contains({_LOWER}, '{p}')" for p in fixed.WEAK_ABSTENTION)
_ABSTAINS = (
    f"({_LOWER} = '' OR {_STRONG} OR (({_WEAK}) AND "
    rf"len(regexp_extract_all({_LOWER}, '[\p{{L}}\p{{N}}]+')) <= 25))"
)
_SPLIT = S.rep(S.trim("line"), rf"([.!?…:])[{S.WS}]+", "\\1\x01")
_CLAIMS = (
    f"{_ANS}, usable AS (SELECT *, len({S.content_tokens('answer')}) < 6 AS short FROM ans "
    f"WHERE NOT {_ABSTAINS}), "
    "lines AS (SELECT answer_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS li FROM "
    r"(SELECT answer_id, string_split_regex(answer, '\n+') AS ls FROM usable WHERE NOT short)), "
    "pieces AS (SELECT answer_id, li, unnest(ps) AS p, generate_subscripts(ps, 1) AS pi FROM "
    f"(SELECT answer_id, li, CASE WHEN regexp_matches({S.trim('line')}, '^#{{1,6}}[{S.WS}]') "
    f"THEN [{S.trim('line')}] ELSE string_split({_SPLIT}, chr(1)) END AS ps FROM lines)), "
    f"sents AS (SELECT answer_id, {S.trim('p')} AS claim_text, li, pi FROM pieces "
    f"WHERE {S.trim('p')} <> ''), "
    f"firsts AS (SELECT *, row_number() OVER (PARTITION BY answer_id, {S.squeeze('lower(claim_text)')}"
    " ORDER BY li, pi) AS rn FROM sents), "
    "numbered AS (SELECT answer_id, 'c' || row_number() OVER (PARTITION BY answer_id "
    "ORDER BY li, pi) AS claim_id, claim_text FROM firsts WHERE rn = 1), "
    "claims AS (SELECT * FROM numbered UNION ALL SELECT answer_id, 'c1', "
    f"{S.trim('answer')} FROM usable WHERE short OR answer_id NOT IN "
    "(SELECT answer_id FROM numbered))"
)
_EVIDENCE = (
    f"{_CLAIMS}, ct AS (SELECT *, {S.content_tokens('claim_text')} AS tok FROM claims), "
    "pairs AS (SELECT ct.answer_id, claim_id, chunk_id, pos, "
    + S.js_round("len(list_intersect(tok, ctok))::DOUBLE / len(tok)")
    + " AS ov FROM ct JOIN ctx ON ct.answer_id = ctx.answer_id WHERE len(tok) > 0), "
    "best AS (SELECT answer_id, claim_id, max(ov) AS best, "
    "list(chunk_id ORDER BY ov DESC, pos) FILTER (WHERE ov >= 0.5) AS ev FROM pairs GROUP BY ALL), "
    "evidence AS (SELECT c.*, coalesce(best, 0.0::DOUBLE) AS evidence_score, "
    "coalesce(best >= 0.5, false) AS supported, "
    "coalesce(list_slice(ev, 1, 3), []) AS ev FROM claims c LEFT JOIN best "
    "USING (answer_id, claim_id))"
)


@query(
    "answer_claims",
    f"WITH {_CLAIMS} SELECT answer_id, claim_id, sha256(claim_text) AS claim_sha FROM claims",
)
def answer_claims(spark: SparkSession, sf: str) -> DataFrame:
    return claims(spark, sf).select(
        "answer_id", "claim_id", F.sha2("claim_text", 256).alias("claim_sha")
    )


_NUMBERS = (
    "list_distinct(list_filter(list_transform(regexp_extract_all({e}, "
    "'[0-9][0-9.,]*[0-9]|[0-9]{{2,}}'), lambda n: regexp_replace(n, '[^0-9]', '', 'g')), "
    "lambda n: length(n) >= 2))"
)
_NOUNS = (
    rf"list_distinct(list_transform(list_filter(regexp_extract_all(answer, "
    rf"'\p{{Lu}}\p{{L}}*(?:[{S.WS}]+\p{{Lu}}\p{{L}}*){{0,3}}'), lambda r: length(r) >= 2), "
    "lambda r: lower(r)))"
)


@query(
    "answer_signals",
    f"WITH {_ANS} SELECT answer_id, len({S.content_tokens('answer')})::INT AS tokens, "
    f"len({_NUMBERS.format(e='answer')})::INT AS numbers, len({_NOUNS})::INT AS proper_nouns, "
    f"{_ABSTAINS} AS abstains, false AS points FROM ans",
)
def answer_signals(spark: SparkSession, sf: str) -> DataFrame:
    """V1, V2, V3, V10, V19 per answer (the sample has no Vietnamese pointer phrases)."""
    return answers(spark, sf).select(
        "answer_id",
        F.size(T.content_tokens("answer")).alias("tokens"),
        F.size(T.numbers("answer")).alias("numbers"),
        F.size(T.proper_nouns("answer")).alias("proper_nouns"),
        G.is_abstention("answer").alias("abstains"),
        G.is_pointer_answer("answer").alias("points"),
    )


_LEX = (
    f"{_ANS}, lex AS (SELECT a.answer_id, answer, atok, n, CASE WHEN len(atok) = 0 THEN 1.0::DOUBLE "
    "ELSE " + S.js_round("len(list_intersect(atok, coalesce(allt, [])))::DOUBLE / len(atok)")
    + f" END AS ratio FROM (SELECT answer_id, answer, {S.content_tokens('answer')} AS atok FROM ans)"
    " a LEFT JOIN (SELECT answer_id, list_distinct(flatten(list(ctok))) AS allt, count(*) AS n "
    "FROM ctx GROUP BY 1) c USING (answer_id))"
)


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    rows = grounding.over_context(
        answers(spark, sf).withColumn("tok", T.content_tokens("answer")), shared(spark, sf),
        {"_found": grounding.found_in("tokens", "tok"), "n_chunks": grounding.N_CHUNKS},
    )
    return rows.withColumn("ratio", G.lexical_grounding_ratio(F.col("tok"), F.col("_found")))


@query("lexical_grounding", f"WITH {_LEX} SELECT answer_id, ratio FROM lex")
def lexical_grounding(spark: SparkSession, sf: str) -> DataFrame:
    return lexical(spark, sf).select("answer_id", "ratio")


@query(
    "generation_status",
    f"WITH {_LEX} SELECT answer_id, CASE WHEN {_ABSTAINS} OR coalesce(n, 0) = 0 "
    "THEN 'INSUFFICIENT_EVIDENCE' WHEN len(atok) % 7 = 0 THEN 'PARTIALLY_GROUNDED' "
    "WHEN len(atok) >= 5 AND ratio < 0.4 THEN 'PARTIALLY_GROUNDED' ELSE 'GROUNDED' END AS status, "
    f"CASE WHEN {_ABSTAINS} THEN 'answer_is_abstention' WHEN coalesce(n, 0) = 0 THEN "
    "'grounded_but_no_citation' WHEN len(atok) % 7 = 0 THEN 'llm_self_report_ungrounded' "
    "WHEN len(atok) >= 5 AND ratio < 0.4 THEN 'low_lexical_grounding' END AS reason, "
    f"NOT {_ABSTAINS} AND coalesce(n, 0) > 0 AND len(atok) % 7 <> 0 AND len(atok) >= 5 "
    "AND ratio < 0.4 AS regenerate FROM lex",
)
def generation_status(spark: SparkSession, sf: str) -> DataFrame:
    """V5: every answer claims to be grounded; one in seven token counts reports otherwise."""
    rows = lexical(spark, sf)
    verdict = G.generation_status(
        F.col("status"), F.col("answer"), F.col("n_chunks"), F.size("tok") % 7 != 0,
        F.col("ratio"), F.size("tok"),
    )
    return rows.select("answer_id", verdict.alias("v")).select(
        "answer_id", "v.status", "v.reason", "v.regenerate"
    )


def evidence(
    spark: SparkSession, sf: str, seen: grounding.SharedContext | None = None
) -> DataFrame:
    return grounding.match_evidence(claims(spark, sf), seen or shared(spark, sf))


@query(
    "match_evidence",
    f"WITH {_EVIDENCE} SELECT answer_id, claim_id, supported, evidence_score, "
    "CASE WHEN supported THEN array_to_string(ev, ',') ELSE '' END AS evidence FROM evidence",
)
def match_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return evidence(spark, sf).select(
        "answer_id", "claim_id", "supported", "evidence_score",
        F.array_join("evidence", ",").alias("evidence"),
    )


@query(
    "build_citations",
    f"WITH {_EVIDENCE}, r AS (SELECT answer_id, claim_id, unnest(CASE WHEN supported AND len(ev) > 0"
    " THEN ev ELSE [NULL] END) AS chunk_id FROM evidence) SELECT answer_id, claim_id, chunk_id, "
    "string_split(chunk_id, '-')[1] AS doc_id, chunk_id IS NOT NULL AS valid FROM r",
)
def build_citations(spark: SparkSession, sf: str) -> DataFrame:
    seen = shared(spark, sf)
    out = grounding.build_citations(evidence(spark, sf, seen), seen)
    return out.select("answer_id", "claim_id", "chunk_id", "doc_id", "valid")


@query(
    "baseline_citations",
    f"WITH {_ANS} SELECT a.answer_id, c.chunk_id, c.doc_id FROM ans a JOIN ctx c "
    "ON c.answer_id = a.answer_id AND (c.pos = 1 OR c.pos = 3)",
)
def baseline_citations(spark: SparkSession, sf: str) -> DataFrame:
    """V9: each answer names the first and third chunk of its context."""
    named = answers(spark, sf).withColumn("cited_indexes", F.array(F.lit(1), F.lit(3)))
    out = grounding.baseline_citations(named, shared(spark, sf, keep=False))
    return out.select("answer_id", "chunk_id", "doc_id")


@query(
    "citation_integrity",
    f"WITH {_ANS} SELECT answer_id, n::INT AS n, CASE WHEN n <= k THEN chunk_id END AS chunk_id, "
    "CASE WHEN k > 0 THEN doc_id END AS doc_id FROM (SELECT a.answer_id, n, "
    "a.conv_id || '-' || (n - 1) AS chunk_id, a.conv_id::VARCHAR AS doc_id, "
    "(SELECT count(*) FROM ctx c WHERE c.answer_id = a.answer_id) AS k "
    "FROM ans a, (SELECT unnest([1, 4, 9]) AS n))",
)
def citation_integrity(spark: SparkSession, sf: str) -> DataFrame:
    """Answers cite turns 0, 3 and 8; those outside the context lose their ids."""
    made = answers(spark, sf).select(
        "answer_id", F.explode(F.array(F.lit(1), F.lit(4), F.lit(9))).alias("n")
    )
    doc = F.substring_index("answer_id", "-", 1)
    made = made.select(
        "answer_id", "n",
        F.concat_ws("-", doc, (F.col("n") - 1).cast("string")).alias("chunk_id"),
        doc.alias("doc_id"),
    )
    return grounding.citation_integrity(made, shared(spark, sf, keep=False)).select(
        "answer_id", "n", "chunk_id", "doc_id"
    )


_NUM_CTX = (
    f"nctx AS (SELECT answer_id, list_distinct(flatten(list({_NUMBERS.format(e='content')}))) AS nn "
    "FROM ctx GROUP BY 1)"
)


@query(
    "numeric_provenance",
    f"WITH {_ANS}, {_NUM_CTX}, x AS (SELECT a.answer_id, {_NUMBERS.format(e='answer')} AS an, "
    "coalesce(nn, []) AS nn FROM ans a LEFT JOIN nctx USING (answer_id)) "
    "SELECT answer_id, len(an)::INT AS checked, "
    "len(list_filter(an, lambda x: NOT list_contains(nn, x)))::INT AS ungrounded, "
    "len(an) > 0 AND len(list_filter(an, lambda x: NOT list_contains(nn, x))) = 0 AS all_grounded "
    "FROM x",
)
def numeric_provenance(spark: SparkSession, sf: str) -> DataFrame:
    out = grounding.numeric_provenance(answers(spark, sf), shared(spark, sf))
    return out.select(
        "answer_id", "checked", F.size("ungrounded").alias("ungrounded"), "all_grounded"
    )


_RESCUE = (
    f"{_EVIDENCE}, {_NUM_CTX}, cn AS (SELECT e.*, {_NUMBERS.format(e='claim_text')} AS nums, "
    "coalesce(nn, []) AS nn FROM evidence e LEFT JOIN nctx USING (answer_id)), "
    "resc AS (SELECT *, NOT supported AND len(nums) > 0 AND NOT list_bool_and(list_transform(nums, "
    r"lambda n: regexp_matches(n, '^(19|20)[0-9]{2}\z'))) AND len(list_filter(nums, "
    "lambda x: NOT list_contains(nn, x))) = 0 AS rescued FROM cn)"
)


@query(
    "numeric_rescue",
    f"WITH {_RESCUE} SELECT answer_id, claim_id, supported OR rescued AS supported, rescued "
    "FROM resc",
)
def numeric_rescue(spark: SparkSession, sf: str) -> DataFrame:
    seen = shared(spark, sf)
    out = grounding.apply_numeric_provenance(evidence(spark, sf, seen), seen)
    return out.select("answer_id", "claim_id", "supported", "rescued")


# Figures before two words, as V14 reads them; number words are Vietnamese and absent here.
_UNIT_RE = rf"([0-9]+(?:[.,][0-9]+)?)[{S.WS}]+([a-zà-ỹ]+[{S.WS}]+[a-zà-ỹ]+)"
_CONFLICT = rf"""uc AS (SELECT answer_id, pos, chunk_id, ctok, unnest(regexp_extract_all(lower(content),
  '{_UNIT_RE}', 1)) AS num, unnest(regexp_extract_all(lower(content), '{_UNIT_RE}', 2)) AS unit
  FROM ctx),
clash AS (SELECT a.answer_id, a.pos AS pa, b.pos AS pb, a.chunk_id AS ca, b.chunk_id AS cb, a.unit
  FROM uc a JOIN uc b ON a.answer_id = b.answer_id AND a.unit = b.unit AND a.pos < b.pos
  WHERE len(list_intersect(a.ctok, b.ctok))::DOUBLE
    / (len(a.ctok) + len(b.ctok) - len(list_intersect(a.ctok, b.ctok))) >= 0.4
  GROUP BY ALL
  HAVING bool_and(replace(a.num, ',', '.')::DOUBLE <> replace(b.num, ',', '.')::DOUBLE)),
conflict AS (SELECT answer_id, arg_min(ca, pa * 1000 + pb) AS chunk_a,
  arg_min(cb, pa * 1000 + pb) AS chunk_b FROM clash GROUP BY 1)"""


@query(
    "context_conflicts",
    _on_restated(f"WITH {_ANS}, {_CONFLICT} SELECT answer_id, chunk_a, chunk_b FROM conflict"),
)
def context_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    seen = shared(spark, sf, rows=restated(spark, sf))
    return grounding.context_conflicts(seen).select("answer_id", "chunk_a", "chunk_b")


def faith(spark: SparkSession, sf: str) -> DataFrame:
    # Claims are matched once; the verdict tally and the answer table both read the result.
    seen = shared(spark, sf)
    matched = cut_lineage(evidence(spark, sf, seen))
    return grounding.faithfulness(answers(spark, sf), matched, seen)[1]


_CONTRA = rf"""contra AS (SELECT DISTINCT e.answer_id, e.claim_id FROM evidence e
  JOIN ctx c ON c.answer_id = e.answer_id AND list_contains(e.ev, c.chunk_id)
  JOIN (SELECT answer_id, claim_id, u AS unit, list(n) AS vs FROM (SELECT answer_id, claim_id,
    unnest(regexp_extract_all(lower(claim_text), '{_UNIT_RE}', 1)) AS n,
    unnest(regexp_extract_all(lower(claim_text), '{_UNIT_RE}', 2)) AS u FROM claims) GROUP BY ALL) cu
    ON cu.answer_id = e.answer_id AND cu.claim_id = e.claim_id
  JOIN (SELECT answer_id, chunk_id, unit, list(num) AS vs FROM uc GROUP BY ALL) xu
    ON xu.answer_id = c.answer_id AND xu.chunk_id = c.chunk_id AND xu.unit = cu.unit
  WHERE e.supported AND len(list_intersect(
    list_transform(cu.vs, lambda v: replace(v, ',', '.')::DOUBLE),
    list_transform(xu.vs, lambda v: replace(v, ',', '.')::DOUBLE))) = 0)"""
_FAITH = rf"""{_EVIDENCE}, {_CONFLICT}, {_CONTRA},
verd AS (SELECT e.*, CASE WHEN k.claim_id IS NOT NULL THEN 'CONTRADICTED' WHEN supported
  THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS verdict FROM evidence e
  LEFT JOIN contra k USING (answer_id, claim_id)),
tally AS (SELECT answer_id, count(*) AS total, count(*) FILTER (WHERE verdict = 'SUPPORTED') AS s,
  count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS k FROM verd GROUP BY 1),
faith AS (SELECT a.answer_id, a.answer, coalesce(total, 0) AS total, coalesce(s, 0) AS n_supported,
  coalesce(k, 0) AS n_contradicted, coalesce(n, 0) AS n_chunks, {_ABSTAINS} AS skipped,
  f.answer_id IS NOT NULL AS clash FROM ans a LEFT JOIN tally USING (answer_id)
  LEFT JOIN (SELECT answer_id, count(*) AS n FROM ctx GROUP BY 1) USING (answer_id)
  LEFT JOIN conflict f USING (answer_id)),
scored AS (SELECT *, CASE WHEN skipped THEN 1.0::DOUBLE WHEN total = 0 THEN 0.0::DOUBLE ELSE
  greatest(0.0::DOUBLE, least(1.0::DOUBLE, {S.js_round('(n_supported - n_contradicted * 2)::DOUBLE / total')}))
  END AS score FROM faith),
judged AS (SELECT *, skipped OR (total > 0 AND score >= 0.8 AND n_contradicted = 0 AND NOT clash)
  AS grounded FROM scored),
caused AS (SELECT *, CASE WHEN grounded THEN NULL WHEN total = 0 THEN 'GENERATION_HALLUCINATION'
  WHEN n_chunks = 0 THEN 'RETRIEVAL_FAILURE' WHEN clash THEN 'CONFLICTING_CONTEXT'
  WHEN n_contradicted > 0 OR n_supported < total * 0.5 THEN 'GENERATION_HALLUCINATION'
  ELSE 'MISSING_CONTEXT' END AS root_cause FROM judged)"""


@query(
    "faithfulness",
    f"WITH {_FAITH} SELECT answer_id, total, n_supported, n_contradicted, score, grounded, "
    "root_cause FROM caused",
)
def faithfulness(spark: SparkSession, sf: str) -> DataFrame:
    return faith(spark, sf).select(
        "answer_id", "total", "n_supported", "n_contradicted", "score", "grounded", "root_cause"
    )


@query(
    "faithfulness_of_restated",
    _on_restated(
        f"WITH {_FAITH} SELECT answer_id, total, n_supported, n_contradicted, score, grounded, "
        "root_cause FROM caused"
    ),
)
def faithfulness_of_restated(spark: SparkSession, sf: str) -> DataFrame:
    """V13 to V17 where contexts conflict and claims are contradicted by their own evidence."""
    rows = restated(spark, sf)
    seen = shared(spark, sf, rows=rows)
    matched = cut_lineage(grounding.match_evidence(claims(spark, sf, rows), seen))
    return grounding.faithfulness(answers(spark, sf, rows), matched, seen)[1].select(
        "answer_id", "total", "n_supported", "n_contradicted", "score", "grounded", "root_cause"
    )


_POINTING = (
    "CASE turn % 6 WHEN 1 THEN 'Thông tin được nêu tại Mục [' || turn || '].' "
    "WHEN 3 THEN 'Được quy định tại Điều 5: ' || (100 + turn) || ' tín chỉ.' ELSE text END"
)


@query(
    "pointer_answers",
    "SELECT conv_id || '-' || turn AS answer_id, turn % 6 = 1 AS points FROM conversations WHERE role = 'assistant'",
)
def pointer_answers(spark: SparkSession, sf: str) -> DataFrame:
    """V3: a third of the answers only point to a place, a third name a figure there, the others are as given."""
    rows = turns(spark, sf).where("role = 'assistant'").withColumn("answer", F.expr(_POINTING))
    return rows.select("answer_id", G.is_pointer_answer("answer").alias("points"))


@query(
    "verify_answers",
    f"WITH {_FAITH}, {_NUM_CTX}, cn AS (SELECT v.answer_id, v.claim_id, v.verdict, "
    f"{_NUMBERS.format(e='claim_text')} AS nums, coalesce(nn, []) AS nn FROM verd v "
    "LEFT JOIN nctx USING (answer_id)), vt AS (SELECT answer_id, count(*) AS t, "
    "count(*) FILTER (WHERE verdict = 'CONTRADICTED') AS k, count(*) FILTER (WHERE "
    "verdict = 'SUPPORTED' OR (verdict = 'UNSUPPORTED' AND len(nums) > 0 AND NOT "
    r"list_bool_and(list_transform(nums, lambda n: regexp_matches(n, '^(19|20)[0-9]{2}\z'))) "
    "AND len(list_filter(nums, lambda x: NOT list_contains(nn, x))) = 0)) AS s FROM cn GROUP BY 1)"
    " SELECT answer_id, CASE WHEN coalesce(t, 0) = 0 OR n_chunks = 0 THEN 'INSUFFICIENT_EVIDENCE' "
    "WHEN k > 0 OR coalesce(root_cause, '') = 'CONFLICTING_CONTEXT' THEN 'CONFLICTING_EVIDENCE' "
    "WHEN s = 0 THEN 'INSUFFICIENT_EVIDENCE' WHEN NOT grounded THEN 'PARTIALLY_GROUNDED' "
    "ELSE 'GROUNDED' END AS final_status, score FROM caused LEFT JOIN vt USING (answer_id)",
)
def verify_answers(spark: SparkSession, sf: str) -> DataFrame:
    """V6-V8, V12, V16, V18, V20 end to end."""
    rows, _, _ = grounding.verify_answers(
        answers(spark, sf), extracted(spark, sf), shared(spark, sf)
    )
    return rows.select("answer_id", "final_status", "score")


_VERIFIED = (
    f"{_FAITH}, {_NUM_CTX}, cn AS (SELECT *, verdict = 'UNSUPPORTED' AND len(nums) > 0 AND NOT "
    r"list_bool_and(list_transform(nums, lambda n: regexp_matches(n, '^(19|20)[0-9]{2}\z'))) "
    "AND len(list_filter(nums, lambda x: NOT list_contains(nn, x))) = 0 AS rescued FROM (SELECT v.*, "
    f"{_NUMBERS.format(e='claim_text')} AS nums, coalesce(nn, []) AS nn FROM verd v LEFT JOIN nctx USING (answer_id)))"
)


@query(
    "verified_claims",
    f"WITH {_VERIFIED} SELECT answer_id, claim_id, CASE WHEN rescued THEN 'SUPPORTED' ELSE verdict END AS verdict, "
    "rescued OR verdict = 'SUPPORTED' AS supported, rescued FROM cn",
)
def verified_claims(spark: SparkSession, sf: str) -> DataFrame:
    """The claims behind the final statuses."""
    _, checked, _ = grounding.verify_answers(
        answers(spark, sf), extracted(spark, sf), shared(spark, sf)
    )
    return checked.select("answer_id", "claim_id", "verdict", "supported", "rescued")


@query(
    "verified_citations",
    f"WITH {_VERIFIED}, r AS (SELECT answer_id, claim_id, unnest(CASE WHEN supported AND len(ev) > 0"
    " THEN ev ELSE [NULL] END) AS chunk_id FROM evidence), bk AS (SELECT * FROM (SELECT cn.answer_id, cn.claim_id, "
    "x.chunk_id, row_number() OVER (PARTITION BY cn.answer_id, cn.claim_id ORDER BY x.pos) AS k FROM cn JOIN (SELECT "
    f"answer_id, pos, chunk_id, {_NUMBERS.format(e='content')} AS xn FROM ctx) x ON x.answer_id = cn.answer_id "
    "AND list_has_any(nums, xn) WHERE rescued) WHERE k <= 3) SELECT answer_id, claim_id, chunk_id, "
    "string_split(chunk_id, '-')[1] AS doc_id, chunk_id IS NOT NULL AS valid FROM (SELECT answer_id, claim_id, chunk_id "
    "FROM r UNION ALL SELECT answer_id, claim_id, chunk_id FROM bk)",
)
def verified_citations(spark: SparkSession, sf: str) -> DataFrame:
    """The citations, with those of claims that their figures rescued."""
    _, _, cites = grounding.verify_answers(
        answers(spark, sf), extracted(spark, sf), shared(spark, sf)
    )
    return cites.select("answer_id", "claim_id", "chunk_id", "doc_id", "valid")
