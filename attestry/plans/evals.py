"""Registered queries over evaluation analytics (M).

Cases are assistant turns; three runs rank the turns before them in different ways (latest first,
earliest first, longest first); user turns are gold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as T
from attestry.operators import evaluation as E
from attestry.operators import grounding, retrieval
from attestry.plans import answers as A
from attestry.plans import search
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()
RUNS = ["recent", "oldest", "longest"]


def retrieved(spark: SparkSession, sf: str) -> DataFrame:
    ctx = A.context(spark, sf).select("answer_id", "pos", "chunk_id", F.length("content").alias("n"))
    by = W.partitionBy("answer_id")
    ranks = [
        F.row_number().over(by.orderBy(F.desc("pos"))),
        F.row_number().over(by.orderBy("pos")),
        F.row_number().over(by.orderBy(F.desc("n"), "pos")),
    ]
    runs = F.array(
        *[F.struct(F.lit(r).alias("run_id"), x.alias("rank")) for r, x in zip(RUNS, ranks)]
    )
    return ctx.select(
        F.col("answer_id").alias("case_id"), F.col("chunk_id").alias("item"), runs.alias("r")
    ).select("case_id", "item", F.explode("r").alias("r")).select("case_id", "item", "r.*")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    return A.context(spark, sf).where("role = 'user'").select(
        F.col("answer_id").alias("case_id"), F.col("chunk_id").alias("item")
    )


def run_cases(spark: SparkSession, sf: str) -> DataFrame:
    runs = F.explode(F.array(*[F.lit(r) for r in RUNS]))
    return A.answers(spark, sf).select(F.col("answer_id").alias("case_id"), runs.alias("run_id"))


def case_retrieval(spark: SparkSession, sf: str) -> DataFrame:
    return E.retrieval_metrics(
        run_cases(spark, sf), retrieved(spark, sf), gold(spark, sf), ["run_id", "case_id"],
        ["case_id"],
    )


_RET = """ret AS (SELECT answer_id AS case_id, chunk_id AS item, 'recent' AS run_id,
  row_number() OVER (PARTITION BY answer_id ORDER BY pos DESC) AS rank FROM ctx UNION ALL
  SELECT answer_id, chunk_id, 'oldest', row_number() OVER (PARTITION BY answer_id ORDER BY pos)
  FROM ctx UNION ALL SELECT answer_id, chunk_id, 'longest', row_number() OVER (PARTITION BY
  answer_id ORDER BY length(content) DESC, pos) FROM ctx),
gold AS (SELECT answer_id AS case_id, chunk_id AS item FROM ctx WHERE crole = 'user'),
gn AS (SELECT case_id, count(*) AS g FROM gold GROUP BY 1),
hit AS (SELECT r.*, (o.item IS NOT NULL)::INT AS hit, sum((o.item IS NOT NULL)::INT) OVER
  (PARTITION BY run_id, r.case_id ORDER BY rank) AS seen FROM ret r LEFT JOIN gold o
  ON o.case_id = r.case_id AND o.item = r.item),
agg AS (SELECT run_id, case_id, count(*) FILTER (WHERE rank <= 5) AS n,
  count(*) FILTER (WHERE rank <= 5 AND hit = 1) AS h, sum(hit) AS al,
  min(rank) FILTER (WHERE hit = 1) AS f,
  sum(1 / log2(rank + 1)) FILTER (WHERE rank <= 5 AND hit = 1) AS dcg,
  sum(seen::DOUBLE / rank) FILTER (WHERE rank <= 5 AND hit = 1) AS pr FROM hit GROUP BY 1, 2),
cs AS (SELECT answer_id AS case_id, run_id FROM ans, (SELECT unnest(['recent', 'oldest', 'longest'])
  AS run_id)),
rm AS (SELECT run_id, case_id, coalesce(g, 0) AS gold_size, coalesce(al, 0) = coalesce(g, 0)
  AS all_gold, """ + ", ".join(
    f"{S.js_round(e)} AS {n}"
    for n, e in [
        ("recall_at_k", "CASE WHEN g IS NULL THEN 1 ELSE coalesce(h, 0)::DOUBLE / g END"),
        ("precision_at_k", "CASE WHEN coalesce(n, 0) = 0 THEN 0 ELSE h::DOUBLE / n END"),
        ("mrr", "coalesce(1.0::DOUBLE / f, 0)"),
        (
            "ndcg_at_k",
            "CASE WHEN g IS NULL THEN 1 ELSE coalesce(dcg, 0) / list_sum(list_transform("
            "range(1, least(g, 5) + 1), lambda i: 1 / log2(i + 1))) END",
        ),
        ("context_precision", "CASE WHEN coalesce(h, 0) = 0 THEN 0 ELSE pr / h END"),
        ("context_recall", "CASE WHEN g IS NULL THEN 1 ELSE coalesce(al, 0)::DOUBLE / g END"),
    ]
) + " FROM cs LEFT JOIN agg USING (run_id, case_id) LEFT JOIN gn USING (case_id))"


@query(
    "ir_metrics",
    f"WITH {A._ANS}, {_RET} SELECT run_id, case_id, gold_size, recall_at_k, precision_at_k, mrr, "
    "ndcg_at_k, context_precision, context_recall FROM rm",
)
def ir_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return case_retrieval(spark, sf).select(
        "run_id", "case_id", "gold_size", *E.RETRIEVAL_METRICS
    )


@query(
    "ir_metrics_by_label",
    f"WITH {search._query_cte()}, {search._vector_ctes('cosine', 20)}, "
    "h AS (SELECT query_id, rank, (e.label = query_id)::INT AS hit FROM hits JOIN embeddings e "
    "ON e.vec_id = chunk_id), g AS (SELECT label, count(*) AS g FROM embeddings GROUP BY 1) "
    "SELECT query_id AS label, any_value(g) AS gold_size, "
    + S.js_round("sum(hit) FILTER (WHERE rank <= 5)::DOUBLE / any_value(g)") + " AS recall_at_k, "
    + S.js_round("sum(hit) FILTER (WHERE rank <= 5)::DOUBLE / 5") + " AS precision_at_k, "
    + S.js_round("coalesce(1.0::DOUBLE / min(rank) FILTER (WHERE hit = 1), 0)") + " AS mrr "
    "FROM h JOIN g ON g.label = query_id GROUP BY query_id",
)
def ir_metrics_by_label(spark: SparkSession, sf: str) -> DataFrame:
    """M1-M3 over vector search: every vector of a label is gold for the label's mean vector."""
    x = search.vectors(spark, sf)
    hits = retrieval.vector_topk(search.label_queries(spark, sf), x, 20).select(
        F.col("query_id").alias("label"), "rank", F.col("chunk_id").alias("item")
    )
    truth = x.select("label", F.col("chunk_id").alias("item"))
    rows = E.retrieval_metrics(truth.select("label").distinct(), hits, truth, ["label"])
    return rows.select("label", "gold_size", "recall_at_k", "precision_at_k", "mrr")


# --- facts ---------------------------------------------------------------------------------------------
def sentences(spark: SparkSession, sf: str, back: int, out: str) -> DataFrame:
    """Every sentence of the turn ``back`` turns before an answer."""
    rows = A.turns(spark, sf)
    asked = rows.where("role = 'assistant'").select(
        F.col("answer_id").alias("case_id"), "conv_id", (F.col("turn") - back).alias("turn")
    )
    return asked.join(rows.select("conv_id", "turn", "text"), ["conv_id", "turn"]).select(
        "case_id", F.explode(T.split_sentences_by_line("text")).alias(out)
    )


def case_answers(spark: SparkSession, sf: str) -> DataFrame:
    return A.answers(spark, sf).select(F.col("answer_id").alias("case_id"), "answer")


def _strip(e: str) -> str:
    plain = rf"regexp_replace(nfc_normalize({e}), 'đ|Đ', 'd', 'g')"
    return S.trim(
        S.squeeze(rf"regexp_replace(lower(strip_accents({plain})), '[^a-z0-9%.,/{S.WS}\-]', ' ', 'g')")
    )


def _sentence_cte(back: int, p: str = "") -> str:
    return (
        f"{p}pt AS (SELECT a.answer_id AS case_id, a.answer, t.text FROM ans a JOIN turns t "
        f"ON t.conv_id = a.conv_id AND t.turn = a.turn - {back}), "
        rf"{p}pl AS (SELECT case_id, answer, unnest(string_split_regex(text, '\n+')) AS line FROM {p}pt), "
        f"{p}pp AS (SELECT case_id, answer, unnest(CASE WHEN regexp_matches({S.trim('line')}, '^#{{1,6}}[{S.WS}]') "
        f"THEN [{S.trim('line')}] ELSE string_split({A._SPLIT}, chr(1)) END) AS p FROM {p}pl), "
        f"{p}sn AS (SELECT case_id, {_strip('answer')} AS na, {_strip('p')} AS nf FROM {p}pp WHERE {S.trim('p')} <> ''), "
        f"{p}tk AS (SELECT *, list_filter(string_split_regex(nf, "
        rf"'[{S.WS}.,/\-]+'), lambda t: length(t) >= 2) AS ts FROM {p}sn)"
    )


_FACTS = (
    f"{_sentence_cte(1)}, facts AS (SELECT case_id, "
    + S.js_round(
        "avg(CASE WHEN nf = '' OR contains(na, nf) OR len(ts) = 0 OR len(list_filter(ts, "
        "lambda t: contains(na, t)))::DOUBLE / len(ts) >= 0.8 THEN 1.0::DOUBLE ELSE 0 END)"
    )
    + " AS required_fact_recall FROM tk GROUP BY 1)"
)


@query(
    "required_fact_recall",
    f"WITH {A._ANS}, {_FACTS} SELECT case_id, required_fact_recall FROM facts",
)
def required_fact_recall(spark: SparkSession, sf: str) -> DataFrame:
    """The sentences of the question are the required facts."""
    return E.required_fact_recall(
        case_answers(spark, sf), sentences(spark, sf, 1, "fact"), ["case_id"]
    )


_FORBIDDEN = (
    f"{_sentence_cte(2, 'f_')}, kp AS (SELECT *, list_filter(ts, lambda t: NOT "
    f"list_contains({S.text_list(E.fixed.FACT_STOP_WORDS)}, t)) AS ks FROM f_tk), forb AS (SELECT case_id, "
    + S.js_round(
        "avg(CASE WHEN nf <> '' AND (contains(na, nf) OR (len(ks) > 0 AND regexp_matches(na, "
        r"array_to_string(ks, '(?:\s+\S+){0,2}\s+')))) THEN 1.0::DOUBLE ELSE 0 END)"
    )
    + " AS forbidden_claim_rate FROM kp GROUP BY 1)"
)


@query(
    "forbidden_claim_rate",
    f"WITH {A._ANS}, {_FORBIDDEN} SELECT case_id, forbidden_claim_rate FROM forb",
)
def forbidden_claim_rate(spark: SparkSession, sf: str) -> DataFrame:
    """No sentence of the answer before may be repeated."""
    return E.forbidden_claim_rate(
        case_answers(spark, sf), sentences(spark, sf, 2, "claim"), ["case_id"]
    )


# --- whole runs -------------------------------------------------------------------------------------------
def scored(spark: SparkSession, sf: str) -> DataFrame:
    """M15 for the three runs. Answer-level work is done once and shared by the runs."""
    key = F.col("answer_id").alias("case_id")
    seen = A.shared(spark, sf)
    matched = cut_lineage(A.evidence(spark, sf, seen))
    claims = E.claim_metrics(matched.select(key, "supported", "verdict"), ["case_id"])
    cites = grounding.build_citations(matched, seen).select(
        key, F.col("chunk_id").alias("item"), "valid"
    )
    citations = E.citation_metrics(cites, gold(spark, sf), ["case_id"])
    facts = required_fact_recall(spark, sf).join(
        forbidden_claim_rate(spark, sf), "case_id", "full_outer"
    )
    lex = A.lexical(spark, sf).select(
        key, F.col("ratio").alias("correctness"), F.length("answer").alias("_len")
    )
    rate = F.col("claim_support_rate")
    status = (
        F.when(rate >= 0.5, "GROUNDED").when(rate > 0, "PARTIALLY_GROUNDED")
        .otherwise("INSUFFICIENT_EVIDENCE")
    )
    base = lex.join(claims, "case_id", "left").join(citations, "case_id", "left").join(
        facts, "case_id", "left"
    ).withColumn("status", status)
    base = cut_lineage(base)
    cases = case_retrieval(spark, sf).withColumn("answerable", F.col("gold_size") > 0)
    slow = F.when(F.col("run_id") == "oldest", F.lit(1.6)).otherwise(F.lit(1.0))
    keys = ["run_id", "case_id"]
    outcomes = run_cases(spark, sf).join(base, "case_id")
    return E.score_cases(
        cases.select(*keys, "answerable"), keys, cases.drop("answerable"),
        outcomes.select(
            *keys, "status", "correctness", (F.col("_len") * slow).alias("latency_ms"),
            (F.col("_len") * 1e-6).alias("cost"),
        ),
        outcomes.select(*keys, "claim_support_rate", "claim_hallucination_rate", "faithfulness"),
        outcomes.select(*keys, "citation_valid_rate", "citation_accuracy"),
        outcomes.select(*keys, "required_fact_recall"),
        outcomes.select(*keys, "forbidden_claim_rate"),
    )


_SCORED = f"""{A._EVIDENCE}, {_RET},
cm AS (SELECT answer_id AS case_id,
  {S.js_round("count(*) FILTER (WHERE supported)::DOUBLE / count(*)")} AS sr,
  {S.js_round("count(*) FILTER (WHERE NOT supported)::DOUBLE / count(*)")} AS hr,
  {S.js_round("count(*) FILTER (WHERE supported)::DOUBLE / count(*)")} AS fa
  FROM evidence GROUP BY 1),
ci AS (SELECT answer_id AS case_id, unnest(CASE WHEN supported AND len(ev) > 0 THEN ev
  ELSE [NULL] END) AS item FROM evidence),
cc AS (SELECT c.case_id, {S.js_round("avg((c.item IS NOT NULL)::INT)")} AS vr,
  coalesce({S.js_round("avg((g.item IS NOT NULL)::INT) FILTER (WHERE c.item IS NOT NULL)")}, 0) AS ca
  FROM ci c LEFT JOIN gold g ON g.case_id = c.case_id AND g.item = c.item GROUP BY 1),
{A._LEX[len(A._ANS) + 2:]},
{_FACTS}, {_FORBIDDEN},
sc AS (SELECT rm.*, gold_size > 0 AS answerable, lex.ratio AS correctness, sr, hr, fa, vr,
  CASE WHEN gold_size > 0 THEN coalesce(ca, 0) END AS ca, required_fact_recall AS rf, forbidden_claim_rate AS fo,
  CASE WHEN sr >= 0.5 THEN 'GROUNDED' WHEN sr > 0 THEN 'PARTIALLY_GROUNDED'
    ELSE 'INSUFFICIENT_EVIDENCE' END AS status,
  length(answer) * CASE WHEN run_id = 'oldest' THEN 1.6::DOUBLE ELSE 1 END AS latency_ms,
  length(answer) * 1e-6::DOUBLE AS cost
  FROM rm JOIN lex ON lex.answer_id = rm.case_id LEFT JOIN cm USING (case_id)
  LEFT JOIN cc USING (case_id) LEFT JOIN facts USING (case_id) LEFT JOIN forb USING (case_id)),
fl AS (SELECT *, status = 'INSUFFICIENT_EVIDENCE' AS declined, CASE
  WHEN NOT answerable THEN CASE WHEN status <> 'INSUFFICIENT_EVIDENCE'
    THEN 'GENERATION_HALLUCINATION' END
  WHEN NOT all_gold THEN 'RETRIEVAL_FAILURE'
  WHEN status = 'INSUFFICIENT_EVIDENCE' THEN 'MISSING_CONTEXT'
  WHEN correctness < 0.3 THEN 'GENERATION_HALLUCINATION'
  WHEN ca < 0.5 THEN 'CITATION_HALLUCINATION' END AS failure_layer FROM sc),
ps AS (SELECT *, answerable <> declined AS abstention_correct, answerable <> declined
  AND failure_layer IS NULL AND NOT (answerable AND coalesce(correctness < 0.5, false)) AS passed,
  CASE WHEN NOT answerable THEN NOT declined
       ELSE NOT declined AND coalesce(correctness < 0.3, false) END AS hallu FROM fl)"""


@query(
    "score_cases",
    f"WITH {_SCORED} SELECT run_id, case_id, status, recall_at_k, correctness, "
    "sr AS claim_support_rate, ca AS citation_accuracy, rf AS required_fact_recall, "
    "abstention_correct, failure_layer, passed FROM ps",
)
def score_cases(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf).select(
        "run_id", "case_id", "status", "recall_at_k", "correctness", "claim_support_rate",
        "citation_accuracy", "required_fact_recall", "abstention_correct", "failure_layer",
        "passed",
    )


_METRICS = [
    ("cases", "count(*)::DOUBLE"),
    ("unanswerableCount", "count(*) FILTER (WHERE NOT answerable)::DOUBLE"),
    ("retrievalEvaluated", "count(*) FILTER (WHERE gold_size > 0)::DOUBLE"),
    ("passRate", S.js_round("avg(passed::INT)")),
    *[
        (m, S.js_round(f"avg({c}) FILTER (WHERE gold_size > 0)"))
        for m, c in [
            ("recallAt5", "recall_at_k"), ("precisionAt5", "precision_at_k"), ("mrr", "mrr"),
            ("ndcgAt5", "ndcg_at_k"), ("contextPrecision", "context_precision"),
            ("contextRecall", "context_recall"),
        ]
    ],
    ("abstentionAccuracy", S.js_round("avg(abstention_correct::INT)")),
    ("answerCorrectness", S.js_round("avg(correctness) FILTER (WHERE answerable)")),
    ("citationAccuracy", S.js_round("avg(ca)")),
    ("faithfulness", S.js_round("avg(fa)")),
    ("claimLevelHallucinationRate", S.js_round("avg(hr)")),
    ("requiredFactRecall", S.js_round("avg(rf) FILTER (WHERE answerable)")),
    ("forbiddenClaimRate", S.js_round("avg(fo)")),
    ("hallucinationRateProxy", S.js_round("avg(hallu::INT)")),
    ("avgLatencyMs", "floor(avg(latency_ms) + 0.5)::DOUBLE"),
    ("totalCost", S.js_round("sum(cost)")),
]
_LONG = (
    f"{_SCORED}, rw AS (SELECT run_id, " + ", ".join(f'{e} AS "{m}"' for m, e in _METRICS)
    + " FROM ps GROUP BY run_id), ml AS (SELECT run_id, metric, value FROM (UNPIVOT rw ON "
    + ", ".join(f'"{m}"' for m, _ in _METRICS) + " INTO NAME metric VALUE value))"
)


def run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return E.to_long(E.aggregate_run(scored(spark, sf), ["run_id"]), ["run_id"])


@query(
    "aggregate_run",
    f"WITH {_LONG} SELECT run_id, metric, value FROM ml",
)
def aggregate_run(spark: SparkSession, sf: str) -> DataFrame:
    return run_metrics(spark, sf)


@query(
    "bootstrap_ci",
    f"WITH {A._ANS}, {_RET}, v AS (SELECT run_id, recall_at_k AS x, row_number() OVER (PARTITION BY "
    "run_id ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY run_id) AS n FROM rm), "
    "d0 AS (SELECT run_id, it, n, (20260829::HUGEINT + (it * n + i + 1)::HUGEINT * 1831565813) "
    "% 4294967296 AS a FROM v, range(0, 2000) r(it)), "
    "d1 AS (SELECT *, xor(a::BIGINT, a::BIGINT >> 15)::HUGEINT * (a::BIGINT | 1) % 4294967296 AS t "
    "FROM d0), d2 AS (SELECT *, xor(((t + xor(t::BIGINT, t::BIGINT >> 7)::HUGEINT * "
    "(t::BIGINT | 61) % 4294967296) % 4294967296)::BIGINT, t::BIGINT) AS u FROM d1), "
    "d3 AS (SELECT run_id, it, floor(xor(u, u >> 14)::DOUBLE / 4294967296.0 * n)::BIGINT AS i "
    "FROM d2), ms AS (SELECT run_id, it, avg(x) AS m FROM d3 JOIN v USING (run_id, i) GROUP BY 1, 2),"
    " rk AS (SELECT run_id, m, row_number() OVER (PARTITION BY run_id ORDER BY m) AS p FROM ms), "
    "en AS (SELECT run_id, max(m) FILTER (WHERE p = 51) AS lo, max(m) FILTER (WHERE p = 1950) AS hi "
    "FROM rk GROUP BY 1) SELECT run_id, n, " + S.js_round("mean") + " AS mean, "
    + S.js_round("lo") + " AS low, " + S.js_round("hi") + " AS high FROM en JOIN (SELECT run_id, "
    "count(*) AS n, avg(x) AS mean FROM v GROUP BY 1) USING (run_id)",
)
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    """Recall of the cases of each run, 2 000 resamples."""
    values = case_retrieval(spark, sf).select(
        "run_id", "case_id", F.col("recall_at_k").alias("value")
    )
    out = E.bootstrap_ci(values, ["run_id"], ["case_id"], seed=E.fixed.PASS_RATE_SEED)
    return out.select("run_id", "n", "mean", "low", "high")


@query(
    "compare_strategies",
    f"WITH {_LONG}, p AS (SELECT metric, max(value) FILTER (WHERE run_id = 'recent') AS recent, "
    "max(value) FILTER (WHERE run_id = 'oldest') AS oldest, "
    "max(value) FILTER (WHERE run_id = 'longest') AS longest FROM ml GROUP BY 1) "
    "SELECT *, CASE WHEN metric IN ('avgLatencyMs', 'totalCost') THEN CASE "
    "WHEN recent <= oldest AND recent <= longest THEN 'recent' WHEN oldest <= longest THEN 'oldest' "
    "ELSE 'longest' END ELSE CASE WHEN recent >= oldest AND recent >= longest THEN 'recent' "
    "WHEN oldest >= longest THEN 'oldest' ELSE 'longest' END END AS best FROM p",
)
def compare_strategies(spark: SparkSession, sf: str) -> DataFrame:
    return E.compare_strategies(run_metrics(spark, sf), "run_id", RUNS)


@query(
    "compare_variants",
    f"WITH {_LONG} SELECT metric, b.value AS before, a.value AS after, "
    + S.js_round("a.value - b.value")
    + " AS delta FROM (SELECT * FROM ml WHERE run_id = 'recent') b JOIN "
    "(SELECT * FROM ml WHERE run_id = 'longest') a USING (metric)",
)
def compare_variants(spark: SparkSession, sf: str) -> DataFrame:
    long = cut_lineage(run_metrics(spark, sf))
    return E.compare_variants(long.where("run_id = 'recent'"), long.where("run_id = 'longest'"))


@query(
    "regression_gate",
    f"WITH {_LONG}, d AS (SELECT c.run_id, metric, b.value AS base, c.value AS cur, "
    + S.js_round("c.value - b.value")
    + " AS delta FROM ml c JOIN (SELECT metric, value FROM ml WHERE run_id = 'recent') b "
    "USING (metric) WHERE c.run_id <> 'recent'), r AS (SELECT run_id, metric, CASE "
    "WHEN metric IN ('recallAt5', 'faithfulness', 'contextPrecision') AND delta < -0.05 "
    "THEN 'drop>0.05' WHEN metric = 'hallucinationRateProxy' AND delta > 0.03 THEN 'rise>0.03' "
    "WHEN metric = 'avgLatencyMs' AND base > 0 AND cur > base * 1.5 THEN 'times>1.5' END AS reason "
    "FROM d) SELECT run_id, count(reason) > 0 AS regressed, coalesce(string_agg(metric || ' ' || "
    "reason, '; ' ORDER BY metric || ' ' || reason) FILTER (WHERE reason IS NOT NULL), '') AS reasons "
    "FROM r GROUP BY run_id",
)
def regression_gate(spark: SparkSession, sf: str) -> DataFrame:
    """The other runs against the first one."""
    long = cut_lineage(run_metrics(spark, sf))
    current = long.where("run_id <> 'recent'")
    names = current.select("run_id").distinct()
    base = long.where("run_id = 'recent'").select("metric", "value")
    baseline = names.join(F.broadcast(base))  # two runs by a fixed list of metrics
    return E.regression_gate(current, baseline, ["run_id"])


@query(
    "provider_tradeoff",
    f"WITH {_LONG}, w AS (SELECT run_id, max(value) FILTER (WHERE metric = 'faithfulness') AS f, "
    "max(value) FILTER (WHERE metric = 'answerCorrectness') AS c, "
    "max(value) FILTER (WHERE metric = 'citationAccuracy') AS a, "
    "max(value) FILTER (WHERE metric = 'avgLatencyMs') AS l FROM ml GROUP BY 1), "
    "q AS (SELECT run_id, l, "
    + S.js_round("coalesce(f, 0) * 0.4::DOUBLE + coalesce(c, 0) * 0.4::DOUBLE + coalesce(a, 0) * 0.2::DOUBLE")
    + " AS quality_score FROM w) SELECT run_id, quality_score, CASE WHEN quality_score >= 0.85 AND "
    "l < 1000 THEN 'EXCELLENT' WHEN quality_score >= 0.85 THEN 'HIGH_QUALITY' WHEN l < 500 "
    "THEN 'FAST' ELSE 'NEEDS_TUNING' END AS assessment FROM q",
)
def provider_tradeoff(spark: SparkSession, sf: str) -> DataFrame:
    wide = E.aggregate_run(scored(spark, sf), ["run_id"])
    return E.provider_tradeoff(wide).select("run_id", "quality_score", "assessment")


@query(
    "compare_models",
    "WITH l AS (SELECT l_returnflag AS dataset, l_linestatus AS model, "
    "round(avg(l_quantity), 4) AS mrr, round(avg(l_tax) * 1000, 4) AS \"avgLatencyMs\" "
    "FROM lineitem GROUP BY 1, 2), u AS (SELECT dataset, model, metric, value FROM "
    "(UNPIVOT l ON mrr, \"avgLatencyMs\" INTO NAME metric VALUE value)), p AS (SELECT dataset, metric,"
    " max(value) FILTER (WHERE model = 'F') AS \"F\", max(value) FILTER (WHERE model = 'O') AS \"O\" "
    "FROM u GROUP BY 1, 2) SELECT *, CASE WHEN \"O\" IS NULL THEN 'F' WHEN \"F\" IS NULL THEN 'O' "
    "WHEN metric = 'mrr' AND \"F\" >= \"O\" THEN 'F' WHEN metric <> 'mrr' AND \"F\" <= \"O\" THEN 'F' "
    "ELSE 'O' END AS best FROM p",
)
def compare_models(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as measurements, return flag = dataset, line status = model."""
    rows = src.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("dataset"), F.col("l_linestatus").alias("model")
    ).agg(
        F.round(F.avg("l_quantity"), 4).alias("mrr"),
        F.round(F.avg("l_tax") * 1000, 4).alias("avgLatencyMs"),
    )
    return E.compare_models(E.to_long(rows, ["dataset", "model"]), ["F", "O"])


def order_runs(spark: SparkSession, sf: str) -> DataFrame:
    return src.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("dataset"),
        F.col("o_orderdate").cast("timestamp").alias("created_at"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("RUNNING").alias("status"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_baseline"),
    )


@query(
    "latest_baseline",
    "SELECT o_custkey AS dataset, max_by(o_orderkey, (o_orderdate, o_orderkey)) AS baseline_run_id "
    "FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' GROUP BY 1",
)
def latest_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as runs, customers as datasets, urgent orders as past baselines."""
    return E.latest_baseline(order_runs(spark, sf))


@query(
    "set_baseline",
    "WITH c AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_totalprice > 200000 "
    "GROUP BY 1) SELECT o.o_orderkey AS run_id, CASE WHEN c.k IS NOT NULL THEN o.o_orderkey = c.k "
    "ELSE o.o_orderpriority = '1-URGENT' END AS is_baseline FROM orders o LEFT JOIN c USING (o_custkey)",
)
def set_baseline(spark: SparkSession, sf: str) -> DataFrame:
    """The newest large order of a customer replaces the earlier baselines."""
    chosen = src.table(spark, sf, "orders").where("o_totalprice > 200000").groupBy("o_custkey").agg(
        F.max("o_orderkey").alias("run_id")
    )
    return E.set_baseline(order_runs(spark, sf), chosen).select("run_id", "is_baseline")


# --- case files ----------------------------------------------------------------------------------------------
def text_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as evaluation cases: the last line is the answer, the lines before it (or the only one)
    the question, and every line a fact. One in five also has its length as a fact, which no text states."""
    docs = src.table(spark, sf, "documents")
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: x != "")
    last = F.greatest(F.size(lines) - 1, F.lit(1))
    length = F.concat(F.lit("length "), F.col("n_chars"))
    none = F.array().cast("array<string>")
    en = F.col("lang") == "en"
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.when(F.col("n_chars") % 11 == 0, "CONFLICTING_SOURCES").otherwise("FACT").alias("type"),
        F.array_join(F.slice(lines, F.lit(1), last), " ").alias("question"),
        en.alias("answerable"),
        F.when(F.col("n_chars") % 3 != 0, F.coalesce(F.get(lines, F.size(lines) - 1), F.lit("")))
        .alias("expectedAnswer"),
        F.when(F.col("n_chars") % 2 == 0, F.array("source")).otherwise(none)
        .alias("expectedDocuments"),
        none.alias("alternativeDocuments"),
        F.when(F.col("n_chars") % 10 == 0, F.array("source")).otherwise(none)
        .alias("distractorDocuments"),
        F.when(F.col("n_chars") % 5 == 0, F.array_append(lines, length)).otherwise(lines)
        .alias("requiredFacts"),
        none.alias("forbiddenClaims"),
        (F.col("n_chars") % 7 == 0).alias("shouldAbstain"),
        F.when(F.col("n_chars") % 4 == 0, "multi_hop").when(
            F.col("n_chars") % 4 == 1, "numerical_exact"
        ).alias("category"),
        F.col("lang").alias("language"),
        (F.col("n_chars") % 3).cast("int").alias("reasoningSteps"),
        F.lit(None).cast("string").alias("negativeType"),
        F.lit(None).cast("string").alias("expectedAction"),
        F.array(F.struct(F.lit("t").alias("title"), "source", "text")).alias("corpus"),
    )


_CASES = (
    "w AS (SELECT *, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: x <> '') AS ls FROM documents), "
    "tc AS (SELECT doc_id::VARCHAR AS id, lang, text, source, n_chars AS n, n_chars % 11 = 0 AS confl, "
    "array_to_string(ls[1:greatest(len(ls) - 1, 1)], ' ') AS question, lang = 'en' AS answerable, "
    "CASE WHEN n_chars % 3 <> 0 THEN coalesce(ls[-1], '') END AS ea, (n_chars % 2 = 0)::INT AS g, "
    "CASE WHEN n_chars % 5 = 0 THEN list_append(ls, 'length ' || n_chars) ELSE ls END AS facts, CASE "
    "WHEN n_chars % 4 = 0 THEN 'multi_hop' WHEN n_chars % 4 = 1 THEN 'numerical_exact' END AS cat FROM w), "
    f"tn AS (SELECT *, {_strip('question')} AS nq, {_strip('coalesce(ea, chr(32))')} AS ne FROM tc)"
)
_RULES = [
    ("ERROR", "ANSWERABLE_MISMATCH", "answerable <> (ea IS NOT NULL)"),
    ("ERROR", "ANSWERABLE_ABSTAINS", "answerable AND n % 7 = 0"),
    ("ERROR", "GOLD_IS_DISTRACTOR", "g = 1 AND n % 10 = 0"),
    ("ERROR", "ANSWER_LEAKAGE", "length(ea) > 12 AND contains(nq, ne)"),
    ("WARNING", "NO_CATEGORY", "cat IS NULL"),
    ("ERROR", "NEGATIVE_WITH_GOLD", "NOT answerable AND g > 0"),
    ("WARNING", "NEGATIVE_WITHOUT_TYPE", "NOT answerable"),
    ("ERROR", "ANSWERABLE_WITHOUT_GOLD", "answerable AND g = 0"),
    ("ERROR", "TOO_FEW_STEPS", "cat = 'multi_hop' AND n % 3 < 2"),
    ("WARNING", "MULTI_HOP_GOLD", "cat = 'multi_hop' AND g < 2"),
    ("ERROR", "CONFLICT_GOLD", "confl AND g < 2"),
]
_FACT_RULE = (
    f"SELECT DISTINCT id, 'WARNING', 'FACT_NOT_IN_GOLD' FROM (SELECT id, nt, {_strip('fact')} AS nf FROM (SELECT id, "
    f"{_strip('text')} AS nt, unnest(facts) AS fact FROM tc WHERE answerable AND cat = 'numerical_exact' AND g = 1 AND "
    rf"text <> '')) z WHERE NOT (nf = '' OR contains(nt, nf) OR len(list_filter(string_split_regex("
    rf"nf, '[{S.WS}.,/\-]+'), lambda t: length(t) >= 2)) = 0 OR len(list_filter(string_split_regex("
    rf"nf, '[{S.WS}.,/\-]+'), lambda t: length(t) >= 2 AND contains(nt, t)))::DOUBLE / "
    rf"len(list_filter(string_split_regex(nf, '[{S.WS}.,/\-]+'), lambda t: length(t) >= 2)) >= 0.8)"
)


@query(
    "validate_cases",
    f"WITH {_CASES} " + " UNION ALL ".join(
        f"SELECT id, '{s}' AS severity, '{r}' AS rule FROM tn WHERE {c}" for s, r, c in _RULES
    )
    + " UNION ALL SELECT id, 'ERROR', 'DUPLICATE_QUESTION' FROM (SELECT id, count(*) OVER "
    "(PARTITION BY nq) AS c FROM tn) WHERE c > 1 UNION ALL " + _FACT_RULE,
)
def validate_cases(spark: SparkSession, sf: str) -> DataFrame:
    return E.validate_cases(text_cases(spark, sf))


@query(
    "case_stats",
    f"WITH {_CASES} SELECT 'language' AS dimension, lang AS value, count(*) AS cases FROM tc "
    "GROUP BY 2 UNION ALL SELECT 'category', coalesce(cat, '(none)'), count(*) FROM tc GROUP BY 2 "
    "UNION ALL SELECT 'type', CASE WHEN confl THEN 'CONFLICTING_SOURCES' ELSE 'FACT' END, count(*) "
    "FROM tc GROUP BY 2 UNION ALL SELECT 'reasoningSteps', (n % 3)::VARCHAR, count(*) FROM tc "
    "GROUP BY 2 UNION ALL SELECT 'negativeType', '(none)', count(*) FROM tc",
)
def case_stats(spark: SparkSession, sf: str) -> DataFrame:
    return E.case_stats(
        text_cases(spark, sf), ["language", "category", "type", "reasoningSteps", "negativeType"]
    )


@query(
    "case_totals",
    f"WITH {_CASES} SELECT count(*) AS cases, count(*) FILTER (WHERE answerable) AS answerable, "
    "count(*) FILTER (WHERE n % 7 = 0) AS should_abstain, count(*) FILTER (WHERE n % 3 >= 2) "
    "AS multi_step, count(*) FILTER (WHERE n % 10 = 0) AS with_distractors, count(*) FILTER (WHERE len(facts) > 0) AS with_facts, "
    "0::BIGINT AS with_forbidden, 1.0::DOUBLE AS mean_gold FROM tc",
)
def case_totals(spark: SparkSession, sf: str) -> DataFrame:
    return E.case_totals(text_cases(spark, sf))


@query(
    "seed_corpus_map",
    "WITH c AS (SELECT DISTINCT source, text FROM documents), d AS (SELECT sha256(text) AS ck, "
    "min(doc_id) AS doc_id FROM documents WHERE lang <> 'es' GROUP BY 1) SELECT c.source, "
    "sha256(c.text) AS checksum, d.doc_id, d.doc_id IS NOT NULL AS ready FROM c LEFT JOIN d "
    "ON d.ck = sha256(c.text)",
)
def seed_corpus_map(spark: SparkSession, sf: str) -> DataFrame:
    """Spanish documents have not been completed yet."""
    from attestry.operators.dedupe import corpus_dedupe

    corpus = corpus_dedupe(text_cases(spark, sf))
    docs = src.table(spark, sf, "documents").select(
        "doc_id", F.sha2("text", 256).alias("checksum"),
        F.when(F.col("lang") == "es", "FAILED").otherwise("COMPLETED").alias("status"),
    )
    return E.seed_corpus_map(corpus, docs)


@query(
    "duplicate_questions",
    f"WITH {_CASES} SELECT id, copies FROM (SELECT id, count(*) OVER (PARTITION BY nq) AS copies "
    "FROM tn) WHERE copies > 1",
)
def duplicate_questions(spark: SparkSession, sf: str) -> DataFrame:
    from attestry.operators import dedupe

    return dedupe.duplicate_questions(text_cases(spark, sf)).select("id", "copies")
