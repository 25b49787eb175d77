"""Registered queries over agent traces and costs (A, U).

A user's events in time order are cut into runs of 20 steps. Clicks and views are tool calls,
purchases and errors tool results, sign-ups thoughts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import text as T
from attestry.operators import agents as A
from attestry.operators import costs as U
from attestry.plans import sql as S
from attestry.plans.registry import registry
from attestry.session import cut_lineage, rank_within
from attestry.sources import documents as src

QUERIES, ORACLES, query = registry()

RUN_STEPS = 20
CODES = list(fixed.TOOL_ERROR_CLASS) + ["OTHER"]
STOPS = ["final", "budget_steps", "error", "no_progress", "tool_failure_threshold", "cancelled",
         "budget_wall_clock"]
CATEGORIES = ["basic", "rag", "tool-args", "failure-recovery", "adversarial", "other"]
STATUS = {"purchase": "GROUNDED", "click": "PARTIALLY_GROUNDED", "view": "INSUFFICIENT_EVIDENCE",
          "signup": "CONFLICTING_EVIDENCE"}


def _pick(values: list[str], i):
    return F.get(T.literal_array(values), i)


def steps(spark: SparkSession, sf: str) -> DataFrame:
    """Step table. Users are ranked by slices, so a very busy user is no single task."""
    events = src.table(spark, sf, "events")
    rows = rank_within(
        events.select("event_id", "ts", "user_id", "event_type", "value", "props"),
        ["user_id"], ["ts", "event_id"], "rn",
    )
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    call = kind.isin("click", "view")
    result = kind.isin("purchase", "error")
    return rows.select(
        F.concat_ws("-", "user_id", F.floor((F.col("rn") - 1) / RUN_STEPS)).alias("run_id"),
        F.pmod(F.col("rn") - 1, F.lit(RUN_STEPS)).cast("int").alias("idx"),
        "user_id", "event_type", k.alias("k"), "ts",
        F.when(call, "TOOL_CALL").when(result, "TOOL_RESULT").otherwise("THINK").alias("type"),
        F.when(call, F.concat(F.lit("shop__"), kind)).when(result, "shop__buy").alias("tool_name"),
        F.when(
            call,
            F.format_string('{"q": "look item %d", "k": %d}', F.floor(k / 25).cast("int"), k),
        ).alias("tool_input"),
        F.when(kind == "error", "failed").alias("error"),
        F.when(kind == "error", _pick(CODES, k % 14)).alias("error_code"),
        F.round(F.col("value") * 100).alias("latency_ms"),
        F.round(F.col("value") * 100).cast("long").alias("tokens"),
        (F.round(F.col("value") * 100) * 1e-6).alias("cost"),
    )


def _last(c):
    return F.max_by(c, "idx")


def runs(step_rows: DataFrame) -> DataFrame:
    """Run table with outcome and expectation, derived from the run's steps."""
    bought = F.col("event_type") == "purchase"
    share = lambda limit: F.avg(
        F.when(bought, (F.col("k") < limit).cast("double"))
    )
    last_k = _last("k")
    status = F.lit(None).cast("string")
    for kind, name in STATUS.items():
        status = F.when(_last("event_type") == kind, name).otherwise(status)
    rows = step_rows.groupBy("run_id", "user_id").agg(
        status.alias("final_status"),
        _pick(STOPS, last_k % 7).alias("stop_reason"),
        (last_k % 2 == 0).alias("loop_blocked"),
        F.when(last_k % 3 == 0, "tool_choice rejected").alias("error_message"),
        F.concat(F.lit("k="), last_k.cast("string")).alias("answer"),
        (last_k / 100).alias("correctness"),
        # the events carry no time zone, so the session's zone must not matter
        F.min(F.expr("timestampdiff(MILLISECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"))
        .cast("double")
        .alias("started_ms"),
        F.count_if(F.col("k") < 80).alias("format_valid"),
        F.count(F.lit(1)).alias("format_total"),
        F.count_if(bought).alias("claims"),
        F.count_if(bought).alias("evidence_count"),
        T.js_round(share(50)).alias("claim_support_rate"),
        T.js_round(share(50)).alias("faithfulness"),
        T.js_round(1 - share(50)).alias("claim_hallucination_rate"),
        T.js_round(share(80)).alias("citation_valid_rate"),
        T.js_round(share(60)).alias("citation_accuracy"),
        F.sum("tokens").alias("tokens"),
    )
    u = F.col("user_id")
    none = F.array().cast("array<string>")
    constraint = "array<struct<path:string,matches:string,oneOf:array<string>,required:boolean>>"
    rules = F.expr(
        "map('shop.click', array("
        "named_struct('path', 'k', 'matches', '^[0-6]', 'oneOf', cast(null as array<string>), "
        "'required', true), "
        "named_struct('path', 'q', 'matches', cast(null as string), 'oneOf', "
        "array('look item 1', 'look item 2'), 'required', false)))"
    ).cast(f"map<string,{constraint}>")
    return rows.withColumns(
        {
            "category": _pick(CATEGORIES, (u % 6).cast("int")),
            "expected_tools": F.when(u % 2 == 0, T.literal_array(["shop.click", "shop.view"]))
            .otherwise(T.literal_array(["shop.click"])),
            "forbidden_tools": F.when(u % 5 == 0, T.literal_array(["shop.view"])).otherwise(none),
            "must_abstain": u % 7 == 0,
            "min_steps": F.lit(5),
            "max_steps": F.lit(18),
            "max_tool_calls": F.lit(9),
            "answer_must_not_contain": F.array(F.lit("K=1")),
            "expected_answer": F.when(u % 3 != 0, "x"),
            "argument_constraints": F.when(F.col("category") == "tool-args", rules),
        }
    )


def view(spark: SparkSession, sf: str) -> DataFrame:
    rows = steps(spark, sf)
    return A.trajectory_view(runs(rows), rows)


_STEPS = (
    "ev AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS rn, "
    "json_extract_string(props, '$.k')::INT AS k FROM events), "
    f"st AS (SELECT user_id || '-' || (rn // {RUN_STEPS}) AS run_id, (rn % {RUN_STEPS})::INT AS idx, "
    "user_id, event_type, k, ts, CASE WHEN event_type IN ('click', 'view') THEN 'TOOL_CALL' "
    "WHEN event_type IN ('purchase', 'error') THEN 'TOOL_RESULT' ELSE 'THINK' END AS type, "
    "CASE WHEN event_type IN ('click', 'view') THEN 'shop.' || event_type WHEN event_type IN "
    "('purchase', 'error') THEN 'shop.buy' END AS tool, "
    f"CASE WHEN event_type = 'error' THEN {S.text_list(CODES)}[k % 14 + 1] END AS error_code, "
    "round(value * 100) AS ms FROM ev)"
)
_SHARE = "avg((k < {n})::INT) FILTER (WHERE event_type = 'purchase')"
_CODE_MAP = (
    "CASE {c} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in fixed.TOOL_ERROR_CLASS.items())
    + " ELSE 'UNKNOWN_ERROR' END"
)
_VIEW = (
    f"{_STEPS}, r0 AS (SELECT run_id, user_id, arg_max(event_type, idx) AS le, arg_max(k, idx) AS lk, "
    "min(epoch_us(ts) // 1000) AS t0, count(*) FILTER (WHERE k < 80) AS fv, count(*) AS n, "
    "count(*) FILTER (WHERE event_type = 'purchase') AS bought, "
    f"{S.js_round(_SHARE.format(n=50))} AS sup, {S.js_round('1 - ' + _SHARE.format(n=50))} AS hal, "
    f"{S.js_round(_SHARE.format(n=80))} AS cv, {S.js_round(_SHARE.format(n=60))} AS ca, "
    "sum(ms) AS ms, "
    "coalesce(list(tool ORDER BY idx) FILTER (WHERE type = 'TOOL_CALL'), []) AS req, "
    "coalesce(list(tool ORDER BY idx) FILTER (WHERE event_type = 'purchase'), []) AS suc, "
    "coalesce(list(error_code ORDER BY idx) FILTER (WHERE error_code IS NOT NULL), []) AS codes "
    "FROM st GROUP BY 1, 2), "
    "r1 AS (SELECT *, CASE le WHEN 'purchase' THEN 'GROUNDED' WHEN 'click' THEN 'PARTIALLY_GROUNDED' "
    "WHEN 'view' THEN 'INSUFFICIENT_EVIDENCE' WHEN 'signup' THEN 'CONFLICTING_EVIDENCE' END AS fs, "
    f"{S.text_list(STOPS)}[lk % 7 + 1] AS stop, list_filter(codes, lambda c: c <> 'LOOP_BLOCKED') "
    f"AS realc, {S.text_list(CATEGORIES)}[user_id % 6 + 1] AS category, CASE WHEN user_id % 2 = 0 THEN "
    "['shop.click', 'shop.view'] ELSE ['shop.click'] END AS exp, user_id % 7 = 0 AS must, "
    "user_id % 5 = 0 AND list_contains(req, 'shop.view') AS forb, list_distinct(req) AS ureq FROM r0), "
    "vw AS (SELECT *, coalesce(fs = 'INSUFFICIENT_EVIDENCE', false) AS dec, "
    "len(codes) > 0 AND coalesce(fs IN ('GROUNDED', 'PARTIALLY_GROUNDED'), false) AS recovered, "
    "CASE WHEN stop = 'error' THEN CASE WHEN lk % 3 = 0 THEN 'AGENT_DECISION_ERROR' ELSE 'LLM_ERROR' END "
    "WHEN stop = 'cancelled' THEN NULL "
    "WHEN (stop LIKE 'budget%' OR stop = 'no_progress') AND len(realc) > 0 THEN "
    + _CODE_MAP.format(c="realc[-1]")
    + " WHEN (stop LIKE 'budget%' OR stop = 'no_progress') AND (lk % 2 = 0 OR stop = 'no_progress') "
    "THEN 'LOOP_ERROR' WHEN stop = 'budget_wall_clock' THEN 'TIMEOUT_ERROR' WHEN stop LIKE 'budget%' "
    "THEN 'BUDGET_EXHAUSTED' WHEN stop = 'tool_failure_threshold' AND len(codes) > 0 THEN "
    + _CODE_MAP.format(c="codes[-1]")
    + " WHEN fs = 'INSUFFICIENT_EVIDENCE' AND len(realc) > 0 THEN "
    + _CODE_MAP.format(c="realc[-1]")
    + " WHEN fs = 'CONFLICTING_EVIDENCE' THEN 'RAG_GROUNDEDNESS_ERROR' END AS fclass, "
    "CASE WHEN stop = 'cancelled' THEN 'CANCELLED' WHEN stop = 'error' THEN 'FAILED' WHEN "
    "fs = 'INSUFFICIENT_EVIDENCE' THEN 'ABSTAINED' ELSE 'COMPLETED' END AS rstatus, "
    "len(list_intersect(ureq, exp)) AS hit FROM r1), "
    "pr AS (SELECT *, CASE WHEN len(ureq) = 0 THEN 1.0::DOUBLE ELSE hit::DOUBLE / len(ureq) END AS p, "
    "hit::DOUBLE / len(exp) AS r, CASE WHEN hit = 0 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * hit / "
    "(len(ureq) + len(exp)) END AS f1, least(1.0::DOUBLE, 5.0::DOUBLE / n) AS eff, "
    "fv::DOUBLE / n AS fmt FROM vw)"
)


@query(
    "trajectory_view",
    f"WITH {_VIEW} SELECT run_id, array_to_string(req, ',') AS requested, "
    "array_to_string(suc, ',') AS succeeded, array_to_string(codes, ',') AS codes, "
    "n::INT AS step_count, len(req)::INT AS tool_call_count, ms AS latency_ms, recovered, "
    "fclass AS failure_class, rstatus AS run_status FROM vw",
)
def trajectory_view(spark: SparkSession, sf: str) -> DataFrame:
    """A1, A19, A25."""
    join = lambda c: F.array_join(c, ",")
    return view(spark, sf).select(
        "run_id", join("tools_requested").alias("requested"),
        join("tools_succeeded").alias("succeeded"), join("error_codes").alias("codes"),
        "step_count", "tool_call_count", "latency_ms", "recovered", "failure_class", "run_status",
    )


@query(
    "score_agent_case",
    f"WITH {_VIEW} SELECT run_id, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, "
    "dec = must AND NOT forb AND fmt >= 0.8 AS case_pass, round(0.35::DOUBLE * f1 + 0.2::DOUBLE * "
    "(dec = must)::INT + 0.15::DOUBLE * (NOT forb)::INT + 0.15::DOUBLE * eff + 0.15::DOUBLE * fmt, 6) "
    "AS case_score, array_to_string(list_filter([CASE WHEN forb THEN 'FORBIDDEN_TOOL' END, "
    "CASE WHEN dec <> must AND must THEN 'SHOULD_ABSTAIN' END, CASE WHEN dec <> must AND NOT must "
    "THEN 'WRONG_ABSTENTION' END, CASE WHEN fmt < 0.8 THEN 'LOW_FORMAT_VALIDITY' END, "
    "CASE WHEN f1 < 0.5 THEN 'LOW_TOOL_F1' END], lambda x: x IS NOT NULL), ',') AS reasons FROM pr",
)
def score_agent_case(spark: SparkSession, sf: str) -> DataFrame:
    """A2-A5."""
    prf = A.tool_prf(F.col("tools_requested"), F.col("expected_tools"))
    rows = A.score_agent_case(view(spark, sf)).withColumn("prf", prf)
    return rows.select(
        "run_id", F.round("prf.precision", 6).alias("precision"),
        F.round("prf.recall", 6).alias("recall"), F.round("prf.f1", 6).alias("f1"), "case_pass",
        F.round("case_score", 6).alias("case_score"),
        F.array_join("case_reasons", ",").alias("reasons"),
    )


def evaluated(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(view, long evaluator table), the view computed once."""
    rows = cut_lineage(view(spark, sf))
    return rows, A.evaluate_trajectories(rows, ["run_id", "category"])


_ARGS = (
    "ag AS (SELECT run_id, count(*) AS checked, count(*) FILTER (WHERE ok) AS good FROM ("
    "SELECT run_id, regexp_matches(k::VARCHAR, '^[0-6]') AS ok FROM st WHERE event_type = 'click' UNION ALL "
    "SELECT run_id, k // 25 IN (1, 2) FROM st WHERE event_type = 'click') GROUP BY 1)"
)
_EVALS = [
    ("answerCorrectness",
     "CASE WHEN user_id % 3 = 0 THEN 1.0::DOUBLE ELSE lk / 100.0::DOUBLE END",
     "CASE WHEN user_id % 3 <> 0 THEN lk >= 50 END"),
    ("toolSelection", "f1", "r >= 0.5"),
    ("toolArgument",
     "CASE WHEN category <> 'tool-args' THEN 1.0::DOUBLE ELSE coalesce(good::DOUBLE / checked, 0) END",
     "CASE WHEN category = 'tool-args' THEN coalesce(checked, 0) > 0 AND "
     "coalesce(good::DOUBLE / checked >= 0.99, false) END"),
    ("toolUsage", "CASE WHEN must THEN 1.0::DOUBLE ELSE (len(req) > 0)::INT END",
     "CASE WHEN NOT must THEN len(req) > 0 END"),
    ("groundedness", "CASE WHEN dec THEN 1.0::DOUBLE WHEN bought = 0 THEN 0 ELSE sup END",
     "CASE WHEN NOT dec THEN bought > 0 AND coalesce(sup >= 0.7, false) END"),
    ("citation",
     "CASE WHEN dec THEN 1.0::DOUBLE WHEN cv IS NULL THEN 0.5 ELSE (cv + coalesce(ca, 0)) / 2 END",
     "CASE WHEN NOT dec AND cv IS NOT NULL THEN cv >= 0.8 END"),
    ("hallucination", "CASE WHEN must THEN (NOT dec)::INT::DOUBLE ELSE coalesce(hal, 0) END",
     "CASE WHEN must THEN dec ELSE coalesce(hal, 0) <= 0.1 END"),
    ("efficiency", "eff", "n <= 18 AND len(req) <= 9"),
    ("recovery", "CASE WHEN len(codes) = 0 THEN 1.0::DOUBLE ELSE (recovered OR dec)::INT END",
     "CASE WHEN len(codes) > 0 THEN recovered OR dec END"),
    ("safety", "(NOT forb AND NOT contains('k=' || lk, 'k=1'))::INT::DOUBLE",
     "NOT forb AND NOT contains('k=' || lk, 'k=1')"),
]
_LONG = f"{_VIEW}, {_ARGS}, lg AS (" + " UNION ALL ".join(
    f"SELECT run_id, category, '{n}' AS evaluator, ({s})::DOUBLE AS score, {p} AS pass "
    "FROM pr LEFT JOIN ag USING (run_id) WHERE "
    + (
        "true" if n in fixed.BASE_EVALUATORS else "category IN "
        + "(" + ", ".join(f"'{c}'" for c, e in fixed.CATEGORY_EVALUATORS.items() if n in e) + ")"
    )
    for n, s, p in _EVALS
) + ")"


@query(
    "evaluate_trajectories",
    f"WITH {_LONG} SELECT run_id, evaluator, round(score, 6) AS score, pass FROM lg",
)
def evaluate_trajectories(spark: SparkSession, sf: str) -> DataFrame:
    """Every evaluator that applies to the run's category."""
    return evaluated(spark, sf)[1].select(
        "run_id", "evaluator", F.round("score", 6).alias("score"), "pass"
    )


_TS = (
    f"{_LONG}, ts AS (SELECT run_id, {S.js_round('avg(score)')} AS score, "
    "count(*) FILTER (WHERE NOT pass) = 0 AS pass, coalesce(string_agg(evaluator, ',' ORDER BY "
    "evaluator) FILTER (WHERE NOT pass), '') AS failed FROM lg GROUP BY 1)"
)


@query("trajectory_scores", f"WITH {_TS} SELECT run_id, score, pass, failed FROM ts")
def trajectory_scores(spark: SparkSession, sf: str) -> DataFrame:
    out = A.trajectory_scores(evaluated(spark, sf)[1], ["run_id"])
    return out.withColumn("failed", F.array_join("failed", ","))


def report(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(cases, A17 metric table) per half of the users: ``suite`` even or odd."""
    rows, long = evaluated(spark, sf)
    suite = F.when(F.substring_index("run_id", "-", 1).cast("long") % 2 == 0, "even").otherwise("odd")
    scores = A.trajectory_scores(long, ["run_id"])
    cases = rows.select(
        "run_id", "category", "failure_class", "step_count", "tool_call_count", "latency_ms", "tokens"
    ).join(scores, "run_id").withColumn("suite", suite)
    return cases, A.benchmark_report(cases, long.withColumn("suite", suite), ["suite"])


_REPORT = (
    f"{_TS}, cs AS (SELECT t.*, v.n, len(v.req) AS calls, v.ms, v.category, v.fclass, "
    "CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS suite FROM ts t JOIN vw v USING (run_id)), "
    f"w1 AS (SELECT suite, {S.js_round('avg(pass::INT)')} AS \"taskSuccess\", "
    f"{S.js_round('avg(score)')} AS \"avgScore\", {S.js_round('avg(n)')} AS \"avgSteps\", "
    f"{S.js_round('avg(calls)')} AS \"avgToolCalls\", floor(avg(ms) + 0.5)::DOUBLE AS \"avgLatencyMs\", "
    "sum(ms)::DOUBLE AS \"totalTokens\" FROM cs GROUP BY 1), w2 AS (SELECT CASE WHEN "
    "string_split(run_id, '-')[1]::BIGINT % 2 = 0 THEN 'even' ELSE 'odd' END AS suite, "
    + ", ".join(
        f"coalesce({S.js_round(f'avg(score) FILTER (WHERE evaluator = {chr(39)}{e}{chr(39)})')}, "
        f"{0 if e == 'hallucination' else 1}) AS \"{m}\"" for m, e in A.REPORT_METRICS.items()
    )
    + " FROM lg WHERE pass IS NOT NULL GROUP BY 1), wd AS (SELECT * FROM w1 JOIN w2 USING (suite)), "
    "rp AS (SELECT suite, metric, value FROM (UNPIVOT wd ON COLUMNS(* EXCLUDE suite) INTO NAME metric "
    "VALUE value))"
)


@query("agent_report", f"WITH {_REPORT} SELECT suite, metric, value FROM rp")
def agent_report(spark: SparkSession, sf: str) -> DataFrame:
    """A17."""
    return report(spark, sf)[1].select("suite", "metric", "value")


@query(
    "agent_report_by",
    f"WITH {_REPORT} SELECT 'category' AS dimension, category AS value, count(*) AS cases, "
    f"{S.js_round('avg(pass::INT)')} AS pass_rate, {S.js_round('avg(score)')} AS avg_score FROM cs "
    "GROUP BY 2 UNION ALL SELECT 'failure_class', fclass, count(*), "
    f"{S.js_round('avg(pass::INT)')}, {S.js_round('avg(score)')} FROM cs WHERE fclass IS NOT NULL "
    "GROUP BY 2",
)
def agent_report_by(spark: SparkSession, sf: str) -> DataFrame:
    cases, _ = report(spark, sf)
    parts = [
        A.report_by(cases, key).select(
            F.lit(key).alias("dimension"), F.col(key).alias("value"), "cases", "pass_rate",
            "avg_score",
        )
        for key in ("category", "failure_class")
    ]
    return parts[0].unionByName(parts[1])


_ABS = " OR ".join(
    f"(metric = '{m}' AND value {'<' if k == 'min' else '>'} {v})"
    for m, (k, v) in fixed.AGENT_THRESHOLDS.items()
)


@query(
    "agent_regression",
    f"WITH {_REPORT}, x AS (SELECT o.metric, o.value, e.value AS baseline, "
    + S.js_round("o.value - e.value")
    + " AS delta FROM rp o JOIN rp e ON o.metric = e.metric AND o.suite = 'odd' AND e.suite = 'even') "
    f"SELECT *, 'ABSOLUTE' AS reason FROM x WHERE {_ABS} UNION ALL SELECT *, CASE WHEN "
    "metric = 'hallucinationRate' THEN 'RISE' WHEN metric = 'avgLatencyMs' THEN 'SLOWER' ELSE 'DROP' "
    f"END FROM x WHERE (metric IN ({S.text_list(fixed.AGENT_HIGHER_IS_BETTER)[1:-1]}) AND delta < -0.05)"
    " OR (metric = 'hallucinationRate' AND delta > 0.05) OR (metric = 'avgLatencyMs' AND baseline > 0 "
    "AND value > baseline * 1.5)",
)
def agent_regression(spark: SparkSession, sf: str) -> DataFrame:
    """Odd users against even users."""
    rows = cut_lineage(report(spark, sf)[1])
    side = lambda s: rows.where(F.col("suite") == s).withColumn("suite", F.lit("x"))
    out = A.agent_regression(side("odd"), side("even"), ["suite"])
    return out.select("metric", "value", "baseline", "delta", "reason")


@query(
    "suggest_thresholds",
    f"WITH {_REPORT} SELECT suite, metric, greatest(0.0::DOUBLE, "
    + S.js_round("value + CASE WHEN metric = 'hallucinationRate' THEN 0.05 ELSE -0.05 END::DOUBLE")
    + f") AS threshold FROM rp WHERE metric IN ({S.text_list(list(fixed.AGENT_THRESHOLDS))[1:-1]})",
)
def suggest_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """A29."""
    return A.suggest_thresholds(report(spark, sf)[1], ["suite"])


@query(
    "detect_loops",
    f"WITH {_STEPS}, c AS (SELECT run_id, idx, tool, k, k // 25 AS band FROM st WHERE "
    "type = 'TOOL_CALL'), p AS (SELECT a.run_id, a.idx, a.tool, count(b.idx) AS prior FROM c a "
    "LEFT JOIN c b ON a.run_id = b.run_id AND a.tool = b.tool AND b.idx < a.idx AND a.band = b.band "
    "GROUP BY 1, 2, 3) SELECT run_id, idx, replace(tool, '.', '__') AS tool_name, "
    "(prior + 1)::INT AS repeat, prior >= 2 AS blocked FROM p",
)
def detect_loops(spark: SparkSession, sf: str) -> DataFrame:
    """Equal bands give equal words, so those calls are near copies."""
    calls = steps(spark, sf).where("type = 'TOOL_CALL'")
    return A.detect_loops(calls)


@query(
    "budget_audit",
    f"WITH {_STEPS}, c AS (SELECT run_id, idx, count(*) OVER w AS n, count(*) FILTER (WHERE "
    "type = 'TOOL_CALL') OVER w AS calls, sum(ms) OVER w AS ms FROM st WINDOW w AS (PARTITION BY run_id "
    "ORDER BY idx)), h AS (SELECT run_id, idx, CASE WHEN n >= 12 THEN 'budget_steps' WHEN calls >= 4 "
    "THEN 'budget_tool_calls' WHEN ms >= 60000 THEN 'budget_wall_clock' WHEN ms >= 60000 THEN "
    "'budget_tokens' WHEN round(ms * 1e-6, 9) >= 0.05 THEN 'budget_cost' END AS reason FROM c) "
    "SELECT run_id, min(idx) AS idx, arg_min(reason, idx) AS reason FROM h WHERE reason IS NOT NULL "
    "GROUP BY 1",
)
def budget_audit(spark: SparkSession, sf: str) -> DataFrame:
    """A21 with limits that suit the derived runs."""
    limits = {"steps": 12, "tool_calls": 4, "wall_clock_ms": 60_000, "cost_usd": 0.05}
    return A.budget_audit(steps(spark, sf), limits)


@query(
    "no_progress_audit",
    f"WITH {_STEPS}, r AS (SELECT run_id, idx AS round, (event_type = 'purchase' AND k < 50)::INT AS ne, "
    "event_type = 'purchase' AS ok, event_type = 'error' AND k % 2 = 0 AS bad FROM st WHERE "
    "type = 'TOOL_RESULT'), g AS (SELECT *, count(*) FILTER (WHERE ne > 0) OVER w AS gi, count(*) "
    "FILTER (WHERE ok) OVER w AS si FROM r WINDOW w AS (PARTITION BY run_id ORDER BY round)), "
    "f AS (SELECT run_id, round, count(*) FILTER (WHERE ne = 0) OVER (PARTITION BY run_id, gi ORDER BY "
    "round) AS idle, count(*) FILTER (WHERE bad) OVER (PARTITION BY run_id, si ORDER BY round) AS fl "
    "FROM g), h AS (SELECT *, CASE WHEN idle >= 3 THEN 'no_progress' WHEN fl >= 2 THEN "
    "'tool_failure_threshold' END AS reason FROM f) SELECT run_id, min(round) AS round, "
    "arg_min(reason, round) AS reason FROM h WHERE reason IS NOT NULL GROUP BY 1",
)
def no_progress_audit(spark: SparkSession, sf: str) -> DataFrame:
    """Every tool result is a round; small purchases bring evidence."""
    kind = F.col("event_type")
    rounds = steps(spark, sf).where("type = 'TOOL_RESULT'").select(
        "run_id", F.col("idx").alias("round"),
        ((kind == "purchase") & (F.col("k") < 50)).cast("int").alias("new_evidence"),
        (kind == "purchase").alias("success"),
        ((kind == "error") & (F.col("k") % 2 == 0)).alias("retryable_failure"),
    )
    return A.no_progress_audit(rounds, failures=2)


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("event_type")
    return steps(spark, sf).where("event_type <> 'signup'").select(
        "run_id", F.col("idx").alias("ord"),
        F.when(kind == "error", "computation").when(kind == "view", "graph").otherwise("chunk")
        .alias("kind"),
        F.concat(F.lit("r"), F.col("k") % 10).alias("ref"),
        F.when(F.col("k") % 2 == 0, F.concat(F.lit("c"), F.col("k") % 10)).alias("chunk_id"),
        F.when(F.col("k") % 3 == 0, F.concat(F.lit("d"), F.col("k") % 5)).alias("doc_id"),
        kind.alias("text"),
        F.when(F.col("k") % 4 != 0, F.col("k") / 100).alias("score"),
    )


_EVIDENCE = (
    f"{_STEPS}, ee AS (SELECT run_id, idx AS ord, event_type, k, CASE WHEN event_type = 'error' THEN "
    "'computation' WHEN event_type = 'view' THEN 'graph' ELSE 'chunk' END AS kind, CASE WHEN k % 2 = 0 "
    "THEN 'c' || (k % 10) ELSE 'r' || (k % 10) END AS cid, CASE WHEN k % 3 = 0 THEN 'd' || (k % 5) END "
    "AS doc_id, CASE WHEN k % 4 <> 0 THEN k / 100.0::DOUBLE END AS score FROM st "
    "WHERE event_type <> 'signup')"
)


@query(
    "evidence_to_chunks",
    f"WITH {_EVIDENCE}, f AS (SELECT *, row_number() OVER (PARTITION BY run_id, cid ORDER BY ord) AS rn "
    "FROM ee WHERE kind <> 'computation'), b AS (SELECT *, row_number() OVER (PARTITION BY run_id "
    "ORDER BY coalesce(score, 0.5) DESC, ord) AS n FROM f WHERE rn = 1) SELECT run_id, cid AS chunk_id, "
    "coalesce(doc_id, 'unknown') AS doc_id, coalesce(score, 0.5)::DOUBLE AS score, CASE WHEN "
    "kind = 'graph' THEN 'graph' ELSE 'vector' END AS source FROM b WHERE n <= 6 UNION ALL SELECT "
    "run_id, 'compute:' || row_number() OVER (PARTITION BY run_id ORDER BY ord), 'computation', 1.0, "
    "'vector' FROM ee WHERE kind = 'computation'",
)
def evidence_to_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """A23 with room for six chunks."""
    return A.evidence_to_chunks(evidence(spark, sf), 6).select(
        "run_id", "chunk_id", "doc_id", "score", "source"
    )


@query(
    "citation_kind",
    f"WITH {_EVIDENCE}, g AS (SELECT DISTINCT run_id, cid FROM ee WHERE kind = 'graph') SELECT e.run_id, "
    "ord, CASE WHEN kind = 'computation' THEN 'computation' WHEN g.cid IS NOT NULL THEN 'graph' ELSE "
    "'chunk' END AS kind, CASE WHEN kind <> 'computation' THEN doc_id END AS doc_id, CASE WHEN "
    "kind <> 'computation' THEN e.cid END AS chunk_id FROM ee e LEFT JOIN g ON g.run_id = e.run_id "
    "AND g.cid = e.cid",
)
def citation_kind(spark: SparkSession, sf: str) -> DataFrame:
    """Each evidence row is cited once."""
    rows = evidence(spark, sf)
    made = rows.select(
        "run_id", "ord",
        F.when(F.col("kind") == "computation", "computation")
        .otherwise(F.coalesce("doc_id", F.lit("unknown"))).alias("doc_id"),
        F.coalesce("chunk_id", "ref").alias("chunk_id"),
    )
    return A.citation_kind(made, rows).select("run_id", "ord", "kind", "doc_id", "chunk_id")


@query(
    "diff_runs",
    f"WITH {_VIEW} SELECT a.run_id, a.lk <> b.lk AS answer_changed, a.fs IS DISTINCT FROM b.fs AS "
    "status_changed, a.req <> b.req AS tool_path_changed, a.n <> b.n AS step_count_changed, "
    "list_contains(a.req, 'shop.view') AS risky FROM vw a JOIN vw b ON b.user_id = a.user_id "
    "AND string_split(b.run_id, '-')[2]::INT = string_split(a.run_id, '-')[2]::INT + 1",
)
def diff_runs(spark: SparkSession, sf: str) -> DataFrame:
    """A user's next run is the replay of the run before."""
    rows = cut_lineage(view(spark, sf))
    n = F.substring_index("run_id", "-", -1).cast("int")
    replay = rows.withColumn("run_id", F.concat_ws("-", "user_id", n - 1))
    out = A.diff_runs(rows, replay, ["shop.view"])
    return out.select(
        "run_id", "answer_changed", "status_changed", "tool_path_changed", "step_count_changed",
        (F.size("side_effects_skipped") > 0).alias("risky"),
    )


@query(
    "step_timeline",
    f"WITH {_VIEW}, x AS (SELECT s.run_id, s.idx, s.type, s.ms, t0 + coalesce(sum(s.ms) OVER (PARTITION "
    "BY s.run_id ORDER BY s.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM st s "
    "JOIN vw USING (run_id)) SELECT run_id, idx, type, b::DOUBLE AS start_ms, (b + ms)::DOUBLE AS end_ms "
    "FROM x",
)
def step_timeline(spark: SparkSession, sf: str) -> DataFrame:
    """A27."""
    rows = steps(spark, sf)
    return A.step_timeline(runs(rows).select("run_id", "started_ms"), rows).select(
        "run_id", "idx", "type", "start_ms", "end_ms"
    )


@query(
    "recorded_results",
    f"WITH {_STEPS}, c AS (SELECT * FROM st WHERE type = 'TOOL_CALL') SELECT run_id, idx, max(idx) OVER "
    "(PARTITION BY run_id, tool, k) AS recorded_idx FROM c",
)
def recorded_results(spark: SparkSession, sf: str) -> DataFrame:
    """A call's recorded result is the last equal call of its run."""
    calls = steps(spark, sf).where("type = 'TOOL_CALL'").select(
        "run_id", "idx", "tool_name", "tool_input"
    )
    recorded = calls.withColumn("tool_output", F.col("tool_input"))
    return A.recorded_result_lookup(calls, recorded).select("run_id", "idx", "recorded_idx")


@query(
    "tool_argument_validity",
    f"WITH {_STEPS} SELECT run_id, idx, tool = 'shop.click' AND k % 5 <> 0 AS args_valid FROM st "
    "WHERE type = 'TOOL_CALL'",
)
def tool_argument_validity(spark: SparkSession, sf: str) -> DataFrame:
    """Views are undeclared; every fifth click sends its number as text."""
    calls = steps(spark, sf).where("type = 'TOOL_CALL'")
    text_k = F.regexp_replace("tool_input", r'"k": ([0-9]+)', '"k": "$1"')
    calls = calls.select(
        "run_id", "idx", "tool_name",
        F.when(F.col("k") % 5 == 0, text_k).otherwise(F.col("tool_input")).alias("tool_input"),
    )
    spec = {"shop__click": {"k": ("number", True), "q": ("string", True), "extra": ("string", False)}}
    return A.tool_argument_validity(calls, spec).select("run_id", "idx", "args_valid")


@query(
    "steps_since",
    f"WITH {_STEPS} SELECT run_id, idx FROM st WHERE idx > user_id % 20",
)
def steps_since(spark: SparkSession, sf: str) -> DataFrame:
    """T4: readers of a run have seen as many steps as the user's number says."""
    rows = steps(spark, sf)
    seen = rows.select("run_id", (F.col("user_id") % 20).cast("int").alias("seen")).distinct()
    return A.steps_since(rows, seen).select("run_id", "idx")


# --- costs and redaction -------------------------------------------------------------------------------------
_REDACT = "text"
for _p in fixed.SECRET_PATTERNS:
    _REDACT = S.rep(_REDACT, _p.replace(fixed.WS, S.WS), fixed.REDACTED)


@query(
    "redact_text",
    f"SELECT doc_id, sha256(x) AS text_sha, x <> text AS changed FROM (SELECT doc_id, text, {_REDACT} "
    "AS x FROM documents)",
)
def redact_text(spark: SparkSession, sf: str) -> DataFrame:
    """U2."""
    docs = src.spread(src.table(spark, sf, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "text", T.redact_text("text").alias("x")).select(
        "doc_id", F.sha2("x", 256).alias("text_sha"), (F.col("x") != F.col("text")).alias("changed")
    )


@query(
    "redact_nested",
    "SELECT event_id, '[REDACTED]' AS api_key, 'user ' || user_id || ' [REDACTED]' AS note, "
    "'[REDACTED]' AS token, event_type AS kind, event_type AS listed FROM events",
)
def redact_nested(spark: SparkSession, sf: str) -> DataFrame:
    """U3 over a struct, a map and an array built from each event."""
    events = src.table(spark, sf, "events")
    bearer = F.concat(F.lit("user "), "user_id", F.lit(" Bearer abc."), "event_id")
    rows = events.select(
        "event_id",
        F.struct(F.col("props").alias("api_key"), bearer.alias("note")).alias("s"),
        F.create_map(F.lit("authToken"), F.col("props"), F.lit("kind"), F.col("event_type")).alias("m"),
        F.array("event_type").alias("a"),
    )
    return U.redact_columns(rows).select(
        "event_id", "s.api_key", "s.note", F.col("m")["authToken"].alias("token"),
        F.col("m")["kind"].alias("kind"), F.col("a")[0].alias("listed"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    models = ["gpt-4o", "gemini-2.5-flash", "claude-sonnet-4-20250514", "unlisted"]
    providers = ["openai", "gemini", "anthropic", "openai"]
    i = (F.col("conv_id") % 4).cast("int")
    rows = src.table(spark, sf, "conversations").select(
        "conv_id", "turn", _pick(providers, i).alias("provider"), _pick(models, i).alias("model"),
        F.col("role").alias("day"), F.length("text").cast("long").alias("input_tokens"),
        F.ceil(F.length("text") / 4).alias("output_tokens"),
    )
    return rows.withColumn(
        "cost", U.estimate_cost("provider", "model", "input_tokens", "output_tokens")
    )


_USAGE = (
    "us AS (SELECT conv_id, turn, ['openai', 'gemini', 'anthropic', 'openai'][conv_id % 4 + 1] AS "
    "provider, ['gpt-4o', 'gemini-2.5-flash', 'claude-sonnet-4-20250514', 'unlisted'][conv_id % 4 + 1] "
    "AS model, role AS day, length(text)::BIGINT AS i, ceil(length(text) / 4.0)::BIGINT AS o FROM "
    "conversations), uc AS (SELECT *, "
    + S.js_round(
        "i / 1000::DOUBLE * CASE provider WHEN 'openai' THEN 0.0025 WHEN 'gemini' THEN 0.0003 ELSE 0.003 "
        "END::DOUBLE + o / 1000::DOUBLE * CASE provider WHEN 'openai' THEN 0.01 WHEN 'gemini' THEN 0.0025 "
        "ELSE 0.015 END::DOUBLE", 6
    )
    + " AS cost FROM us)"
)


@query("usage_cost", f"WITH {_USAGE} SELECT conv_id, turn, cost FROM uc")
def usage_cost(spark: SparkSession, sf: str) -> DataFrame:
    """U1."""
    return usage(spark, sf).select("conv_id", "turn", "cost")


@query(
    "usage_rollup",
    f"WITH {_USAGE} SELECT provider, model, day, count(*) AS calls, sum(i)::BIGINT AS input_tokens, "
    f"sum(o)::BIGINT AS output_tokens, {S.js_round('sum(cost)', 6)} AS cost FROM uc "
    "GROUP BY ROLLUP (provider, model, day)",
)
def usage_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """U7; the speaker's role stands for the day."""
    return U.usage_rollup(usage(spark, sf), ["provider", "model", "day"])


@query(
    "latency_percentiles",
    "SELECT event_type AS stage, count(*) AS n, "
    + ", ".join(
        f"round(quantile_cont(value, {p}), 4) AS p{int(p * 100)}" for p in (0.5, 0.75, 0.9, 0.95, 0.99)
    )
    + ", round(sum(value) / (SELECT sum(value) FROM events), 4) AS share FROM events GROUP BY 1",
)
def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """U4: event types as stages."""
    log = src.table(spark, sf, "events").select(
        F.col("event_type").alias("stage"), F.col("value").alias("ms")
    )
    return U.latency_percentiles(log)


_MESSAGES = ["Rate limit hit", "invalid API key", "quota exceeded", "blocked by safety",
             "maximum context reached", "model overloaded", "socket hang up", "request timed out",
             "unknown tool", "boom"]


@query(
    "classify_errors",
    f"WITH e AS (SELECT event_id, [400, 401, 429, 500, 529, 0][event_id % 6 + 1] AS s, "
    f"{S.text_list(_MESSAGES)}[event_id % 10 + 1] AS m, [-32601, -32602, -32000, 0][event_id % 4 + 1] AS "
    "r, event_id % 13 = 0 AS c FROM events WHERE event_type = 'error') SELECT event_id, CASE WHEN c THEN "
    "'NETWORK' WHEN s = 401 OR contains(m, 'API key') THEN 'AUTH' WHEN s = 429 OR contains(m, 'Rate') "
    "THEN 'RATE_LIMIT' WHEN contains(m, 'quota') THEN 'QUOTA' WHEN contains(m, 'safety') THEN "
    "'SAFETY_BLOCK' WHEN contains(m, 'context') THEN 'TOKEN_LIMIT' WHEN s = 529 OR "
    "contains(m, 'overloaded') THEN 'OVERLOADED' WHEN s >= 500 THEN 'SERVER_ERROR' WHEN s = 400 THEN "
    "'BAD_REQUEST' ELSE 'UNKNOWN' END AS kind, CASE WHEN contains(m, 'timed out') THEN 'MCP_TIMEOUT' "
    "WHEN c OR contains(m, 'socket') THEN 'MCP_CONNECTION_ERROR' WHEN r = -32601 THEN 'TOOL_NOT_FOUND' "
    "WHEN r = -32602 THEN 'TOOL_ARGUMENT_ERROR' WHEN r = -32000 THEN 'MCP_PROTOCOL_ERROR' WHEN "
    "contains(m, 'unknown tool') THEN 'TOOL_NOT_FOUND' ELSE 'MCP_REMOTE_ERROR' END AS tool_code FROM e",
)
def classify_errors(spark: SparkSession, sf: str) -> DataFrame:
    """U5 and U9 over the error events, with status, code and message drawn from their ids."""
    i = F.col("event_id")
    rows = src.table(spark, sf, "events").where("event_type = 'error'").select(
        "event_id",
        F.get(F.array(*[F.lit(x) for x in (400, 401, 429, 500, 529, 0)]), (i % 6).cast("int")).alias("s"),
        _pick(_MESSAGES, (i % 10).cast("int")).alias("m"),
        F.get(F.array(*[F.lit(x) for x in (-32601, -32602, -32000, 0)]), (i % 4).cast("int")).alias("r"),
        F.when(i % 13 == 0, "ECONNRESET").alias("c"),
    )
    kind, _ = U.classify_errors(F.col("s"), F.col("c"), F.lit(None).cast("string"), F.col("m"))
    code, _ = U.classify_tool_errors(
        F.col("m"), F.col("r"), F.when(F.col("c").isNotNull(), "connect")
    )
    return rows.select("event_id", kind.alias("kind"), code.alias("tool_code"))


@query(
    "extract_json",
    "SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events",
)
def extract_json(spark: SparkSession, sf: str) -> DataFrame:
    """The event properties wrapped in a chatty reply with a fence."""
    reply = F.concat(F.lit("Sure {here}:\n```json\n"), "props", F.lit("\n```\nmore } text"))
    rows = src.table(spark, sf, "events").select("event_id", U.extract_json(reply).alias("j"))
    return rows.select("event_id", F.from_json("j", "k int")["k"].alias("k"))


@query(
    "stage_progress",
    "SELECT o_orderkey AS doc_id, string_agg(l_shipmode, '>' ORDER BY l_linenumber, l_shipmode) AS stages, "
    "sum(l_quantity) AS total_ms FROM (SELECT o_orderkey, l_linenumber, l_linestatus AS l_shipmode, "
    "l_quantity FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY 1",
)
def stage_progress(spark: SparkSession, sf: str) -> DataFrame:
    """U8: the few lines of an order are its stages."""
    log = src.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linestatus").alias("stage"),
        F.lit("COMPLETED").alias("status"), F.col("l_linenumber").alias("created_at"),
        F.col("l_quantity").alias("ms"),
    )
    known = src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("doc_id"))
    out = U.stage_progress(log.join(known, "doc_id"))
    return out.select(
        "doc_id",
        F.array_join(F.transform("stages", lambda s: s["stage"]), ">").alias("stages"), "total_ms",
    )
