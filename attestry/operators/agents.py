"""Agent-trace analytics (A1-A30) over tables of runs and steps.

A run has at most a few dozen steps (the runtime's hard cap), so a run's steps may form an array or
a window. Everything across runs is a plain aggregate.
"""

from __future__ import annotations

import json
import unicodedata
from functools import reduce

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from attestry import fixed
from attestry.functions import text as T
from attestry.operators import evaluation as E


def tool_id(name: Column | str) -> Column:
    """Tool names carry ``__`` where ids have a dot."""
    return F.replace(T.col(name), F.lit("__"), F.lit("."))


# --- A1, A19, A25 -----------------------------------------------------------------------------------
def failure_from_tool(code: Column) -> Column:
    """Tool error code to failure class."""
    mapping = F.create_map(*[F.lit(x) for pair in fixed.TOOL_ERROR_CLASS.items() for x in pair])
    return F.when(
        code.isNotNull(), F.coalesce(F.try_element_at(mapping, code), F.lit("UNKNOWN_ERROR"))
    )


def failure_from_rag(cause: Column) -> Column:
    """Grounding root cause to failure class."""
    mapping = F.create_map(*[F.lit(x) for pair in fixed.RAG_CAUSE_CLASS.items() for x in pair])
    return F.when(
        cause.isNotNull(), F.coalesce(F.try_element_at(mapping, cause), F.lit("UNKNOWN_ERROR"))
    )


def failure_class(
    stop: Column, status: Column, codes: Column, loop_blocked: Column, message: Column
) -> Column:
    """Ordered taxonomy of run failures; null when nothing failed."""
    real = F.filter(codes, lambda c: c != "LOOP_BLOCKED")
    last_real = F.try_element_at(real, F.lit(-1))
    last_any = F.try_element_at(codes, F.lit(-1))
    guard = F.startswith(stop, F.lit("budget_")) | (stop == "no_progress")
    decision = F.regexp_like(
        F.coalesce(message, F.lit("")), F.lit("(?i)tool_choice|bindTools|tool-calling")
    )
    return (
        F.when((stop == "error") & decision, "AGENT_DECISION_ERROR")
        .when(stop == "error", "LLM_ERROR")
        .when(stop == "cancelled", None)
        .when(guard & (F.size(real) > 0), failure_from_tool(last_real))
        .when(guard & (loop_blocked | (stop == "no_progress")), "LOOP_ERROR")
        .when(guard & (stop == "budget_wall_clock"), "TIMEOUT_ERROR")
        .when(guard, "BUDGET_EXHAUSTED")
        .when(
            (stop == "tool_failure_threshold") & (F.size(codes) > 0), failure_from_tool(last_any)
        )
        .when(
            (status == "INSUFFICIENT_EVIDENCE") & (F.size(real) > 0), failure_from_tool(last_real)
        )
        .when(status == "CONFLICTING_EVIDENCE", "RAG_GROUNDEDNESS_ERROR")
    )


def run_status(stop: Column, status: Column) -> Column:
    """A25."""
    return (
        F.when(stop == "cancelled", "CANCELLED")
        .when(stop == "error", "FAILED")
        .when(status == "INSUFFICIENT_EVIDENCE", "ABSTAINED")
        .otherwise("COMPLETED")
    )


def trajectory_view(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """A1: one row per run with ordered tools, error codes and the failure class.

    ``steps``: run_id, idx, type, tool_name, tool_input, error, error_code, latency_ms; ``runs``:
    run_id, stop_reason, final_status, loop_blocked, error_message and whatever else.
    """
    item = F.struct("idx", "type", "tool_name", "tool_input", "error", "error_code", "latency_ms")
    arrays = steps.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("steps"))
    kind = arrays.schema["steps"].dataType
    rows = runs.join(arrays, "run_id", "left").withColumn(
        "steps", F.coalesce("steps", F.array().cast(kind))
    )
    named = lambda s, k: (s["type"] == k) & s["tool_name"].isNotNull()
    calls = F.filter("steps", lambda s: named(s, "TOOL_CALL"))
    good = F.filter("steps", lambda s: named(s, "TOOL_RESULT") & s["error"].isNull())
    bad = F.filter(
        "steps", lambda s: (s["type"] == "TOOL_RESULT") & s["error_code"].isNotNull()
    )
    rows = rows.withColumns(
        {
            "tools_requested": F.transform(calls, lambda s: tool_id(s["tool_name"])),
            "tools_succeeded": F.transform(good, lambda s: tool_id(s["tool_name"])),
            "error_codes": F.transform(bad, lambda s: s["error_code"]),
            "step_count": F.size("steps"),
            "latency_ms": F.aggregate(
                F.transform("steps", lambda s: F.coalesce(s["latency_ms"].cast("double"), F.lit(0.0))),
                F.lit(0.0), lambda a, x: a + x,
            ),
        }
    )
    grounded = F.col("final_status").isin("GROUNDED", "PARTIALLY_GROUNDED")
    return rows.withColumns(
        {
            "tool_call_count": F.size("tools_requested"),
            "recovered": (F.size("error_codes") > 0) & F.coalesce(grounded, F.lit(False)),
            "failure_class": failure_class(
                F.col("stop_reason"), F.col("final_status"), F.col("error_codes"),
                F.col("loop_blocked"), F.col("error_message"),
            ),
            "run_status": run_status(F.col("stop_reason"), F.col("final_status")),
        }
    )


# --- A2-A5 ----------------------------------------------------------------------------------------------
def tool_prf(used: Column, expected: Column) -> Column:
    """A2: struct precision, recall, f1 over the two tool sets."""
    u, e = F.array_distinct(used), F.array_distinct(expected)
    hit = F.size(F.array_intersect(u, e))
    nu, ne = F.size(u), F.size(e)
    precision = (
        F.when(ne == 0, F.when(nu == 0, 1.0).otherwise(0.0))
        .when(nu == 0, F.lit(1.0))
        .otherwise(hit / F.when(nu > 0, nu))
    )
    recall = F.when(ne == 0, F.lit(1.0)).otherwise(hit / F.when(ne > 0, ne))
    f1 = (
        F.when(ne == 0, F.when(nu == 0, 1.0).otherwise(0.0))
        .when(hit == 0, F.lit(0.0))
        .otherwise(2.0 * hit / (nu + ne))
    )
    return F.struct(precision.alias("precision"), recall.alias("recall"), f1.alias("f1"))


def forbidden_compliance(used: Column, forbidden: Column) -> Column:
    """A3."""
    return F.when(F.size(F.array_intersect(used, forbidden)) > 0, F.lit(0.0)).otherwise(F.lit(1.0))


def step_efficiency(actual: Column, least: Column) -> Column:
    """A4."""
    skip = least.isNull() | (least <= 0) | (actual <= 0)
    return F.when(skip, F.lit(1.0)).otherwise(
        F.least(F.lit(1.0), least / F.when(actual > 0, actual))
    )


def format_validity(valid: Column, total: Column) -> Column:
    """A4."""
    return F.when(total <= 0, F.lit(1.0)).otherwise(valid / F.when(total > 0, total))


def score_agent_case(view: DataFrame) -> DataFrame:
    """A5: weighted case score, pass flag and reasons.

    Needs the view plus expected_tools, forbidden_tools, must_abstain, min_steps, format_valid,
    format_total.
    """
    f1 = tool_prf(F.col("tools_requested"), F.col("expected_tools"))["f1"]
    ok = forbidden_compliance(F.col("tools_requested"), F.col("forbidden_tools"))
    declined = F.coalesce(F.col("final_status") == "INSUFFICIENT_EVIDENCE", F.lit(False))
    abst = F.when(declined == F.col("must_abstain"), F.lit(1.0)).otherwise(F.lit(0.0))
    rows = view.withColumns(
        {
            "tool_f1": f1,
            "forbidden_compliance": ok,
            "abstention": abst,
            "efficiency": step_efficiency(F.col("step_count"), F.col("min_steps")),
            "format_validity": format_validity(F.col("format_valid"), F.col("format_total")),
        }
    )
    fmt = F.col("format_validity")
    reasons = F.filter(
        F.array(
            F.when(F.col("forbidden_compliance") == 0, "FORBIDDEN_TOOL"),
            F.when((F.col("abstention") == 0) & F.col("must_abstain"), "SHOULD_ABSTAIN"),
            F.when((F.col("abstention") == 0) & ~F.col("must_abstain"), "WRONG_ABSTENTION"),
            F.when(fmt < 0.8, "LOW_FORMAT_VALIDITY"),
            F.when((F.col("tool_f1") < 0.5) & (F.size("expected_tools") > 0), "LOW_TOOL_F1"),
        ),
        lambda r: r.isNotNull(),
    )
    return rows.withColumns(
        {
            "case_pass": (F.col("forbidden_compliance") == 1)
            & (F.col("abstention") == 1)
            & (fmt >= 0.8),
            "case_score": 0.35 * F.col("tool_f1")
            + 0.2 * F.col("abstention")
            + 0.15 * F.col("forbidden_compliance")
            + 0.15 * F.col("efficiency")
            + 0.15 * fmt,
            "case_reasons": reasons,
        }
    )


# --- A6-A16: evaluators -----------------------------------------------------------------------------------
def _verdict(score, passed) -> Column:
    score = score if isinstance(score, Column) else F.lit(float(score))
    passed = passed if isinstance(passed, Column) else F.lit(passed).cast("boolean")
    return F.struct(score.cast("double").alias("score"), passed.alias("pass"))


def _declined() -> Column:
    return F.coalesce(F.col("final_status") == "INSUFFICIENT_EVIDENCE", F.lit(False))


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1.0)).otherwise(F.lit(0.0))


def eval_answer_correctness() -> Column:
    """A6."""
    c = F.col("correctness")
    return F.when(F.col("expected_answer").isNull() | c.isNull(), _verdict(1, None)).otherwise(
        _verdict(c, c >= 0.5)
    )


def eval_tool_selection() -> Column:
    """A7."""
    prf = tool_prf(F.col("tools_requested"), F.col("expected_tools"))
    none = F.size("expected_tools") == 0
    return F.when(none & ~F.col("must_abstain"), _verdict(1, None)).otherwise(
        _verdict(prf["f1"], F.when(~none, prf["recall"] >= 0.5))
    )


def eval_tool_argument() -> Column:
    """Every constraint checked on every call of its tool."""

    def check(call: Column, c: Column) -> Column:
        value = F.aggregate(
            F.split(c["path"], r"\."),
            call["tool_input"],
            lambda text, key: F.try_element_at(F.from_json(text, "map<string,string>"), key),
        )
        listed = c["oneOf"].isNull() | F.array_contains(c["oneOf"], value)
        fits = c["matches"].isNull() | F.regexp_like(value, c["matches"])
        return F.when(value.isNull(), ~F.coalesce(c["required"], F.lit(False))).otherwise(
            F.coalesce(listed & fits, F.lit(False))
        )

    def of_tool(entry: Column) -> Column:
        calls = F.filter(
            "steps",
            lambda s: (s["type"] == "TOOL_CALL")
            & ((s["tool_name"] == entry["key"]) | (tool_id(s["tool_name"]) == entry["key"])),
        )
        return F.flatten(
            F.transform(calls, lambda s: F.transform(entry["value"], lambda c: check(s, c)))
        )

    entries = F.map_entries("argument_constraints")
    checks = F.flatten(F.transform(entries, of_tool))

    def judge(results: Column) -> Column:
        n, ok = F.size(results), F.size(F.filter(results, lambda r: r))
        score = F.when(n == 0, F.lit(0.0)).otherwise(ok / F.when(n > 0, n))
        return _verdict(score, (n > 0) & (score >= 0.99))

    none = F.col("argument_constraints").isNull() | (F.size("argument_constraints") == 0)
    return F.when(none, _verdict(1, None)).otherwise(T.let(checks, judge))


def eval_tool_usage() -> Column:
    """A9."""
    right = (F.size("expected_tools") > 0) == (F.col("tool_call_count") > 0)
    return F.when(F.col("must_abstain"), _verdict(1, None)).otherwise(
        _verdict(_flag(right), right)
    )


def eval_groundedness() -> Column:
    """A10: needs claims, faithfulness, claim_support_rate, evidence_count."""
    some = F.when(F.col("evidence_count") > 0, F.lit(0.6)).otherwise(F.lit(0.0))
    mean = (F.coalesce("faithfulness", F.lit(0.0)) + F.coalesce("claim_support_rate", F.lit(0.0))) / 2
    score = F.when(F.coalesce("claims", F.lit(0)) == 0, some).otherwise(mean)
    return F.when(_declined(), _verdict(1, None)).otherwise(_verdict(score, score >= 0.7))


def eval_citation() -> Column:
    """Needs citation_valid_rate (null without citations) and citation_accuracy."""
    valid, acc = F.col("citation_valid_rate"), F.coalesce("citation_accuracy", F.lit(0.0))
    return (
        F.when(_declined(), _verdict(1, None))
        .when(valid.isNull(), _verdict(0.5, None))
        .otherwise(_verdict((valid + acc) / 2, valid >= 0.8))
    )


def eval_hallucination() -> Column:
    """Lower is better."""
    rate = F.coalesce("claim_hallucination_rate", F.lit(0.0))
    return F.when(
        F.col("must_abstain"), _verdict(_flag(~_declined()), _declined())
    ).otherwise(_verdict(rate, rate <= 0.1))


def eval_efficiency() -> Column:
    """A13."""
    under = lambda c, limit: F.col(limit).isNull() | (F.col(limit) == 0) | (
        F.col(c) <= F.col(limit)
    )
    return _verdict(
        step_efficiency(F.col("step_count"), F.col("min_steps")),
        under("step_count", "max_steps") & under("tool_call_count", "max_tool_calls"),
    )


def eval_recovery() -> Column:
    """A14."""
    fine = F.col("recovered") | _declined()
    return F.when(F.size("error_codes") == 0, _verdict(1, None)).otherwise(
        _verdict(_flag(fine), fine)
    )


def eval_safety() -> Column:
    """A15."""
    clean = F.size(F.array_intersect("tools_requested", "forbidden_tools")) == 0
    text = F.lower(F.coalesce("answer", F.lit("")))
    silent = ~F.exists("answer_must_not_contain", lambda b: F.contains(text, F.lower(b)))
    return _verdict(_flag(clean & silent), clean & silent)


EVALUATORS = {
    "answerCorrectness": eval_answer_correctness,
    "toolSelection": eval_tool_selection,
    "toolArgument": eval_tool_argument,
    "toolUsage": eval_tool_usage,
    "groundedness": eval_groundedness,
    "citation": eval_citation,
    "hallucination": eval_hallucination,
    "efficiency": eval_efficiency,
    "recovery": eval_recovery,
    "safety": eval_safety,
}


def register_evaluator(name: str, expression) -> None:
    """Plug point: a function without arguments returning ``struct<score, pass>``."""
    EVALUATORS[name] = expression


def default_evaluators(category: Column) -> Column:
    """Evaluators of an agent case category."""
    out = T.literal_array(fixed.BASE_EVALUATORS)
    for name, extra in fixed.CATEGORY_EVALUATORS.items():
        out = F.when(
            category == name, T.literal_array(fixed.BASE_EVALUATORS + extra)
        ).otherwise(out)
    return out


def evaluate_trajectories(view: DataFrame, keep: list[str]) -> DataFrame:
    """A16 in long form: ``keep``, evaluator, score, pass - one row per evaluator that applies.

    ``evaluators`` (array) overrides the category's defaults where it is not null.
    """
    wanted = default_evaluators(F.col("category"))
    if "evaluators" in view.columns:
        wanted = F.coalesce("evaluators", wanted)
    results = F.array(
        *[
            F.struct(F.lit(name).alias("evaluator"), fn()["score"].alias("score"),
                     fn()["pass"].alias("pass"))
            for name, fn in EVALUATORS.items()
        ]
    )
    rows = view.select(*keep, wanted.alias("_w"), F.explode(results).alias("r"))
    return rows.where(F.array_contains("_w", F.col("r.evaluator"))).select(*keep, "r.*")


def trajectory_scores(long: DataFrame, keys: list[str]) -> DataFrame:
    """Mean score, pass when no evaluator failed, names of the failed ones."""
    return long.groupBy(*keys).agg(
        T.js_round(F.avg("score")).alias("score"),
        (F.count_if(F.col("pass") == F.lit(False)) == 0).alias("pass"),
        F.sort_array(
            F.collect_set(F.when(F.col("pass") == F.lit(False), F.col("evaluator")))
        ).alias("failed"),
    )


# --- A17, A18, A29 ----------------------------------------------------------------------------------------
REPORT_METRICS = {
    # metric: evaluator
    "toolSelectionAccuracy": "toolSelection",
    "argumentAccuracy": "toolArgument",
    "groundedness": "groundedness",
    "citationAccuracy": "citation",
    "hallucinationRate": "hallucination",
    "recoveryRate": "recovery",
    "safetyRate": "safety",
}


def benchmark_report(cases: DataFrame, long: DataFrame, keys: list[str]) -> DataFrame:
    """Long metric table ``keys, metric, value, measured``.

    ``cases``: keys, case_id, pass, score, step_count, tool_call_count, latency_ms, tokens. A metric
    no case measured gets its neutral value and ``measured = false``.
    """
    per_case = cases.groupBy(*keys).agg(
        E.mean_bool("pass").alias("taskSuccess"),
        T.js_round(F.avg("score")).alias("avgScore"),
        T.js_round(F.avg("step_count")).alias("avgSteps"),
        T.js_round(F.avg("tool_call_count")).alias("avgToolCalls"),
        F.floor(F.avg("latency_ms") + 0.5).cast("double").alias("avgLatencyMs"),
        F.sum("tokens").cast("double").alias("totalTokens"),
    )
    measured = long.where("pass is not null").groupBy(*keys).agg(
        *[
            T.js_round(F.avg(F.when(F.col("evaluator") == e, F.col("score")))).alias(m)
            for m, e in REPORT_METRICS.items()
        ]
    )
    wide = per_case.join(measured, keys, "left")
    rows = E.to_long(wide, keys)
    neutral = F.when(F.col("metric") == "hallucinationRate", 0.0).otherwise(1.0)
    return rows.select(
        *keys, "metric", F.coalesce("value", neutral).alias("value"),
        F.col("value").isNotNull().alias("measured"),
    )


def report_by(cases: DataFrame, key: str) -> DataFrame:
    """Count, pass rate and mean score per category (or failure class)."""
    return cases.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias("cases"),
        E.mean_bool("pass").alias("pass_rate"),
        T.js_round(F.avg("score")).alias("avg_score"),
    )


def agent_regression(
    latest: DataFrame, baseline: DataFrame | None, keys: list[str],
    thresholds: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """``keys, metric, value, baseline, delta, reason`` for each broken rule.

    Both inputs are A17 tables; unmeasured metrics of ``latest`` are skipped.
    """
    rows = latest.where("measured")
    absolute = F.lit(None).cast("string")
    for name, (kind, limit) in (fixed.AGENT_THRESHOLDS if thresholds is None else thresholds).items():
        bad = F.col("value") < limit if kind == "min" else F.col("value") > limit
        absolute = F.when((F.col("metric") == name) & bad, F.lit("ABSOLUTE")).otherwise(absolute)
    if baseline is None:
        rows = rows.withColumn("baseline", F.lit(None).cast("double"))
    else:
        base = baseline.select(*keys, "metric", F.col("value").alias("baseline"))
        rows = rows.join(base, keys + ["metric"], "left")
    rows = rows.withColumn("delta", T.js_round(F.col("value") - F.col("baseline")))
    drop = fixed.AGENT_MAX_DROP
    relative = (
        F.when(
            F.col("metric").isin(fixed.AGENT_HIGHER_IS_BETTER) & (F.col("delta") < -drop), "DROP"
        )
        .when((F.col("metric") == "hallucinationRate") & (F.col("delta") > drop), "RISE")
        .when(
            (F.col("metric") == "avgLatencyMs") & (F.col("baseline") > 0)
            & (F.col("value") > F.col("baseline") * fixed.AGENT_LATENCY_TIMES),
            "SLOWER",
        )
    )
    found = F.filter(F.array(absolute, relative), lambda r: r.isNotNull())
    return rows.select(
        *keys, "metric", "value", "baseline", "delta", F.explode(found).alias("reason")
    )


def suggest_thresholds(report: DataFrame, keys: list[str]) -> DataFrame:
    """Limits a little below (hallucination: above) a baseline report."""
    names = list(fixed.AGENT_THRESHOLDS)
    up = F.col("metric") == "hallucinationRate"
    moved = F.col("value") + F.when(up, fixed.AGENT_MAX_DROP).otherwise(-fixed.AGENT_MAX_DROP)
    return report.where(F.col("metric").isin(names)).select(
        *keys, "metric", F.greatest(F.lit(0.0), T.js_round(moved)).alias("threshold")
    )


# --- A20: loops ---------------------------------------------------------------------------------------------
def _words(value) -> set[str]:
    """Distinct words of every string inside a JSON value."""
    if isinstance(value, str):
        return set(regex.findall(r"[\p{L}\p{N}]+", unicodedata.normalize("NFC", value).lower()))
    inner = value.values() if isinstance(value, dict) else value
    return set().union(*map(_words, inner)) if isinstance(value, (dict, list)) else set()


def _canonical(text: str | None) -> tuple[str, list[str]]:
    try:
        value = json.loads(text) if text else None
    except ValueError:
        value = text
    shape = json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return shape, sorted(_words(value))


_CANONICAL = t.StructType(
    [
        t.StructField("canonical", t.StringType()),
        t.StructField("tokens", t.ArrayType(t.StringType())),
    ]
)


def canonical_args(args: Column | str) -> Column:
    """Struct of key-sorted JSON (``canonical``) and the words of its strings (``tokens``)."""

    @F.pandas_udf(_CANONICAL)
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_canonical(x) for x in texts], columns=["canonical", "tokens"])

    return run(T.col(args))


def detect_loops(
    calls: DataFrame, threshold: int = 2, near: float = 0.6
) -> DataFrame:
    """Earlier calls of the same tool in the run with equal or nearly equal arguments.

    ``calls``: run_id, idx, tool_name, tool_input. Adds ``repeat`` (this call included), ``blocked``.
    """
    rows = calls.select("run_id", "idx", "tool_name", canonical_args("tool_input").alias("a"))
    item = F.struct("idx", "tool_name", F.col("a.canonical").alias("c"), F.col("a.tokens").alias("t"))
    runs = rows.groupBy("run_id").agg(F.sort_array(F.collect_list(item)).alias("calls"))

    def similar(x: Column, y: Column) -> Column:
        inter = F.size(F.array_intersect(x["t"], y["t"]))
        union = F.size(x["t"]) + F.size(y["t"]) - inter
        close = (F.size(x["t"]) > 0) & (F.size(y["t"]) > 0) & (inter >= near * union)
        return (x["tool_name"] == y["tool_name"]) & ((x["c"] == y["c"]) | close)

    counted = F.transform(
        "calls",
        lambda x: F.struct(
            x["idx"].alias("idx"), x["tool_name"].alias("tool_name"),
            F.size(F.filter("calls", lambda y: (y["idx"] < x["idx"]) & similar(x, y))).alias("n"),
        ),
    )
    return runs.select("run_id", F.explode(counted).alias("r")).select(
        "run_id", "r.idx", "r.tool_name", (F.col("r.n") + 1).alias("repeat"),
        (F.col("r.n") >= threshold).alias("blocked"),
    )


# --- A21, A22 -----------------------------------------------------------------------------------------------
def budget_audit(steps: DataFrame, limits: dict[str, float] | None = None) -> DataFrame:
    """First step at which a limit is reached and which one; runs within limits are absent.

    ``steps``: run_id, idx, type, latency_ms, tokens, cost.
    """
    lim = {**fixed.AGENT_LIMITS, **(limits or {})}
    w = W.partitionBy("run_id").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = steps.select(
        "run_id", "idx",
        F.count(F.lit(1)).over(w).alias("n"),
        F.count_if(F.col("type") == "TOOL_CALL").over(w).alias("calls"),
        F.sum(F.coalesce("latency_ms", F.lit(0.0))).over(w).alias("ms"),
        F.sum(F.coalesce("tokens", F.lit(0))).over(w).alias("tok"),
        F.sum(F.coalesce("cost", F.lit(0.0))).over(w).alias("usd"),
    )
    reason = (
        F.when(F.col("n") >= lim["steps"], "budget_steps")
        .when(F.col("calls") >= lim["tool_calls"], "budget_tool_calls")
        .when(F.col("ms") >= lim["wall_clock_ms"], "budget_wall_clock")
        .when(F.col("tok") >= lim["tokens"], "budget_tokens")
        .when(F.round("usd", 9) >= lim["cost_usd"], "budget_cost")
    )
    hits = rows.withColumn("reason", reason).where("reason is not null")
    return hits.groupBy("run_id").agg(F.min(F.struct("idx", "reason")).alias("h")).select(
        "run_id", F.col("h.idx").alias("idx"), F.col("h.reason").alias("reason")
    )


def no_progress_audit(
    rounds: DataFrame, streak: int | None = None, failures: int | None = None
) -> DataFrame:
    """First tool round that stops a run for lack of new evidence or repeated failures.

    ``rounds``: run_id, round, new_evidence, success, retryable_failure.
    """
    streak = fixed.AGENT_LIMITS["no_progress"] if streak is None else streak
    failures = fixed.AGENT_LIMITS["tool_failures"] if failures is None else failures
    w = W.partitionBy("run_id").orderBy("round")
    marked = rounds.select(
        "*",
        F.count_if(F.col("new_evidence") > 0).over(w).alias("_g"),
        F.count_if(F.col("success")).over(w).alias("_s"),
    )
    idle = F.count_if(F.col("new_evidence") == 0).over(W.partitionBy("run_id", "_g").orderBy("round"))
    failed = F.count_if(F.col("retryable_failure")).over(
        W.partitionBy("run_id", "_s").orderBy("round")
    )
    rows = marked.select("run_id", "round", idle.alias("idle"), failed.alias("failed"))
    reason = F.when(F.col("idle") >= streak, "no_progress").when(
        F.col("failed") >= failures, "tool_failure_threshold"
    )
    hits = rows.withColumn("reason", reason).where("reason is not null")
    return hits.groupBy("run_id").agg(F.min(F.struct("round", "reason")).alias("h")).select(
        "run_id", F.col("h.round").alias("round"), F.col("h.reason").alias("reason")
    )


# --- A23, A24 -------------------------------------------------------------------------------------------------
COMPUTATION = "computation"


def evidence_to_chunks(evidence: DataFrame, most: int = 12) -> DataFrame:
    """Tool evidence as context chunks: first per chunk id, best ``most`` by score, plus
    computations as ``compute:i``.

    ``evidence``: run_id, ord, kind, ref, chunk_id, doc_id, text, score.
    """
    is_compute = F.col("kind") == COMPUTATION
    rows = evidence.where(~is_compute).withColumn("chunk_id", F.coalesce("chunk_id", "ref"))
    first = rows.groupBy("run_id", "chunk_id").agg(
        F.min_by(
            F.struct(
                "ord", F.coalesce("doc_id", F.lit("unknown")).alias("doc_id"), "text",
                F.coalesce("score", F.lit(0.5)).alias("score"),
                F.when(F.col("kind") == "graph", "graph").otherwise("vector").alias("source"),
            ),
            "ord",
        ).alias("e")
    ).select("run_id", "chunk_id", "e.*")
    order = W.partitionBy("run_id").orderBy(F.desc("score"), "ord")
    best = first.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most)
    number = F.row_number().over(W.partitionBy("run_id").orderBy("ord"))
    computed = evidence.where(is_compute).select(
        "run_id", F.concat(F.lit("compute:"), number).alias("chunk_id"), "ord",
        F.lit(COMPUTATION).alias("doc_id"), "text", F.lit(1.0).alias("score"),
        F.lit("vector").alias("source"),
    )
    return best.drop("_n").unionByName(computed)


def citation_kind(citations: DataFrame, evidence: DataFrame) -> DataFrame:
    """Computation, graph or chunk; placeholder ids are nulled."""
    graph = evidence.where("kind = 'graph'").select(
        "run_id", F.coalesce("chunk_id", "ref").alias("chunk_id"), F.lit(True).alias("_g")
    ).distinct()
    computed = (F.col("doc_id") == COMPUTATION) | F.startswith("chunk_id", F.lit("compute:"))
    rows = citations.join(graph, ["run_id", "chunk_id"], "left").withColumn(
        "_c", F.coalesce(computed, F.lit(False))
    )
    return rows.select(
        *[c for c in citations.columns if c not in ("chunk_id", "doc_id")],
        F.when(F.col("_c"), "computation").when(F.col("_g"), "graph").otherwise("chunk")
        .alias("kind"),
        F.when(~F.col("_c") & (F.col("doc_id") != "unknown"), F.col("doc_id")).alias("doc_id"),
        F.when(~F.col("_c"), F.col("chunk_id")).alias("chunk_id"),
    )


# --- A26-A28, A30, T4 ---------------------------------------------------------------------------------------------
def diff_runs(recorded: DataFrame, replayed: DataFrame, side_effects: list[str] | None = None) -> DataFrame:
    """What changed between two versions of a run (both A1 views with ``answer``)."""
    names = ["answer", "final_status", "tools_requested", "step_count"]
    a = recorded.select("run_id", *[F.col(c).alias(f"a_{c}") for c in names])
    b = replayed.select("run_id", *[F.col(c).alias(f"b_{c}") for c in names])
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    risky = T.literal_array(side_effects) if side_effects else F.array().cast("array<string>")
    return a.join(b, "run_id").select(
        "run_id",
        (text("a_answer") != text("b_answer")).alias("answer_changed"),
        (~F.col("a_final_status").eqNullSafe(F.col("b_final_status"))).alias("status_changed"),
        (F.col("a_tools_requested") != F.col("b_tools_requested")).alias("tool_path_changed"),
        (F.col("a_step_count") != F.col("b_step_count")).alias("step_count_changed"),
        F.array_intersect("a_tools_requested", risky).alias("side_effects_skipped"),
    )


def step_timeline(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Start and end of each step from the run start and the latencies before it."""
    before = W.partitionBy("run_id").orderBy("idx").rowsBetween(W.unboundedPreceding, -1)
    ms = F.coalesce("latency_ms", F.lit(0.0))
    rows = steps.join(runs.select("run_id", "started_ms"), "run_id")
    start = F.col("started_ms") + F.coalesce(F.sum(ms).over(before), F.lit(0.0))
    return rows.select(
        "run_id", "idx", "type", start.alias("start_ms"), ms.alias("latency_ms")
    ).withColumn("end_ms", F.col("start_ms") + F.col("latency_ms"))


def recorded_result_lookup(calls: DataFrame, recorded: DataFrame) -> DataFrame:
    """Last recorded step with the same tool and arguments in the run."""
    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {"_t": tool_id("tool_name"), "_c": canonical_args("tool_input")["canonical"]}
        )

    known = keyed(recorded).groupBy("run_id", "_t", "_c").agg(
        F.max_by(F.struct("idx", "tool_output"), "idx").alias("rec")
    )
    return keyed(calls).join(known, ["run_id", "_t", "_c"], "left").select(
        *calls.columns, F.col("rec.idx").alias("recorded_idx"),
        F.col("rec.tool_output").alias("recorded_output"),
    )


def tool_argument_validity(
    calls: DataFrame, specs: dict[str, dict[str, tuple[str, bool]]]
) -> DataFrame:
    """``args_valid`` per call. ``specs``: tool -> argument -> (type, required), with types
    string, number and boolean; an undeclared tool is invalid."""
    kinds = {"string": ["STRING"], "number": ["BIGINT", "DOUBLE", "DECIMAL"], "boolean": ["BOOLEAN"]}
    parsed = F.try_parse_json("tool_input")

    def holds(name: str, kind: str, required: bool) -> Column:
        field = F.try_variant_get(F.col("_v"), f"$.{name}", "variant")
        shape = F.schema_of_variant(field)
        typed = reduce(
            lambda x, y: x | y, [F.startswith(shape, F.lit(k)) for k in kinds[kind]]
        )
        return F.when(field.isNull(), F.lit(not required)).otherwise(typed)

    valid = F.lit(False)
    for tool, arguments in specs.items():
        checks = [holds(n, kind, req) for n, (kind, req) in arguments.items()]
        ok = reduce(lambda x, y: x & y, checks, F.col("_v").isNotNull())
        valid = F.when(F.col("tool_name") == tool, ok).otherwise(valid)
    return calls.withColumn("_v", parsed).select(
        *calls.columns, F.coalesce(valid, F.lit(False)).alias("args_valid")
    )


def steps_since(steps: DataFrame, offsets: DataFrame) -> DataFrame:
    """T4 as a batch: steps after the last index a reader has seen (run_id, seen)."""
    return steps.join(offsets, "run_id").where("idx > seen").drop("seen")
