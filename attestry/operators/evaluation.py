"""Evaluation analytics (M1-M27): case metrics, run aggregates, comparisons and gates.

Rankings and gold sets are long tables. A gold set may hold a third of all items: it is only ever
counted or joined on (case, item), never collected.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from attestry import fixed
from attestry.functions import text as T
from attestry.session import cut_lineage, rank_within, shuffle_partitions

RETRIEVAL_METRICS = [
    "recall_at_k", "precision_at_k", "mrr", "ndcg_at_k", "context_precision", "context_recall",
]


# --- M1-M6 ------------------------------------------------------------------------------------------
def retrieval_metrics(
    cases: DataFrame, retrieved: DataFrame, gold: DataFrame, keys: list[str],
    gold_keys: list[str] | None = None, k: int = 5,
) -> DataFrame:
    """One row per case with the six ranking metrics, four decimals.

    ``retrieved``: keys, rank, item (repeats allowed, the first counts); ``gold``: gold_keys, item.
    """
    gold_keys = gold_keys or keys
    truth = gold.select(*gold_keys, "item").distinct()
    sizes = truth.groupBy(*gold_keys).agg(F.count(F.lit(1)).alias("_gold"))
    first = retrieved.groupBy(*keys, "item").agg(F.min("rank").alias("_r"))
    order = W.partitionBy(*keys).orderBy("_r", "item")
    ranked = first.select(*keys, "item", F.row_number().over(order).alias("_pos"))
    hits = ranked.join(truth.withColumn("_hit", F.lit(1)), gold_keys + ["item"], "left").select(
        *keys, "_pos", F.coalesce("_hit", F.lit(0)).alias("_hit")
    )
    so_far = F.sum("_hit").over(
        W.partitionBy(*keys).orderBy("_pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    top = F.col("_pos") <= k
    good = F.col("_hit") == 1
    stats = (
        hits.select("*", so_far.alias("_seen"))
        .groupBy(*keys)
        .agg(
            F.count_if(top).alias("_n"),
            F.count_if(top & good).alias("_h"),
            F.count_if(good).alias("_all"),
            F.min(F.when(good, F.col("_pos"))).alias("_first"),
            F.sum(F.when(top & good, 1 / F.log2(F.col("_pos") + 1.0))).alias("_dcg"),
            F.sum(F.when(top & good, F.col("_seen") / F.col("_pos"))).alias("_prec"),
        )
    )
    rows = (
        cases.select(*keys).join(stats, keys, "left").join(sizes, gold_keys, "left")
        .fillna({"_n": 0, "_h": 0, "_all": 0, "_dcg": 0.0, "_prec": 0.0, "_gold": 0})
    )
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least("_gold", F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + 1 / F.log2(i + 1.0),
    )
    none = F.col("_gold") == 0
    hit_none = F.col("_h") == 0
    return rows.select(
        *keys,
        F.col("_gold").alias("gold_size"),
        (F.col("_all") == F.col("_gold")).alias("all_gold_retrieved"),
        T.js_round(F.when(none, F.lit(1.0)).otherwise(F.col("_h") / F.when(~none, F.col("_gold"))))
        .alias("recall_at_k"),
        T.js_round(
            F.when(F.col("_n") == 0, F.lit(0.0)).otherwise(
                F.col("_h") / F.when(F.col("_n") > 0, F.col("_n"))
            )
        ).alias("precision_at_k"),
        T.js_round(F.coalesce(1 / F.col("_first"), F.lit(0.0))).alias("mrr"),
        T.js_round(F.when(none, F.lit(1.0)).otherwise(F.col("_dcg") / ideal)).alias("ndcg_at_k"),
        T.js_round(
            F.when(hit_none, F.lit(0.0)).otherwise(F.col("_prec") / F.when(~hit_none, F.col("_h")))
        ).alias("context_precision"),
        T.js_round(
            F.when(none, F.lit(1.0)).otherwise(F.col("_all") / F.when(~none, F.col("_gold")))
        ).alias("context_recall"),
    )


# --- M7-M10 --------------------------------------------------------------------------------------------
def abstention_correct(answerable: Column, status: Column) -> Column:
    """M7: an answerable case must be answered, any other must be declined."""
    declined = status == "INSUFFICIENT_EVIDENCE"
    return F.when(answerable, ~declined & (status != "ERROR")).otherwise(declined)


def citation_metrics(
    citations: DataFrame, gold: DataFrame, keys: list[str], gold_keys: list[str] | None = None
) -> DataFrame:
    """M8: valid share of all citations, gold share of the valid ones (null without gold)."""
    gold_keys = gold_keys or keys
    truth = gold.select(*gold_keys, "item").distinct().withColumn("_g", F.lit(1))
    joined = citations.join(truth, gold_keys + ["item"], "left")
    usable = F.col("valid") & (F.coalesce(F.col("item"), F.lit("")) != "")
    return joined.groupBy(*keys).agg(
        T.js_round(F.avg(F.col("valid").cast("double"))).alias("citation_valid_rate"),
        F.coalesce(
            T.js_round(F.avg(F.when(usable, F.coalesce("_g", F.lit(0)).cast("double")))),
            F.lit(0.0),
        ).alias("citation_accuracy"),
    )


def claim_metrics(claims: DataFrame, keys: list[str]) -> DataFrame:
    """M9: support rate, hallucination rate and faithfulness over claim verdicts."""
    verdict = F.coalesce(
        F.col("verdict"), F.when(F.col("supported"), "SUPPORTED").otherwise("UNSUPPORTED")
    )
    good, bad = verdict == "SUPPORTED", verdict == "CONTRADICTED"
    n = F.count(F.lit(1))
    return claims.groupBy(*keys).agg(
        n.alias("claims"),
        T.js_round(F.count_if(F.col("supported")) / n).alias("claim_support_rate"),
        T.js_round(F.count_if(~good) / n).alias("claim_hallucination_rate"),
        T.js_round(T.clamp((F.count_if(good) - F.count_if(bad) * 2) / n)).alias("faithfulness"),
    )


def hallucinated(answerable: Column, status: Column, correctness: Column) -> Column:
    """Answered although unanswerable, or answered with correctness below .3."""
    answered = status != "INSUFFICIENT_EVIDENCE"
    return F.when(~answerable, answered & (status != "ERROR")).otherwise(
        answered & F.coalesce(correctness < 0.3, F.lit(False))
    )


# --- M11, M12 -----------------------------------------------------------------------------------------------
_SPLIT = rf"[{T.WS}.,/\-]+"


def _fact_tokens(norm: Column) -> Column:
    return F.filter(F.split(norm, _SPLIT, -1), lambda t: F.length(t) >= 2)


def required_fact_recall(
    answers: DataFrame, facts: DataFrame, keys: list[str], coverage: float = 0.8
) -> DataFrame:
    """Share of facts present; a fact is present verbatim or by 80% of its words."""
    rows = facts.select(*keys, T.strip_diacritics("fact").alias("_f")).join(
        answers.select(*keys, "answer", T.strip_diacritics("answer").alias("_a")), keys
    )
    tokens = _fact_tokens(F.col("_f"))
    found = F.filter(tokens, lambda t: F.contains(F.col("_a"), t))
    present = (
        (F.col("_f") == "")
        | F.contains("_a", F.col("_f"))
        | (F.size(tokens) == 0)
        | (F.size(found) / F.greatest(F.size(tokens), F.lit(1)) >= coverage)
    )
    silent = F.coalesce("answer", F.lit("")) == ""
    return rows.groupBy(*keys).agg(
        T.js_round(F.avg(F.when(present & ~silent, 1.0).otherwise(0.0))).alias(
            "required_fact_recall"
        )
    )


def forbidden_claim_rate(answers: DataFrame, claims: DataFrame, keys: list[str]) -> DataFrame:
    """Share of forbidden claims leaked verbatim or word by word with small gaps."""
    rows = claims.select(*keys, T.strip_diacritics("claim").alias("_c")).join(
        answers.select(*keys, "answer", T.strip_diacritics("answer").alias("_a")), keys
    )
    kept = F.filter(
        _fact_tokens(F.col("_c")), lambda t: ~t.isin(fixed.FACT_STOP_WORDS)
    )
    pattern = F.array_join(kept, r"(?:\s+\S+){0,2}\s+")
    leaked = (F.col("_c") != "") & (
        F.contains("_a", F.col("_c"))
        | ((F.size(kept) > 0) & F.regexp_like(F.col("_a"), pattern))
    )
    silent = F.coalesce("answer", F.lit("")) == ""
    return rows.groupBy(*keys).agg(
        T.js_round(F.avg(F.when(leaked & ~silent, 1.0).otherwise(0.0))).alias(
            "forbidden_claim_rate"
        )
    )


# --- M13, M14 -------------------------------------------------------------------------------------------------
def mean_ignoring_null(c: Column | str) -> Column:
    return T.js_round(F.avg(T.col(c)))


def mean_bool(c: Column | str) -> Column:
    return F.coalesce(T.js_round(F.avg(T.col(c).cast("double"))), F.lit(0.0))


#: Values of a key that one row holds, and about how many draws one row stands for.
SLICE, DRAWS = 1 << 19, 1 << 22


def seeded_draws(seed: int, first: int, count: int) -> np.ndarray:
    """The numbers in [0, 1) that draws ``first`` (from 1) to ``first + count - 1`` of the generator return.

    Its state moves by a constant, so any draw is a pure function of the seed and its index.
    """
    call = (np.arange(first, first + count, dtype=np.uint64) & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    a = np.uint32(seed & 0xFFFFFFFF) + call * np.uint32(0x6D2B79F5)
    t = (a ^ (a >> np.uint32(15))) * (a | np.uint32(1))
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | np.uint32(61))
    return (t ^ (t >> np.uint32(14))) / 4294967296.0


def drawn_sums(
    values: np.ndarray, low: int, n: int, first: int, last: int, seed: int
) -> np.ndarray:
    """Per iteration of [first, last): the sum of the values at [low, low + len(values)) that are drawn.

    An iteration makes ``n`` draws with replacement of the indexes 0 to n - 1.
    """
    sums = np.zeros(last - first)
    for at in range(first * n, last * n, 1 << 20):
        count = min(1 << 20, last * n - at)
        index = np.floor(seeded_draws(seed, at + 1, count) * n).astype(np.int64) - low
        own = (index >= 0) & (index < len(values))
        iteration = (at + np.flatnonzero(own)) // n - first
        sums += np.bincount(iteration, weights=values[index[own]], minlength=len(sums))
    return sums


def _resampled(
    values: DataFrame, keys: list[str], iterations: int, seed: int
) -> DataFrame:
    """(keys, n, _it, _s) from rows (keys, n, _low, _v, _first, _step) of slices and iterations."""
    schema = ST.StructType(
        [values.schema[c] for c in keys]
        + [ST.StructField("n", ST.LongType()), ST.StructField("_it", ST.IntegerType()),
           ST.StructField("_s", ST.DoubleType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {f: batch.column(i) for i, f in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                n, low, first, step = (column[c][i].as_py() for c in ("n", "_low", "_first", "_step"))
                held = column["_v"][i].values.to_numpy(zero_copy_only=False)
                last = min(first + step, iterations)
                sums = drawn_sums(held, low, n, first, last, seed)
                same = pa.array([i] * len(sums), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*[column[c].take(same) for c in keys], column["n"].take(same),
                     pa.array(range(first, last), pa.int32()), pa.array(sums)],
                    names=schema.names,
                )

    return values.select(*keys, "n", "_low", "_v", "_first", "_step").mapInArrow(run, schema)


def bootstrap_ci(
    values: DataFrame, keys: list[str], order: list[str], value: str = "value",
    iterations: int = 2000, confidence: float = 0.95, seed: int = fixed.BOOTSTRAP_SEED,
) -> DataFrame:
    """Mean and percentile interval per key; ``order`` fixes the input order and is unique.

    Values are packed into slices by their rank. A row is one slice and a stretch of iterations: it
    runs through the stretch's draws and adds up the values that fall into its slice, so what is
    shuffled are slices and one sum per slice and iteration, not draws.
    """
    present = values.where(F.col(value).isNotNull()).select(*keys, *order, value)
    rows = rank_within(present, keys, order, "_i").select(
        *keys, (F.col("_i") - 1).alias("_i"), F.col(value).cast("double").alias("_v")
    )
    packed = rows.groupBy(*keys, F.floor(F.col("_i") / SLICE).alias("_slice")).agg(
        F.sort_array(F.collect_list(F.struct("_i", "_v"))).alias("_v"),
        F.count(F.lit(1)).alias("_count"), F.sum("_v").alias("_sum"),
    ).withColumn("_v", F.transform("_v", lambda x: x["_v"]))
    packed = cut_lineage(packed)
    sizes = packed.groupBy(*keys).agg(
        F.sum("_count").alias("n"), (F.sum("_sum") / F.sum("_count")).alias("_mean")
    )
    one = not keys
    base = packed.join(sizes) if one else packed.join(sizes, keys)
    step = F.greatest(F.lit(1), F.least(F.lit(iterations), F.floor(F.lit(DRAWS) / F.col("n")))).cast("int")
    work = base.select(
        *keys, "n", (F.col("_slice") * SLICE).alias("_low"), "_v", step.alias("_step"), "_slice",
        F.explode(F.sequence(F.lit(0), F.lit(iterations - 1), step)).alias("_first"),
    ).repartition(shuffle_partitions(values.sparkSession), *keys, "_slice", "_first")
    means = _resampled(work, keys, iterations, seed).groupBy(*keys, "n", "_it").agg(
        (F.sum("_s") / F.col("n")).alias("_m")
    )
    alpha = (1 - confidence) / 2
    low_at = math.floor(alpha * iterations) + 1
    high_at = min(iterations - 1, math.ceil((1 - alpha) * iterations) - 1) + 1
    place = F.row_number().over(W.partitionBy(*keys).orderBy("_m"))
    ends = (
        means.select(*keys, "_m", place.alias("_p"))
        .groupBy(*keys)
        .agg(
            F.max(F.when(F.col("_p") == low_at, F.col("_m"))).alias("_low"),
            F.max(F.when(F.col("_p") == high_at, F.col("_m"))).alias("_high"),
        )
    )
    out = sizes.join(ends) if one else sizes.join(ends, keys)
    single = F.col("n") == 1
    return out.select(
        *keys,
        "n",
        T.js_round(F.col("_mean")).alias("mean"),
        T.js_round(F.when(single, F.col("_mean")).otherwise(F.col("_low"))).alias("low"),
        T.js_round(F.when(single, F.col("_mean")).otherwise(F.col("_high"))).alias("high"),
        T.js_round(
            F.when(single, F.lit(0.0)).otherwise((F.col("_high") - F.col("_low")) / 2)
        ).alias("margin_of_error"),
    )


# --- M15-M18 ----------------------------------------------------------------------------------------------------
def failure_layer(
    answerable: Column, all_gold: Column, status: Column, correctness: Column, citation: Column
) -> Column:
    """The layer to blame, null when nothing failed."""
    declined = status == "INSUFFICIENT_EVIDENCE"
    return (
        F.when(status == "ERROR", "RETRIEVAL_FAILURE")
        .when(~answerable, F.when(~declined, "GENERATION_HALLUCINATION"))
        .when(~all_gold, "RETRIEVAL_FAILURE")
        .when(declined, "MISSING_CONTEXT")
        .when(correctness < 0.3, "GENERATION_HALLUCINATION")
        .when(citation < 0.5, "CITATION_HALLUCINATION")
    )


def decide_pass(
    answerable: Column, abstention: Column, layer: Column, correctness: Column
) -> Column:
    """Right about answering, no failed layer, and correct enough when judged."""
    weak = answerable & F.coalesce(correctness < 0.5, F.lit(False))
    return F.coalesce(abstention, F.lit(False)) & layer.isNull() & ~weak


def score_cases(
    cases: DataFrame, keys: list[str], retrieval: DataFrame, outcomes: DataFrame,
    claims: DataFrame, citations: DataFrame, facts: DataFrame | None = None,
    forbidden: DataFrame | None = None,
) -> DataFrame:
    """All case metrics side by side.

    ``cases``: keys, answerable. ``outcomes``: keys, status, correctness, latency_ms, cost. The
    other frames are results of the metric functions above.
    """
    rows = cases.join(retrieval, keys, "left").join(outcomes, keys, "left")
    for extra in (claims, citations, facts, forbidden):
        if extra is not None:
            rows = rows.join(extra, keys, "left")
    has_gold = F.col("gold_size") > 0
    accuracy = F.when(has_gold, F.coalesce("citation_accuracy", F.lit(0.0)))
    rows = rows.withColumn("citation_accuracy", accuracy)
    all_gold = has_gold & F.col("all_gold_retrieved")
    rows = rows.withColumns(
        {
            "abstained": F.col("status") == "INSUFFICIENT_EVIDENCE",
            "abstention_correct": abstention_correct(F.col("answerable"), F.col("status")),
            "failure_layer": failure_layer(
                F.col("answerable"), all_gold, F.col("status"), F.col("correctness"),
                F.col("citation_accuracy"),
            ),
            "hallucinated": hallucinated(
                F.col("answerable"), F.col("status"), F.col("correctness")
            ),
        }
    )
    return rows.withColumn(
        "passed",
        decide_pass(
            F.col("answerable"), F.col("abstention_correct"), F.col("failure_layer"),
            F.col("correctness"),
        ),
    )


def aggregate_run(scored: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """One row per run; with ``order`` (unique inside a run) the pass-rate interval as well."""
    gold = F.col("gold_size") > 0
    on_gold = lambda c: T.js_round(F.avg(F.when(gold, F.col(c))))
    answerable = lambda c: T.js_round(F.avg(F.when(F.col("answerable"), F.col(c))))
    have = set(scored.columns)
    extra = []
    if "required_fact_recall" in have:
        extra.append(answerable("required_fact_recall").alias("requiredFactRecall"))
    if "forbidden_claim_rate" in have:
        extra.append(T.js_round(F.avg("forbidden_claim_rate")).alias("forbiddenClaimRate"))
    out = scored.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("cases"),
        F.count_if(~F.col("answerable")).cast("double").alias("unanswerableCount"),
        F.count_if(gold).cast("double").alias("retrievalEvaluated"),
        mean_bool("passed").alias("passRate"),
        on_gold("recall_at_k").alias("recallAt5"),
        on_gold("precision_at_k").alias("precisionAt5"),
        on_gold("mrr").alias("mrr"),
        on_gold("ndcg_at_k").alias("ndcgAt5"),
        on_gold("context_precision").alias("contextPrecision"),
        on_gold("context_recall").alias("contextRecall"),
        mean_bool("abstention_correct").alias("abstentionAccuracy"),
        answerable("correctness").alias("answerCorrectness"),
        mean_ignoring_null("citation_accuracy").alias("citationAccuracy"),
        mean_ignoring_null("faithfulness").alias("faithfulness"),
        mean_ignoring_null("claim_hallucination_rate").alias("claimLevelHallucinationRate"),
        *extra,
        mean_bool("hallucinated").alias("hallucinationRateProxy"),
        F.floor(F.avg("latency_ms") + 0.5).cast("double").alias("avgLatencyMs"),
        T.js_round(F.sum("cost")).alias("totalCost"),
    )
    if order is None:
        return out
    passed = scored.select(*keys, *order, F.col("passed").cast("double").alias("value"))
    ci = bootstrap_ci(passed, keys, order, seed=fixed.PASS_RATE_SEED).select(
        *keys,
        F.col("low").alias("passRateCI95Low"),
        F.col("high").alias("passRateCI95High"),
        F.col("margin_of_error").alias("passRateMarginOfError"),
    )
    return out.join(ci, keys, "left")


def to_long(wide: DataFrame, keys: list[str]) -> DataFrame:
    """Metric columns as rows ``keys, metric, value``."""
    metrics = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, metrics, "metric", "value")


# --- M19-M24 ----------------------------------------------------------------------------------------------------
LOWER_IS_BETTER = ["avgLatencyMs", "totalCost"]


def compare_strategies(long: DataFrame, strategy: str, names: list[str]) -> DataFrame:
    """A metric by strategy table and the best strategy; the first listed wins a tie."""
    table = long.groupBy("metric").pivot(strategy, names).agg(F.first("value"))
    sign = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.lit(1)).otherwise(F.lit(-1))
    entries = F.array(
        *[
            F.when(
                F.col(n).isNotNull(),
                F.struct((F.col(n) * sign).alias("v"), F.lit(i).alias("i"), F.lit(n).alias("n")),
            )
            for i, n in enumerate(names)
        ]
    )
    best = F.array_min(F.filter(entries, lambda e: e.isNotNull()))["n"]
    return table.withColumn("best", F.coalesce(best, F.lit("N/A")))


def compare_variants(before: DataFrame, after: DataFrame) -> DataFrame:
    """Before, after and delta over the union of the two metric sets (metric, value)."""
    b = before.select("metric", F.col("value").alias("before"))
    a = after.select("metric", F.col("value").alias("after"))
    return b.join(a, "metric", "full_outer").withColumn(
        "delta", T.js_round(F.col("after") - F.col("before"))
    )


def provider_tradeoff(runs: DataFrame) -> DataFrame:
    """Weighted quality and a label by quality and latency."""
    part = lambda c, w: F.coalesce(F.col(c), F.lit(0.0)) * w
    quality = T.js_round(
        part("faithfulness", 0.4) + part("answerCorrectness", 0.4) + part("citationAccuracy", 0.2)
    )
    latency = F.coalesce(F.col("avgLatencyMs"), F.lit(0.0))
    q = F.col("quality_score")
    return runs.withColumn("quality_score", quality).withColumn(
        "assessment",
        F.when((q >= 0.85) & (latency < 1000), "EXCELLENT")
        .when(q >= 0.85, "HIGH_QUALITY")
        .when(latency < 500, "FAST")
        .otherwise("NEEDS_TUNING"),
    )


def compare_models(long: DataFrame, models: list[str]) -> DataFrame:
    """Dataset and metric rows, one column per embedding model, and the best model."""
    table = long.groupBy("dataset", "metric").pivot("model", models).agg(F.first("value"))
    sign = F.when(F.col("metric").isin(LOWER_IS_BETTER), F.lit(1)).otherwise(F.lit(-1))
    entries = F.array(
        *[
            F.when(
                F.col(m).isNotNull(),
                F.struct((F.col(m) * sign).alias("v"), F.lit(i).alias("i"), F.lit(m).alias("n")),
            )
            for i, m in enumerate(models)
        ]
    )
    return table.withColumn(
        "best", F.array_min(F.filter(entries, lambda e: e.isNotNull()))["n"]
    )


def metric_deltas(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Union of metrics per key with their change."""
    c = current.select(*keys, "metric", F.col("value").alias("current"))
    b = baseline.select(*keys, "metric", F.col("value").alias("baseline"))
    return b.join(c, keys + ["metric"], "full_outer").withColumn(
        "delta", T.js_round(F.col("current") - F.col("baseline"))
    )


def regression_reasons(
    deltas: DataFrame, limits: dict[str, tuple[str, float]] | None = None
) -> DataFrame:
    """Rows of ``metric_deltas`` that break a limit, with ``reason``."""
    hit = F.lit(None).cast("string")
    for name, (kind, limit) in (fixed.RUN_LIMITS if limits is None else limits).items():
        delta, base, now = F.col("delta"), F.col("baseline"), F.col("current")
        broken = {
            "drop": delta < -limit,
            "rise": delta > limit,
            "times": (base > 0) & (now > base * limit),
        }[kind]
        hit = F.when((F.col("metric") == name) & broken, F.lit(f"{kind}>{limit}")).otherwise(hit)
    return deltas.withColumn("reason", hit).where("reason is not null")


def regression_gate(
    current: DataFrame, baseline: DataFrame, keys: list[str],
    limits: dict[str, tuple[str, float]] | None = None,
) -> DataFrame:
    """One row per key: regressed or not, and why. Keys without a baseline pass."""
    reasons = regression_reasons(metric_deltas(current, baseline, keys), limits)
    listed = reasons.groupBy(*keys).agg(
        F.array_join(
            F.sort_array(F.collect_list(F.concat_ws(" ", "metric", "reason"))), "; "
        ).alias("reasons")
    )
    return (
        current.select(*keys).distinct().join(listed, keys, "left").select(
            *keys, F.col("reasons").isNotNull().alias("regressed"),
            F.coalesce("reasons", F.lit("")).alias("reasons"),
        )
    )


def set_baseline(runs: DataFrame, chosen: DataFrame) -> DataFrame:
    """The chosen run becomes the only baseline of its dataset."""
    picked = chosen.select("run_id").withColumn("_pick", F.lit(True))
    marked = runs.join(picked, "run_id", "left")
    touched = marked.where("_pick").select("dataset").distinct().withColumn("_t", F.lit(True))
    return marked.join(touched, "dataset", "left").select(
        *[c for c in runs.columns if c != "is_baseline"],
        F.when(F.col("_t"), F.coalesce("_pick", F.lit(False))).otherwise(F.col("is_baseline"))
        .alias("is_baseline"),
    )


def latest_baseline(runs: DataFrame) -> DataFrame:
    """Newest completed baseline per dataset."""
    usable = runs.where("is_baseline and status = 'COMPLETED'")
    return usable.groupBy("dataset").agg(
        F.max_by("run_id", F.struct("created_at", "run_id")).alias("baseline_run_id")
    )


# --- M25-M27 ----------------------------------------------------------------------------------------------------
LITERAL_CATEGORIES = [
    # fixed values: categories whose facts are quoted from the gold documents
    "direct_retrieval", "numerical_exact", "semantic_paraphrase", "keyword_mismatch",
    "long_context", "entity_disambiguation",
]


def fact_in_text(text: Column, fact: Column, coverage: float = 0.8) -> Column:
    """Fact check on two already normalised columns."""
    tokens = _fact_tokens(fact)
    found = F.size(F.filter(tokens, lambda t: F.contains(text, t)))
    return (
        (fact == "")
        | F.contains(text, fact)
        | (F.size(tokens) == 0)
        | (found / F.greatest(F.size(tokens), F.lit(1)) >= coverage)
    )


def validate_cases(cases: DataFrame, minimums: dict[str, int] | None = None) -> DataFrame:
    """``id, severity, rule`` rows for every rule an evaluation case breaks."""
    gold, cat = F.size("expectedDocuments"), F.coalesce("category", F.lit(""))
    sources = F.transform("corpus", lambda d: d["source"])
    inside = lambda c: F.size(F.array_except(c, sources)) == 0
    answerable = F.col("answerable")
    normed = cases.withColumns(
        {
            "_q": T.strip_diacritics("question"),
            "_e": T.strip_diacritics(F.coalesce("expectedAnswer", F.lit(""))),
        }
    )
    leak = (F.length("expectedAnswer") > 12) & F.contains("_q", F.col("_e"))
    rules = [
        ("ERROR", "ANSWERABLE_MISMATCH", answerable != F.col("expectedAnswer").isNotNull()),
        ("ERROR", "ANSWERABLE_ABSTAINS", answerable & F.col("shouldAbstain")),
        ("ERROR", "EXPECTED_NOT_IN_CORPUS", ~inside("expectedDocuments")),
        ("ERROR", "ALTERNATIVE_NOT_IN_CORPUS", ~inside("alternativeDocuments")),
        ("ERROR", "DISTRACTOR_NOT_IN_CORPUS", ~inside("distractorDocuments")),
        (
            "ERROR", "GOLD_IS_DISTRACTOR",
            F.size(F.array_intersect("distractorDocuments", "expectedDocuments")) > 0,
        ),
        ("ERROR", "ACTION_OUTSIDE_ROUTING",
         F.col("expectedAction").isNotNull() & (cat != "agent_routing")),
        ("ERROR", "ANSWER_LEAKAGE", leak),
        ("WARNING", "NO_CATEGORY", cat == ""),
        ("ERROR", "NEGATIVE_WITH_GOLD", ~answerable & (gold > 0)),
        ("WARNING", "NEGATIVE_WITHOUT_TYPE", ~answerable & F.col("negativeType").isNull()),
        (
            "WARNING", "FALSE_PREMISE_WITHOUT_CLAIMS",
            ~answerable & (F.col("negativeType") == "false_premise")
            & (F.size("forbiddenClaims") == 0),
        ),
        ("ERROR", "ANSWERABLE_WITHOUT_GOLD",
         answerable & (gold == 0) & (cat != "agent_routing")),
        ("ERROR", "TOO_FEW_STEPS",
         cat.isin("multi_hop", "cross_document") & (F.col("reasoningSteps") < 2)),
        ("ERROR", "CROSS_DOCUMENT_GOLD", (cat == "cross_document") & (gold < 2)),
        ("WARNING", "MULTI_HOP_GOLD", (cat == "multi_hop") & (gold < 2)),
        ("WARNING", "DISTRACTOR_MISSING",
         answerable & (cat == "distractor") & (F.size("distractorDocuments") == 0)),
        ("ERROR", "CONFLICT_GOLD", (F.col("type") == "CONFLICTING_SOURCES") & (gold < 2)),
        ("ERROR", "ROUTING_WITHOUT_ACTION",
         (cat == "agent_routing") & F.col("expectedAction").isNull()),
    ]
    found = F.filter(
        F.array(
            *[
                F.when(
                    F.coalesce(cond, F.lit(False)),
                    F.struct(F.lit(sev).alias("severity"), F.lit(rule).alias("rule")),
                )
                for sev, rule, cond in rules
            ]
        ),
        lambda v: v.isNotNull(),
    )
    out = normed.select("id", F.explode(found).alias("v")).select("id", "v.severity", "v.rule")
    violation = lambda df, sev, rule: df.select(
        "id", F.lit(sev).alias("severity"), F.lit(rule).alias("rule")
    )
    twice = cases.groupBy("id").count().where("count > 1")
    from attestry.operators.dedupe import duplicate_questions

    exempt = F.col("file") == "golden.jsonl" if "file" in cases.columns else None
    again = duplicate_questions(cases, exempt=exempt)
    gold_text = (
        cases.where(answerable & cat.isin(LITERAL_CATEGORIES))
        .select(
            "id", "requiredFacts",
            F.array_join(
                F.transform(
                    F.filter(
                        "corpus",
                        lambda d: F.array_contains(F.col("expectedDocuments"), d["source"]),
                    ),
                    lambda d: d["text"],
                ),
                "\n",
            ).alias("_g"),
        )
        .where("_g <> ''")
        .withColumn("_k", F.xxhash64("requiredFacts", "_g"))
    )
    # each text and each fact is normalised once; they meet in the case's row
    facts = gold_text.select("id", "_k", F.explode("requiredFacts").alias("_f")).select(
        "id", "_k", T.strip_diacritics("_f").alias("_f")
    ).groupBy("id", "_k").agg(F.collect_set("_f").alias("_fs"))
    gold_text = (
        gold_text.select("id", "_k", T.strip_diacritics("_g").alias("_g"))
        .join(facts, ["id", "_k"])
        .where(F.exists("_fs", lambda f: ~fact_in_text(F.col("_g"), f)))
        .select("id").distinct()
    )
    out = (
        out.unionByName(violation(twice, "ERROR", "DUPLICATE_ID"))
        .unionByName(violation(again, "ERROR", "DUPLICATE_QUESTION"))
        .unionByName(violation(gold_text, "WARNING", "FACT_NOT_IN_GOLD"))
    )
    if minimums:
        spark = cases.sparkSession
        need = spark.createDataFrame(list(minimums.items()), "category string, need int")
        have = cases.groupBy("category").count()
        short = need.join(have, "category", "left").where("coalesce(count, 0) < need")
        out = out.unionByName(
            short.select(
                F.col("category").alias("id"), F.lit("ERROR").alias("severity"),
                F.lit("CATEGORY_MINIMUM").alias("rule"),
            )
        )
    return out


def case_stats(cases: DataFrame, dimensions: list[str]) -> DataFrame:
    """Tallies over many dimensions in one pass (grouping sets)."""
    rows = cases.select(*[F.coalesce(F.col(d).cast("string"), F.lit("(none)")).alias(d)
                          for d in dimensions])
    long = rows.select(
        F.explode(
            F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"))
                      for d in dimensions])
        ).alias("x")
    )
    return long.groupBy("x.dimension", "x.value").agg(F.count(F.lit(1)).alias("cases"))


def case_totals(cases: DataFrame) -> DataFrame:
    """Overall counts and the mean gold size of cases that have gold."""
    gold = F.size("expectedDocuments")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if("answerable").alias("answerable"),
        F.count_if("shouldAbstain").alias("should_abstain"),
        F.count_if(F.col("reasoningSteps") >= 2).alias("multi_step"),
        F.count_if(F.size("distractorDocuments") > 0).alias("with_distractors"),
        F.count_if(F.size("requiredFacts") > 0).alias("with_facts"),
        F.count_if(F.size("forbiddenClaims") > 0).alias("with_forbidden"),
        F.round(F.avg(F.when(gold > 0, gold)), 2).alias("mean_gold"),
    )


def seed_corpus_map(corpus: DataFrame, documents: DataFrame) -> DataFrame:
    """Completed document of every corpus source by checksum; ``doc_id`` null = not ready.

    ``corpus`` has source, text; ``documents`` doc_id, checksum, status.
    """
    done = documents.where("status = 'COMPLETED'").groupBy("checksum").agg(
        F.min("doc_id").alias("doc_id")
    )
    return (
        corpus.dropDuplicates(["source", "text"])
        .select("source", F.sha2("text", 256).alias("checksum"))
        .join(done, "checksum", "left")
        .select("source", "checksum", "doc_id", F.col("doc_id").isNotNull().alias("ready"))
    )
