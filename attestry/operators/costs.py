"""Cost, audit and redaction."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as t

from attestry import fixed
from attestry.functions import text as T
from attestry.session import rank_within

SENSITIVE = "(?i)" + "|".join(fixed.SENSITIVE_KEYS)


def _price(table: dict[str, tuple[float, float]], key: Column, at: int) -> Column:
    prices = F.create_map(*[F.lit(x) for k, v in table.items() for x in (k, float(v[at]))])
    return F.try_element_at(prices, key)


def estimate_cost(
    provider: Column | str, model: Column | str, input_tokens: Column | str,
    output_tokens: Column | str,
) -> Column:
    """Model price, else the provider's default, per 1 000 tokens; six decimals."""
    p, m = T.col(provider), T.col(model)
    price = lambda at: F.coalesce(
        _price(fixed.MODEL_PRICES, m, at), _price(fixed.PROVIDER_PRICES, p, at), F.lit(0.0)
    )
    return T.js_round(
        T.col(input_tokens) / 1000 * price(0) + T.col(output_tokens) / 1000 * price(1), 6
    )


def redact_nested(value: Column, kind: t.DataType) -> Column:
    """Walk the whole schema; sensitive keys are masked, strings elsewhere redacted."""
    if isinstance(kind, t.StringType):
        return T.redact_text(value)
    if isinstance(kind, t.ArrayType):
        return F.transform(value, lambda v: redact_nested(v, kind.elementType))
    if isinstance(kind, t.MapType):
        if not isinstance(kind.valueType, t.StringType):
            # a typed value cannot hold the mask, so a sensitive entry keeps its key only
            return F.transform_values(
                value,
                lambda k, v: F.when(
                    ~F.regexp_like(k, F.lit(SENSITIVE)),
                    redact_nested(v, kind.valueType),
                ),
            )
        return F.transform_values(
            value,
            lambda k, v: F.when(
                F.regexp_like(k, F.lit(SENSITIVE)), F.lit(fixed.REDACTED)
            ).otherwise(redact_nested(v, kind.valueType)),
        )
    if isinstance(kind, t.StructType):
        fields = [
            (F.lit(fixed.REDACTED) if re.search(SENSITIVE, f.name)
             else redact_nested(value[f.name], f.dataType)).alias(f.name)
            for f in kind.fields
        ]
        return F.when(value.isNotNull(), F.struct(*fields))
    return value


def redact_columns(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """U2/U3 over whole columns, top-level names included."""
    names = df.columns if columns is None else columns
    return df.select(
        *[
            (
                F.lit(fixed.REDACTED)
                if re.search(SENSITIVE, f.name)
                else redact_nested(F.col(f.name), f.dataType)
            ).alias(f.name)
            if f.name in names
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def latency_percentiles(log: DataFrame, stage: str = "stage", ms: str = "ms") -> DataFrame:
    """U4: P50/75/90/95/99 and share of the total time per stage."""
    points = [0.5, 0.75, 0.9, 0.95, 0.99]
    # exact ranks from range slices: a stage with a third of the log is many tasks
    ranked = rank_within(log.where(F.col(ms).isNotNull()).select(stage, ms), [stage], [ms], "_r")
    sizes = log.groupBy(stage).agg(
        F.count(F.lit(1)).alias("n"), F.count(ms).alias("_m"), F.sum(ms).alias("_sum")
    )
    at = [F.lit(p) * (F.col("_m") - 1) + 1 for p in points]
    wanted = F.array(*[f(x).cast("long") for x in at for f in (F.floor, F.ceil)])
    ends = (
        ranked.join(sizes.select(stage, F.explode(F.array_distinct(wanted)).alias("_r")), [stage, "_r"])
        .groupBy(stage).agg(F.map_from_entries(F.collect_list(F.struct("_r", ms))).alias("_at"))
    )
    rows = sizes.join(ends, stage, "left").withColumn("_all", F.sum("_sum").over(W.partitionBy()))

    def between(x: Column) -> Column:
        low, high = F.try_element_at("_at", F.floor(x).cast("long")), F.try_element_at("_at", F.ceil(x).cast("long"))
        return low + (high - low) * (x - F.floor(x))

    return rows.select(
        stage, "n",
        *[F.round(between(x), 4).alias(f"p{int(p * 100)}") for p, x in zip(points, at)],
        F.round(F.col("_sum") / F.col("_all"), 4).alias("share"),
    )


def classify_errors(
    status: Column, code: Column, name: Column, message: Column
) -> tuple[Column, Column]:
    """(kind, retryable) of a model-provider error."""
    text = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *p: _any(text, p)
    network = F.lower(F.coalesce(code, F.lit(""))).isin(
        "econnreset", "econnrefused", "etimedout", "enotfound"
    ) | F.coalesce(name == "FetchError", F.lit(False))
    is_status = lambda *s: F.coalesce(status.isin(*s), F.lit(False))
    kind = (
        F.when(F.coalesce(name == "TimeoutError", F.lit(False)), "TIMEOUT")
        .when(network, "NETWORK")
        .when(is_status(401, 403) | has("api key"), "AUTH")
        .when(is_status(429) | has("rate limit"), "RATE_LIMIT")
        .when(has("quota", "resource_exhausted"), "QUOTA")
        .when(has("safety", "blocked", "recitation"), "SAFETY_BLOCK")
        .when(
            has("context length", "maximum context", "too many tokens", "max_tokens"),
            "TOKEN_LIMIT",
        )
        .when(is_status(529) | has("overloaded"), "OVERLOADED")
        .when(status >= 500, "SERVER_ERROR")
        .when(is_status(400, 422), "BAD_REQUEST")
        .otherwise("UNKNOWN")
    )
    return kind, kind.isin("TIMEOUT", "NETWORK", "RATE_LIMIT", "OVERLOADED", "SERVER_ERROR")


def _any(text: Column, parts) -> Column:
    found = F.lit(False)
    for part in parts:
        found = found | F.contains(text, F.lit(part))
    return found


def classify_tool_errors(
    message: Column, rpc_code: Column, context: Column
) -> tuple[Column, Column]:
    """(code, retryable) of an error raised by a remote tool provider."""
    text = F.lower(F.coalesce(message, F.lit("")))
    protocol = F.coalesce(rpc_code <= -32000, F.lit(False))
    code = (
        F.when(_any(text, ["timed out", "timeout", "etimedout"]), "MCP_TIMEOUT")
        .when(
            F.coalesce(context == "connect", F.lit(False))
            | _any(
                text,
                ["econnrefused", "enotfound", "socket hang up", "connection closed",
                 "fetch failed", "network"],
            ),
            "MCP_CONNECTION_ERROR",
        )
        .when(protocol & (rpc_code == -32601), "TOOL_NOT_FOUND")
        .when(protocol & (rpc_code == -32602), "TOOL_ARGUMENT_ERROR")
        .when(protocol, "MCP_PROTOCOL_ERROR")
        .when(_any(text, ["not found", "unknown tool"]), "TOOL_NOT_FOUND")
        .otherwise("MCP_REMOTE_ERROR")
    )
    return code, code.isin("MCP_TIMEOUT", "MCP_CONNECTION_ERROR")


_FENCED = re.compile(r"```(?:json)?\s*([\s\S]*?)```", re.IGNORECASE)
_MARKS = re.compile(r'"(?:[^"\\]|\\.)*(?:"|\Z)|[{}]', re.DOTALL)


def first_json_object(text: str) -> str:
    """The first balanced ``{...}`` of a reply, fences removed and strings respected."""
    body = text.strip()
    fence = _FENCED.search(body)
    if fence and fence.group(1):
        body = fence.group(1).strip()
    start = body.find("{")
    if start < 0:
        return body
    depth = 0
    for mark in _MARKS.finditer(body, start):
        depth += {"{": 1, "}": -1}.get(mark.group(), 0)
        if depth == 0:
            return body[start : mark.end()]
    return body[start:]


def extract_json(c: Column | str) -> Column:
    """JSON text of a model reply; parse it with ``from_json``."""

    @F.pandas_udf(t.StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else first_json_object(x))

    return run(T.col(c))


def usage_rollup(calls: DataFrame, dimensions: list[str]) -> DataFrame:
    """Tokens and cost with subtotals over the dimensions."""
    return calls.rollup(*dimensions).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        T.js_round(F.sum("cost"), 6).alias("cost"),
    )


def stage_progress(log: DataFrame) -> DataFrame:
    """U8: the few stages of each document in order with their times.

    ``log``: doc_id, stage, status, created_at, ms.
    """
    item = F.struct("created_at", "stage", "status", "ms")
    return log.groupBy("doc_id").agg(
        F.sort_array(F.collect_list(item)).alias("stages"), F.sum("ms").alias("total_ms")
    )
