"""Evaluation and agent case files (S5, S6): declared schemas, defaults, violations as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as t

_STR = t.ArrayType(t.StringType())

EVAL_CASE = t.StructType(
    [
        t.StructField("id", t.StringType()),
        t.StructField("type", t.StringType()),
        t.StructField("question", t.StringType()),
        t.StructField("answerable", t.BooleanType()),
        t.StructField("expectedAnswer", t.StringType()),
        *[
            t.StructField(n, _STR)
            for n in (
                "acceptableAnswers", "expectedDocuments", "alternativeDocuments",
                "expectedChunks", "distractorDocuments", "requiredFacts", "forbiddenClaims",
            )
        ],
        t.StructField("shouldAbstain", t.BooleanType()),
        t.StructField("category", t.StringType()),
        t.StructField("difficulty", t.StringType()),
        t.StructField("reasoningSteps", t.IntegerType()),
        t.StructField("language", t.StringType()),
        t.StructField("negativeType", t.StringType()),
        t.StructField("expectedAction", t.StringType()),
        t.StructField("metadata", t.MapType(t.StringType(), t.StringType())),
        t.StructField(
            "corpus",
            t.ArrayType(
                t.StructType(
                    [t.StructField(n, t.StringType()) for n in ("title", "source", "text")]
                )
            ),
        ),
    ]
)
EVAL_DEFAULTS = {"difficulty": "medium", "reasoningSteps": 1, "language": "vi",
                 "shouldAbstain": False}

_CONSTRAINT = t.StructType(
    [
        t.StructField("path", t.StringType()),
        t.StructField("matches", t.StringType()),
        t.StructField("oneOf", _STR),
        t.StructField("required", t.BooleanType()),
    ]
)
AGENT_CASE = t.StructType(
    [
        t.StructField("id", t.StringType()),
        t.StructField("category", t.StringType()),
        t.StructField("input", t.StringType()),
        t.StructField("localTools", _STR),
        t.StructField("toolAllowlist", _STR),
        t.StructField("evaluators", _STR),
        t.StructField(
            "expectation",
            t.StructType(
                [
                    t.StructField("expectedAnswer", t.StringType()),
                    t.StructField("acceptableTools", _STR),
                    t.StructField("forbiddenTools", _STR),
                    t.StructField("expectedEvidence", _STR),
                    t.StructField(
                        "argumentConstraints",
                        t.MapType(t.StringType(), t.ArrayType(_CONSTRAINT)),
                    ),
                    t.StructField("maxSteps", t.IntegerType()),
                    t.StructField("maxToolCalls", t.IntegerType()),
                    t.StructField("mustAbstain", t.BooleanType()),
                    t.StructField("minSteps", t.IntegerType()),
                    t.StructField("answerMustNotContain", _STR),
                ]
            ),
        ),
    ]
)


def _read(spark: SparkSession, path: str, schema: t.StructType) -> DataFrame:
    full = t.StructType(schema.fields + [t.StructField("_corrupt", t.StringType())])
    rows = spark.read.schema(full).json(path, columnNameOfCorruptRecord="_corrupt")
    return rows.withColumn("file", F.regexp_extract(F.input_file_name(), r"([^/]+)$", 1))


def _violations(rows: DataFrame, required: list[str]) -> DataFrame:
    """``file, id, problem``: broken JSON, missing fields, ids used twice."""
    checks = [F.when(F.col("_corrupt").isNotNull(), F.lit("BAD_JSON"))]
    checks += [
        F.when(F.col("_corrupt").isNull() & F.col(c).isNull(), F.lit(f"MISSING_{c}"))
        for c in required
    ]
    own = rows.select(
        "file", "id",
        F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("problem"),
    )
    twice = rows.where("id is not null").groupBy("id").agg(
        F.count(F.lit(1)).alias("n"), F.min("file").alias("file")
    )
    return own.unionByName(
        twice.where("n > 1").select("file", "id", F.lit("DUPLICATE_ID").alias("problem"))
    )


def _fail_on(problems: DataFrame, rows: DataFrame) -> None:
    first = problems.limit(20).collect()  # a short message for the user, not the data
    if first:
        raise ValueError("invalid cases: " + "; ".join(f"{r.file} {r.id} {r.problem}" for r in first))
    if rows.isEmpty():
        raise ValueError("no cases found")


def read_eval_cases(
    spark: SparkSession, path: str, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(cases with defaults, violations). ``strict`` raises when there are violations."""
    rows = _read(spark, path, EVAL_CASE)
    problems = _violations(rows, ["id", "type", "question", "answerable", "corpus"])
    if strict:
        _fail_on(problems, rows)
    cases = rows.where("_corrupt is null").fillna(EVAL_DEFAULTS)
    for field in EVAL_CASE.fields:
        if isinstance(field.dataType, t.ArrayType) and field.name != "corpus":
            empty = F.array().cast(field.dataType)
            cases = cases.withColumn(field.name, F.coalesce(field.name, empty))
    return cases.drop("_corrupt"), problems


def read_agent_cases(
    spark: SparkSession, path: str, only: list[str] | None = None, strict: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Agent cases whose id or category is listed in ``only``."""
    rows = _read(spark, path, AGENT_CASE)
    problems = _violations(rows, ["id", "category", "input", "expectation"])
    if strict:
        _fail_on(problems, rows)
    cases = rows.where("_corrupt is null").drop("_corrupt")
    if only:
        cases = cases.where(F.col("id").isin(only) | F.col("category").isin(only))
    return cases, problems
