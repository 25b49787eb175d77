"""Column functions that judge an answer or a claim-chunk pair."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestry import fixed
from attestry.functions import text as T


def contains_any(c: Column, phrases: list[str]) -> Column:
    return reduce(or_, [F.contains(c, F.lit(p)) for p in phrases], F.lit(False))


def _plain(answer: Column) -> Column:
    return T.js_trim(F.lower(F.coalesce(answer, F.lit(""))))


def is_abstention(
    answer: Column | str,
    strong: list[str] | None = None,
    weak: list[str] | None = None,
    weak_max_words: int = fixed.WEAK_ABSTENTION_MAX_WORDS,
) -> Column:
    """V2: empty, a clear refusal anywhere, or a vague one in a short answer (NFC text)."""
    text = _plain(T.col(answer))
    return (
        (text == "")
        | contains_any(text, fixed.STRONG_ABSTENTION if strong is None else strong)
        | (
            contains_any(text, fixed.WEAK_ABSTENTION if weak is None else weak)
            & (T.word_count(text) <= weak_max_words)
        )
    )


def is_pointer_answer(answer: Column | str, max_words: int = fixed.POINTER_MAX_WORDS) -> Column:
    """V3: a short answer without figures that only says where to look."""
    text = _plain(T.col(answer))
    # The boundary before a word is an ASCII one: a word character must not precede an ASCII
    # start, and must precede a non-ASCII start.
    ascii_nouns = "|".join(n for n in fixed.STRUCTURE_NOUNS if n[0].isascii())
    other_nouns = "|".join(n for n in fixed.STRUCTURE_NOUNS if not n[0].isascii())
    number = rf"[{T.WS}]+[0-9]+"
    stripped = T.replace(text, r"\[[0-9]+\]", " ")
    stripped = T.replace(
        stripped,
        rf"(?:(?<![A-Za-z0-9_])(?:{ascii_nouns})|(?<=[A-Za-z0-9_])(?:{other_nouns})){number}",
        " ",
    )
    before_ascii = "|".join(w for w in fixed.POINTER_BEFORE_INDEX if w[0].isascii())
    before_other = "|".join(w for w in fixed.POINTER_BEFORE_INDEX if not w[0].isascii())
    before = (
        rf"(?:(?<![A-Za-z0-9_])(?:{before_ascii})|(?<=[A-Za-z0-9_])(?:{before_other}))"
        rf"[{T.WS}]*\[[0-9]+\]"
    )
    after = rf"\[[0-9]+\][{T.WS}]*(?:{'|'.join(fixed.POINTER_AFTER_INDEX)})"
    points = (
        contains_any(text, fixed.POINTER_PHRASES)
        | F.regexp_like(text, F.lit(before))
        | F.regexp_like(text, F.lit(after))
    )
    return (
        (text != "")
        & (T.word_count(text) <= max_words)
        & ~F.regexp_like(stripped, F.lit("[0-9]"))
        & points
    )


def overlap_ratio(part: Column, whole: Column) -> Column:
    """Share of the distinct tokens ``part`` found in ``whole``; null when ``part`` is empty."""
    n = F.size(part)
    return F.when(n > 0, F.size(F.array_intersect(part, whole)) / n)


def lexical_grounding_ratio(answer_tokens: Column, context_tokens: Column) -> Column:
    """V4: share of content tokens backed by the context; 1 for an empty answer."""
    return F.coalesce(T.js_round(overlap_ratio(answer_tokens, context_tokens)), F.lit(1.0))


def generation_status(
    status: Column,
    answer: Column,
    used_context: Column,
    self_report: Column,
    lexical_ratio: Column,
    token_count: Column,
    strict: bool = True,
    min_ratio: float = 0.4,
    min_tokens: int = 5,
) -> Column:
    """V5: struct ``status, downgraded, regenerate, reason``; the first rule that fits wins."""

    def verdict(new, downgraded, regenerate, reason) -> Column:
        return F.struct(
            (new if isinstance(new, Column) else F.lit(new)).alias("status"),
            (downgraded if isinstance(downgraded, Column) else F.lit(downgraded))
            .alias("downgraded"),
            F.lit(regenerate).alias("regenerate"),
            F.lit(reason).cast("string").alias("reason"),
        )

    grounded = status == "GROUNDED"
    claims_support = status.isin("GROUNDED", "PARTIALLY_GROUNDED")
    on = F.lit(strict)
    return (
        F.when(
            is_abstention(answer),
            verdict(
                "INSUFFICIENT_EVIDENCE", status != "INSUFFICIENT_EVIDENCE", False,
                "answer_is_abstention",
            ),
        )
        .when(
            claims_support & (used_context == 0),
            verdict("INSUFFICIENT_EVIDENCE", True, False, "grounded_but_no_citation"),
        )
        .when(status == "CONFLICTING_EVIDENCE", verdict(status, False, False, None))
        .when(
            on & claims_support & is_pointer_answer(answer),
            verdict("PARTIALLY_GROUNDED", grounded, True, "pointer_answer"),
        )
        .when(
            on & grounded & ~self_report,
            verdict("PARTIALLY_GROUNDED", True, False, "llm_self_report_ungrounded"),
        )
        .when(
            on & claims_support & (token_count >= min_tokens) & (lexical_ratio < min_ratio),
            verdict("PARTIALLY_GROUNDED", grounded, True, "low_lexical_grounding"),
        )
        .otherwise(verdict(status, False, False, None))
    )


def _polarity(text: Column, negatives: list[str], positives: list[str]) -> tuple[Column, Column]:
    """(has negative, has positive after the negatives were taken out)."""
    stripped = text
    for phrase in negatives:
        stripped = F.replace(stripped, F.lit(phrase), F.lit(" "))
    return contains_any(text, negatives), contains_any(stripped, positives)


def clear_polarity(text: Column) -> tuple[Column, Column]:
    """Two bit sets over the topics of V13a: clearly negative ones and clearly positive ones."""
    negative, positive = F.lit(0), F.lit(0)
    for i, (negatives, positives) in enumerate(fixed.OPPOSED_PHRASES):
        neg, pos = _polarity(text, negatives, positives)
        negative = negative.bitwiseOR(F.when(neg & ~pos, F.lit(1 << i)).otherwise(0))
        positive = positive.bitwiseOR(F.when(pos & ~neg, F.lit(1 << i)).otherwise(0))
    return negative, positive


def opposed(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    """On one topic one side is clearly negative and the other positive."""
    return (a[0].bitwiseAND(b[1]) != 0) | (a[1].bitwiseAND(b[0]) != 0)


def disjoint_units(a: Column, b: Column) -> Column:
    """First unit both sides give numbers for without sharing any value, else null."""
    shared_pairs = F.array_intersect(a, b)
    clash = F.filter(
        F.array_distinct(F.transform(a, lambda x: x["unit"])),
        lambda u: F.exists(b, lambda y: y["unit"] == u)
        & ~F.exists(shared_pairs, lambda s: s["unit"] == u),
    )
    return F.get(clash, F.lit(0))


def contradiction(
    overlap: Column,
    claim_polarity: tuple[Column, Column],
    chunk_polarity: tuple[Column, Column],
    claim_units: Column,
    chunk_units: Column,
    min_overlap: float = 0.3,
) -> Column:
    """Same subject, then opposed wording or different figures for one unit."""
    close = F.coalesce(overlap, F.lit(0.0)) >= min_overlap
    return close & (
        opposed(claim_polarity, chunk_polarity)
        | disjoint_units(claim_units, chunk_units).isNotNull()
    )


def jaccard(a: Column, b: Column) -> Column:
    inter = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - inter
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(inter / union)


def root_cause(
    chunks: Column, conflict: Column, avg_score: Column, contradicted: Column,
    supported: Column, total: Column,
) -> Column:
    """Why an answer is not grounded."""
    return (
        F.when(chunks == 0, "RETRIEVAL_FAILURE")
        .when(conflict, "CONFLICTING_CONTEXT")
        .when(avg_score < 0.3, "IRRELEVANT_CONTEXT")
        .when((contradicted > 0) | (supported < total * 0.5), "GENERATION_HALLUCINATION")
        .otherwise("MISSING_CONTEXT")
    )


def final_status(
    status: Column, contradicted: Column, supported: Column, total: Column, grounded: Column,
    cause: Column,
) -> Column:
    """Status after verification."""
    conflict = (contradicted > 0) | (F.coalesce(cause, F.lit("")) == "CONFLICTING_CONTEXT")
    return (
        F.when(conflict, "CONFLICTING_EVIDENCE")
        .when((total > 0) & (supported == 0), "INSUFFICIENT_EVIDENCE")
        .when(~grounded & (status == "GROUNDED"), "PARTIALLY_GROUNDED")
        .otherwise(status)
    )
