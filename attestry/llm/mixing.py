"""Mixing by soft membership: every document belongs to all domains, by its posterior.

A naive Bayes classifier over binned properties of the text is counted from a labelled table. Its
posteriors spread each document's tokens over the domains, and projected gradient steps fit
nonnegative rates r_i so that the expected totals  sum_i r_i t_i p_i  come as near to the target
as they can in least squares, staying near 1 where that costs nothing. Squares are divided by the
domain's present total and steps by the document's tokens: the largest curvature is then 1, so
that steps of that length are safe, and small domains move as fast as large ones. A rate is how
many times a document should be read; the whole part is certain, the rest is drawn by a hash of
its id.

Steps that don't soon bring the totals to the target are given up for the optimum itself: with a
pull towards 1 it is  r_i = max(least, 1 - p_i l)  for K numbers l, the minimum of a convex and
piecewise quadratic function that Newton steps reach in a few aggregates. The pull is divided by ten
until the target is met or no rate can improve the squares (the projected gradient is near 0).

Documents with the same bins have the same posterior and so the same rate all along, which makes
one step an aggregate over the few distinct bins. The steps of all iterations are kept as K
numbers each, and a document's rate is a fold over them. Only DataFrame functions are used.
"""

from __future__ import annotations

import logging
import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.llm.common import staged

BINS = 16
SPACE = r"[\x20\x09-\x0D]+"

#: Gradient steps go on while each leaves at most this share of the distance to the target.
STEADY = 0.8
#: Lengths of a Newton step that one aggregate tries.
LENGTHS = (1.0, 0.3, 0.05)

log = logging.getLogger(__name__)


def _scale(share: Column) -> Column:
    """Bins of a share in 0..1, finer near 0: 0 for none, then by powers of two."""
    return F.when(share <= 0, 0).otherwise(F.greatest(F.lit(1), F.lit(BINS - 1) + F.floor(F.log2(share))))


def properties(text: Column) -> tuple[Column, list[Column]]:
    """Token count and the binned properties of a whole text; null counts as empty."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    tokens = F.call_function("regexp_count", text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    length = F.greatest(F.length(text), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    words = F.split(F.lower(text), SPACE)

    def share(pattern: str) -> Column:
        return F.call_function("regexp_count", text, F.lit(pattern)) / length

    def distinct(items: Column) -> Column:
        return F.round(F.size(F.array_distinct(items)) / F.greatest(F.size(items), F.lit(1)) * (BINS - 1))

    bins = [
        F.floor(F.log2(tokens + 1)),
        F.floor(F.length(text) / F.greatest(tokens, F.lit(1))),
        _scale(share(r"[^\p{L}\p{N}\s]")),
        _scale(share(r"[0-9]")),
        distinct(lines),
        distinct(words),
    ]
    return tokens, [F.least(F.greatest(b, F.lit(0)), F.lit(BINS - 1)).cast("int") for b in bins]


@dataclass
class Mixer:
    """Domains, their log priors and log likelihoods, and the residuals of the gradient steps.

    ``dual`` holds the optimum's numbers where steps were given up for it. ``gap`` is the largest
    distance of a total from its target, relative to the domain's present total.
    """

    domains: list[str]
    prior: list[float]
    likelihood: list[list[list[float]]]  # by domain, property and bin
    least: float = 0.0
    pull: float = 1e-4
    residuals: tuple[tuple[float, ...], ...] = ()
    totals: tuple[float, ...] = ()
    target: tuple[float, ...] = ()
    dual: tuple[float, ...] = ()
    gap: float = 0.0

    def posterior(self, bins: Column) -> Column:
        """array<double> of the domains' probabilities, in the order of their names."""
        logs = []
        for d in range(len(self.domains)):
            terms = F.lit(self.prior[d])
            for j, row in enumerate(self.likelihood[d]):
                terms = terms + F.element_at(F.array(*map(F.lit, row)), bins[j] + 1)
            logs.append(terms)
        scores = F.array(*logs)
        parts = F.transform(scores, lambda s: F.exp(s - F.array_max(scores)))
        return F.transform(parts, lambda e: e / F.aggregate(parts, F.lit(0.0), lambda a, x: a + x))

    def rate(self, posterior: Column) -> Column:
        """The rate after all steps so far, or the optimum's."""
        if self.dual:
            return F.greatest(F.lit(float(self.least)), 1.0 - _dot(posterior, self.dual))
        if not self.residuals:
            return F.greatest(F.lit(1.0), F.lit(float(self.least)))
        step = 1.0 / (1.0 + self.pull)
        moves = F.array(*[F.array(*map(F.lit, r)) for r in self.residuals])

        def move(rate: Column, residual: Column) -> Column:
            slope = F.aggregate(F.zip_with(posterior, residual, lambda p, g: p * g), F.lit(0.0), lambda a, x: a + x)
            return F.greatest(F.lit(float(self.least)), rate - step * (slope + self.pull * (rate - 1.0)))

        return F.aggregate(moves, F.lit(1.0), move)


def _dot(posterior: Column, numbers: tuple[float, ...]) -> Column:
    return sum((posterior[d] * F.lit(float(x)) for d, x in enumerate(numbers)), F.lit(0.0))


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A stage table of (doc_id, tokens, bins): all that is read of the texts, once."""
    tokens, bins = properties(F.col(text_col))
    return staged(docs.select(F.col(id_col).alias("doc_id"), tokens.alias("tokens"), F.array(*bins).alias("bins")))


def count_domains(described: DataFrame, labels: DataFrame, domain: Column, id_col: str = "doc_id") -> Mixer:
    """Count the classifier from the documents that have a label; nulls are no label."""
    marked = labels.select(F.col(id_col).alias("doc_id"), domain.cast("string").alias("domain")).filter(
        "doc_id IS NOT NULL AND domain IS NOT NULL"
    ).distinct()
    known = marked.join(described.select("doc_id", "bins"), "doc_id")
    cells = (
        known.select("domain", F.posexplode("bins").alias("property", "bin"))
        .groupBy("domain", "property", "bin").agg(F.count(F.lit(1)).alias("n")).collect()
    )  # at most domains x properties x BINS rows
    domains = sorted({c["domain"] for c in cells})
    counts = {(c["domain"], c["property"], c["bin"]): c["n"] for c in cells}
    width = 1 + max((c["property"] for c in cells), default=-1)
    sizes = [sum(counts.get((d, 0, b), 0) for b in range(BINS)) for d in domains]
    return Mixer(
        domains,
        [math.log(n / sum(sizes)) for n in sizes],
        [[[math.log((counts.get((d, j, b), 0) + 0.5) / (n + 0.5 * BINS)) for b in range(BINS)] for j in range(width)]
         for d, n in zip(domains, sizes)],
    )


def fit_rates(described: DataFrame, mixer: Mixer, weights: dict[str, float], budget: float | None = None,
              least: float = 0.0, steps: int = 200, tolerance: float = 1e-3) -> Mixer:
    """Rates that bring every domain's expected total within ``tolerance``, or else as near as any can.

    ``weights`` are the wanted shares of the domains, scaled to sum 1 over those that were
    learned; ``budget`` is the wanted total in units of all tokens, by default 1, or, if every
    document is to be read at least once (``least`` = 1), what the domain that is most over its
    share then needs and 15 % for what the others carry into it. ``tolerance`` is relative
    to the domain's present total. If projected gradient steps (``steps`` at most) don't get there
    quickly, ``_optimum`` is taken; a default budget with ``least`` >= 1 is then what the shares
    need. The gap that remains is the result's ``gap``, and logged where above ``tolerance``.
    """
    wanted = [max(0.0, float(weights.get(d, 0.0))) for d in mixer.domains]
    if not mixer.domains or sum(wanted) <= 0:
        return mixer
    wanted = [w / sum(wanted) for w in wanted]
    profiles = staged(
        described.groupBy("bins").agg(F.sum("tokens").alias("tokens"))
        .select("tokens", mixer.posterior(F.col("bins")).alias("posterior"))
    )
    total = profiles.agg(F.sum("tokens")).first()[0] or 0
    if not total:
        return mixer
    k = len(mixer.domains)

    def expected(now: Mixer) -> tuple[float, ...]:
        share = F.col("tokens") / float(total) * now.rate(F.col("posterior"))
        row = profiles.agg(*[F.sum(share * F.col("posterior")[d]).alias(f"d{d}") for d in range(k)]).first()
        return tuple(float(row[d]) for d in range(k))

    now = Mixer(mixer.domains, mixer.prior, mixer.likelihood, least)
    start = expected(Mixer(mixer.domains, mixer.prior, mixer.likelihood))
    sizes = [s if s > 0 else 1.0 for s in start]
    free = budget is None and least >= 1
    if budget is None:
        budget = 1.15 * max(s / w for s, w in zip(start, wanted) if w > 0) if least >= 1 else 1.0
    target = tuple(budget * w for w in wanted)
    totals = start if least <= 1 else expected(now)

    def distance(totals: tuple[float, ...]) -> float:
        return max(abs(a - b) / size for a, b, size in zip(totals, target, sizes))

    near = distance(totals)
    for _ in range(steps):
        residual = tuple((a - b) / size for a, b, size in zip(totals, target, sizes))
        now = replace(now, residuals=(*now.residuals, residual))
        totals = expected(now)
        before, near = near, distance(totals)
        if near <= tolerance or near > STEADY * before:
            break
    if near <= tolerance:
        return replace(now, totals=totals, target=target, gap=near)
    return _optimum(profiles, total, replace(now, residuals=(), target=target), sizes, wanted, free, tolerance)


def _optimum(profiles: DataFrame, total: float, now: Mixer, sizes: list[float], wanted: list[float],
             free: bool, tolerance: float) -> Mixer:
    """The least-squares rates nearest to 1, to a projected gradient of ``tolerance`` / 50 or the target.

    For a pull e the rates are  max(least, 1 - p_i l),  and l is where the gradient
    e s l + target - totals  of the dual function is 0. If the budget is ``free``, the target is
    any multiple of ``wanted``, which adds the condition  wanted l = 0.
    """
    k, least, pull = len(sizes), float(now.least), now.pull
    share = F.col("tokens") / float(total)
    p = [F.col("posterior")[d] for d in range(k)]
    s, w, b = np.array(sizes), np.array(wanted), np.zeros(k) if free else np.array(now.target)

    def look(tries: list[np.ndarray]) -> list[tuple[float, np.ndarray, np.ndarray, float]]:
        """For each l: the dual sum, the totals, their change with l, and the squares of free rates' moves."""
        sums = []
        for l in tries:
            slope = _dot(F.col("posterior"), tuple(l))
            rate = F.greatest(F.lit(least), 1.0 - slope)
            loose = (1.0 - slope) > least
            sums.append(F.sum(share * (0.5 * (rate - 1.0) * (rate - 1.0) + rate * slope)))
            sums += [F.sum(share * rate * x) for x in p]
            sums += [F.sum(F.when(loose, share * p[i] * p[j]).otherwise(0.0)) for i in range(k) for j in range(i, k)]
            sums.append(F.sum(F.when(loose | (slope < 0), share * slope * slope).otherwise(0.0)))
        row = [float(x) for x in profiles.agg(*[c.alias(f"c{i}") for i, c in enumerate(sums)]).first()]
        out, width = [], len(row) // len(tries)
        for at in range(0, len(row), width):
            part = row[at : at + width]
            bend = np.zeros((k, k))
            bend[np.triu_indices(k)] = part[1 + k : -1]
            out.append((part[0], np.array(part[1 : 1 + k]), bend + np.triu(bend, 1).T, part[-1]))
        return out

    def value(l: np.ndarray, dual_sum: float) -> float:
        return 0.5 * pull * float(s @ (l * l)) + float(b @ l) - dual_sum

    at = np.zeros(k)
    seen = look([at])[0]
    while True:
        while True:
            dual_sum, totals, bend, moves = seen
            gradient = pull * s * at + b - totals
            system, right = np.diag(pull * s) + bend, -gradient
            if free:
                system = np.block([[system, w[:, None]], [w[None, :], np.zeros((1, 1))]])
                right = np.append(right, -(w @ at))
            answer = np.linalg.solve(system, right)
            move, target = answer[:k], answer[k] * w if free else b
            left = np.abs(gradient + (target if free else 0.0)) / s
            if left.max() <= tolerance / 50:
                break
            fall, length, now_value, found = float(gradient @ move), 1.0, value(at, dual_sum), None
            while found is None and length > 1e-9:
                tries = [at + length * x * move for x in LENGTHS]
                for x, l, got in zip(LENGTHS, tries, look(tries)):
                    if found is None and value(l, got[0]) <= now_value + 1e-4 * length * x * fall:
                        found = l, got
                length *= LENGTHS[-1] / 4
            if found is None:  # no length improves it in double precision
                break
            at, seen = found
        gap = float((np.abs(totals - target) / s).max())
        if gap <= tolerance or pull * math.sqrt(moves) <= tolerance / 50:
            break
        pull /= 10
    if gap > tolerance:
        log.warning("mixing: the target lies outside what rates can reach; largest relative gap %.4f", gap)
    return replace(now, pull=pull, totals=tuple(map(float, totals)), target=tuple(map(float, target)),
                   dual=tuple(map(float, at)), gap=gap)


def copies(rate: Column, key: Column, seed: int) -> Column:
    """How often a row is read: its rate's whole part, and one more if its draw is below the rest."""
    draw = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], least: float = 0.0,
        budget: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, posterior, rate and copies of every row of ``docs``.

    Null and empty texts have no tokens and change no total, but get a rate as any other. With no
    labelled document, or no wanted domain among the learned ones, all rates are 1. Rows with
    null ids are drawn together; repeated rows alike. Other columns aren't read.
    """
    described = describe(docs, id_col, text_col)
    mixer = fit_rates(described, count_domains(described, labels, domain, id_col), weights, budget, least)
    return _rated(described, mixer).select(
        "doc_id", F.col("tokens").alias("n_tokens"), "posterior", "rate",
        copies(F.col("rate"), F.col("doc_id"), seed).alias("copies"),
    )


def _rated(described: DataFrame, mixer: Mixer) -> DataFrame:
    if not mixer.domains:
        return described.withColumn("posterior", F.array().cast("array<double>")).withColumn(
            "rate", F.greatest(F.lit(1.0), F.lit(float(mixer.least)))
        )
    with_p = described.withColumn("posterior", mixer.posterior(F.col("bins")))
    return with_p.withColumn("rate", mixer.rate(F.col("posterior")))


def mixed(docs: DataFrame, labels: DataFrame, domain: Column, weights: dict[str, float], least: float = 0.0,
          budget: float | None = None, seed: int = 42, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, each as often as ``mix`` says, with the same columns."""
    described = describe(docs, id_col, text_col)
    mixer = fit_rates(described, count_domains(described, labels, domain, id_col), weights, budget, least)
    tokens, bins = properties(F.col(text_col))
    names = docs.columns
    rows = docs.select(F.struct(*[docs[c] for c in names]).alias("row"), F.col(id_col).alias("doc_id"),
                       tokens.alias("tokens"), F.array(*bins).alias("bins"))
    counted = _rated(rows, mixer).withColumn("copies", copies(F.col("rate"), F.col("doc_id"), seed))
    return counted.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("row.*")
