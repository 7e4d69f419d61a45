"""Mixing to target weights by soft membership.

A naive Bayes classifier over hashed beginnings and endings of words, fitted on a labelled table, gives every
document a posterior over domains.  Projected gradient descent then fits one
nonnegative rate per document so that each domain's expected tokens meet its target.
Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fraction_filter, materialize

#: Hash buckets of the classifier, sharpness of its softmax over the mean log-odds, the
#: documented bound on labelled rows that it is fitted on, and the descent's steps.
BUCKETS, SHARPNESS, MAX_LABELLED, STEPS, TOLERANCE = 4096, 12.0, 4000, 25, 1e-5
#: Letters at either end of a word by which it is hashed: shorter words whole, longer ones
#: by what tells languages best, also of words that no labelled document has.
ENDS = 2
SLACK = 1.05
#: Labelled rows that are drawn of a scarce domain whatever the bound (all, if it has fewer).
LEAST_OF_DOMAIN = 100


def words(text: str) -> Column:
    """Lower-cased words of the whole text."""
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bucket(word: Column) -> Column:
    """Hash of the word's first and last letters, from 1."""
    ends = F.xxhash64(F.left(word, F.lit(ENDS)), F.right(word, F.lit(ENDS)))
    return (F.pmod(ends, F.lit(BUCKETS)) + 1).cast("int")


def _literal(values: list[float]) -> Column:
    """An array<double> that is folded into one literal."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def _sum_of(table: Column, ids: Column) -> Column:
    return F.aggregate(ids, F.lit(0.0), lambda s, i: s + F.element_at(table, i))


@dataclass
class Domains:
    names: list[str]
    odds: list[list[float]]  # log-odds of each bucket against the first domain

    def add_posteriors(self, df: DataFrame, text: str, tokens: str = "tokens", out: str = "p") -> DataFrame:
        """df with its number of words and array<double> in the order of names: the softmax of the mean log-odds.

        Each step is a projection of its own, so that no expression is evaluated twice.
        """
        n, given = len(self.names), df.columns
        kept = [F.col(f"`{c}`") for c in given if c not in (tokens, out)]
        df = df.select(*kept, words(text).alias("__words"))
        if n < 2:
            return df.select(*kept, F.size("__words").cast("long").alias(tokens), F.array(*[F.lit(1.0)] * n).cast("array<double>").alias(out))
        df = df.select(*kept, F.size("__words").cast("long").alias(tokens), F.transform("__words", bucket).alias("__ids"))
        mean = lambda odds: _sum_of(_literal(odds), F.col("__ids")) * (SHARPNESS / F.greatest(F.col(tokens), F.lit(1)))
        df = df.select(*kept, tokens, F.lit(0.0).alias("__s0"), *[mean(self.odds[k]).alias(f"__s{k}") for k in range(1, n)])
        top = F.greatest(*[F.col(f"__s{k}") for k in range(n)])
        df = df.select(*kept, tokens, *[f"__s{k}" for k in range(n)], top.alias("__top"))
        df = df.select(*kept, tokens, *[F.exp(F.col(f"__s{k}") - F.col("__top")).alias(f"__e{k}") for k in range(n)])
        df = df.select(*kept, tokens, *[f"__e{k}" for k in range(n)], sum((F.col(f"__e{k}") for k in range(n)), F.lit(0.0)).alias("__all"))
        return df.select(*kept, tokens, F.array(*[F.col(f"__e{k}") / F.col("__all") for k in range(n)]).alias(out))


def fit_domains(docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", limit: int = MAX_LABELLED) -> Domains:
    """Fit on about ``limit`` labelled documents, picked by a hash of the id.

    Domains that this draws fewer than limit / domains (or LEAST_OF_DOMAIN) rows of are
    drawn up to that number, so a scarce domain is learned from all its rows; that adds
    at most as many rows again, or LEAST_OF_DOMAIN a domain.  Only domains x BUCKETS counts
    reach the driver.  Null domains and those without a word are not learned.
    """
    known = labelled.where(F.col(domain_col).isNotNull()).select(F.col(id_col).alias("lid"), F.col(domain_col).cast("string").alias("dom"))
    totals = {r.dom: r["count"] for r in known.groupBy("dom").count().collect()}
    if not totals:
        return Domains([], [])
    rate, least = min(1.0, limit / sum(totals.values())), max(limit / len(totals), LEAST_OF_DOMAIN)
    wanted = fraction_filter(rate, "lid")
    for name, n in sorted(totals.items()):
        if rate * n < min(n, least):
            wanted = wanted | ((F.col("dom") == name) & fraction_filter(min(1.0, least / n), "lid"))
    picked = known.where(wanted).dropDuplicates(["lid"])
    seen = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("t")).join(F.broadcast(picked), "lid")
    counts = seen.select("dom", F.explode(F.transform(words("t"), bucket)).alias("b")).groupBy("dom", "b").count().collect()
    names = sorted({r.dom for r in counts})
    logs = []
    for name in names:
        own = [0.5] * BUCKETS
        for r in counts:
            if r.dom == name:
                own[r.b - 1] += r["count"]
        whole = sum(own)
        logs.append([math.log(c / whole) for c in own])
    return Domains(names, [[round(x - y, 6) for x, y in zip(row, logs[0], strict=True)] for row in logs])


def _rate(p: Column, residuals: list[list[float]]) -> Column:
    """The descent so far, replayed for one document: x <- max(0, x - p . r) from x = 1."""
    x = F.lit(1.0)
    for r in residuals:
        x = F.greatest(F.lit(0.0), x - sum((p[k] * F.lit(v) for k, v in enumerate(r)), F.lit(0.0)))
    return x


def fit_rates(members: DataFrame, domains: int, targets: list[float] | None = None, total_tokens: float | None = None, weights: list[float] | None = None) -> tuple[list[list[float]], list[float]]:
    """Residuals of the projected gradient descent, and the targets in tokens.

    members: (tokens, p).  Minimises sum_k (domain tokens_k - target_k)^2 / size_k over
    rates >= 0.  In the metric of the documents' tokens the gradient of a document is
    p . (residual / size), with Lipschitz constant 1, so the step is 1.  One
    aggregate of as many numbers as domains is a step; documents' rates are replayed
    from the residuals, so nothing per document is ever kept between steps.
    """
    w = F.col("tokens").cast("double")
    size = members.agg(*[F.coalesce(F.sum(w * F.col("p")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(domains)]).first()
    sizes = [float(s) for s in size]
    if sum(sizes) <= 0:
        return [], [0.0] * domains
    if targets is None:
        want = weights or [1.0 / domains] * domains
        # by default a little over the least total at which no domain is thinned out
        whole = total_tokens if total_tokens is not None else SLACK * max(s / v for s, v in zip(sizes, want, strict=True) if v > 0)
        targets = [whole * v for v in want]
    residuals: list[list[float]] = []
    for _ in range(STEPS):
        x = _rate(F.col("p"), residuals)
        got = members.agg(*[F.coalesce(F.sum(w * F.col("p")[k] * x), F.lit(0.0)) for k in range(domains)]).first()
        r = [(float(g) - t) / s if s > 0 else 0.0 for g, t, s in zip(got, targets, sizes, strict=True)]
        # rounded, so that the order of summation cannot change a decision
        residuals.append([round(v, 9) for v in r])
        if max(abs(v) * s / max(t, 1.0) for v, s, t in zip(r, sizes, targets, strict=True)) < TOLERANCE:
            break
    return residuals, targets


def mix(docs: DataFrame, labelled: DataFrame, weights: dict[str, float] | None = None, temper: float = 0.7, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "domain", total_tokens: float | None = None, prefix: str = "mix_") -> DataFrame:
    """All columns of docs and: mix_tokens long, mix_posterior array<double>, mix_rate double, mix_copies long.

    weights: target share of expected tokens by domain (scaled to sum to 1; a domain
    without one gets none); by default the shares to the power ``temper``.  A positive
    weight of a domain that no labelled document taught raises an error.
    total_tokens: expected tokens of the result, by default the least that thins no
    domain, and SLACK more.  mix_copies rounds the rate up or down by a hash of id and text, so its
    expectation is the rate.

    Two narrow scans and one small aggregate per step: no text is shuffled.

    Edge cases: a null or empty text has no tokens, equal scores for all domains before
    the softmax, and rate 1; without labelled rows every rate is 1 and posteriors are
    empty; repeated rows get equal rates; an empty table gives an empty result.  Columns
    of docs that are named like new ones raise an error: choose another ``prefix``.
    """
    tokens, posterior, rate_of, copies = (f"{prefix}{c}" for c in ("tokens", "posterior", "rate", "copies"))
    if clash := {tokens, posterior, rate_of, copies} & set(docs.columns):
        raise ValueError(f"docs has columns named like new ones: {sorted(clash)}")
    fitted = fit_domains(docs, labelled, id_col, text_col, domain_col)
    n = len(fitted.names)
    unknown = sorted(name for name, v in (weights or {}).items() if v > 0 and name not in fitted.names)
    if unknown:
        raise ValueError(f"weights name domains without a labelled document to learn from: {', '.join(unknown)}")
    out = fitted.add_posteriors(docs, text_col, tokens, posterior)
    members = materialize(out.select(F.col(tokens).alias("tokens"), F.col(posterior).alias("p")), "mixing") if n else None
    residuals: list[list[float]] = []
    if n:
        if weights is None:
            sums = [float(s or 0) for s in members.agg(*[F.sum(F.col("tokens") * F.col("p")[k]) for k in range(n)]).first()]
            raw = [max(s, 0.0) ** temper for s in sums]
        else:
            raw = [max(0.0, weights.get(name, 0.0)) for name in fitted.names]
        share = [round(v / sum(raw), 9) for v in raw] if sum(raw) > 0 else [1.0 / n] * n
        residuals, _ = fit_rates(members, n, total_tokens=total_tokens, weights=share)
    rate = _rate(F.col(posterior), residuals) if n else F.lit(1.0)
    out = out.withColumn(rate_of, F.when(F.col(tokens) > 0, F.round(rate, 6)).otherwise(F.lit(1.0)))
    coin = F.pmod(F.xxhash64(F.lit("mix"), F.col(id_col), F.length(text_col)), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return out.withColumn(copies, F.floor(F.col(rate_of) + coin))
