"""Calibration, completion quality and preference pairs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialize
from .validate import parse_completions, rule_filter

# Whether a schema binds the answer, and the temperature, of each setting of a candidate.
SETTINGS = [(True, 0.1), (True, 0.3), (False, 0.5), (False, 0.8)]

# Edges of ten equal bins as binary floating point has them.
BIN_EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def calibration_bins(df: DataFrame) -> DataFrame:
    """(bin, n, confidence, accuracy); the first bin is closed on both ends, the rest on the right."""
    c = F.col("confidence")
    which = F.when((c >= 0) & (c <= BIN_EDGES[1]), 0)
    for i in range(1, 10):
        which = which.when((c > BIN_EDGES[i]) & (c <= BIN_EDGES[i + 1]), i)
    return df.select(which.alias("bin"), "confidence", F.col("correct").cast("double").alias("ok")).where(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg("ok").alias("accuracy"),
    )


def calibration_error(df: DataFrame) -> DataFrame:
    """One row (error): the bins' absolute gaps weighted by their share; 0 for no rows."""
    bins = calibration_bins(df)
    total = df.agg(F.count("*").alias("total"))
    return bins.crossJoin(F.broadcast(total)).agg(F.coalesce(F.sum(F.col("n") / F.col("total") * F.abs(F.col("confidence") - F.col("accuracy"))), F.lit(0.0)).alias("error"))  # total is one row


def platt(df: DataFrame):
    """Logistic fit of correct on confidence with penalty 1/n; a model with transform()."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    n, classes = df.agg(F.count("*"), F.countDistinct("correct")).first()
    if classes < 2:
        raise ValueError("both outcomes are needed")
    rows = VectorAssembler(inputCols=["confidence"], outputCol="x").transform(df.select("confidence", F.col("correct").cast("double").alias("label")))
    return LogisticRegression(featuresCol="x", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=200, tol=1e-10).fit(rows)


def completion_quality(completions: DataFrame, keys: list[str], text_col: str = "completion") -> DataFrame:
    """keys, attempted, kept, score: triples that survive strict parsing and the rules, by lenient ones."""
    lenient = parse_completions(completions, text_col, strict=False).where("drop_reason IS NULL").groupBy(*keys).agg(F.count("*").alias("attempted"))
    kept = rule_filter(parse_completions(completions, text_col, strict=True)).where("drop_reason IS NULL").groupBy(*keys).agg(F.count("*").alias("kept"))
    out = completions.select(*keys).distinct().join(lenient, keys, "left").join(kept, keys, "left")
    attempted, k = F.coalesce("attempted", F.lit(0)), F.coalesce("kept", F.lit(0))
    return out.select(*keys, attempted.cast("long").alias("attempted"), k.cast("long").alias("kept"), F.when(attempted > 0, k / attempted).otherwise(0.0).alias("score"))


def candidates(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], least_attempted: int = 2) -> DataFrame:
    """chunk_id, setting, completion, attempted, kept, score of each chunk's completions under SETTINGS.

    ask: (chunk_id, text, setting, schema, temperature) to the same rows with a completion.
    Completions of too few triples are left out.
    """
    rows = [F.struct(F.lit(i).alias("setting"), F.lit(schema).alias("schema"), F.lit(heat).alias("temperature")) for i, (schema, heat) in enumerate(SETTINGS)]
    said = ask(chunks.select("chunk_id", "text", F.explode(F.array(*rows)).alias("s")).select("chunk_id", "text", "s.*"))
    said = materialize(said.select("chunk_id", "setting", "completion"), "candidates")
    scored = completion_quality(said, ["chunk_id", "setting"]).where(F.col("attempted") >= least_attempted)
    return said.join(scored, ["chunk_id", "setting"])


def preference_pairs(candidates: DataFrame, least_gap: float = 0.25, least_attempted: int = 2) -> DataFrame:
    """prompt, chosen, rejected and their scores: each prompt's best and worst candidate (ties to the
    smaller text), if two or more candidates count and the gap is wide enough."""
    ok = candidates.where(F.col("attempted") >= least_attempted)
    per = ok.groupBy("prompt").agg(
        F.count("*").alias("n"), F.min(F.struct(-F.col("score"), "completion")).alias("best"),
        F.min(F.struct("score", "completion")).alias("worst"), F.max("score").alias("hi"), F.min("score").alias("lo"),
    )
    wide = per.where((F.col("n") >= 2) & (F.col("hi") - F.col("lo") >= least_gap))
    return wide.select(
        "prompt", F.col("best.completion").alias("chosen"), F.col("worst.completion").alias("rejected"),
        F.col("hi").alias("chosen_score"), F.col("lo").alias("rejected_score"),
    )
