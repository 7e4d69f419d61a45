"""Enrichment and consensus: co-occurrence edges, low-yield chunks, votes over repeated runs."""

from __future__ import annotations

from math import comb

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def cooccurrence(triples: DataFrame, chunks: DataFrame | None = None, cap: int | None = 15, confidence: float = 0.65, chunk_col: str = "chunk_id") -> DataFrame:
    """New edges (chunk, subject, subject_type, related_to, target, target_type, confidence).

    For chunks with two triples or more: every pair of entities that no triple joins in
    either direction.  Entities are ordered by first appearance (seq, subject before
    target), the type seen last counts, and ``cap`` keeps the first ones.  With chunks
    (chunk_col, text), only entities whose lower-cased name stands in the lower-cased text.
    The cap bounds a chunk's pairs; without it they grow with the square of its entities.
    """
    c = F.col(chunk_col)
    busy = triples.groupBy(c).agg(F.count("*").alias("n")).where("n >= 2").select(chunk_col)
    ends = triples.select(c, F.explode(F.array(
        F.struct(F.col("subject").alias("e"), F.col("subject_type").alias("t"), (F.col("seq") * 2).alias("o")),
        F.struct(F.col("target").alias("e"), F.col("target_type").alias("t"), (F.col("seq") * 2 + 1).alias("o")),
    )).alias("x")).select(chunk_col, "x.*")
    ents = ends.groupBy(chunk_col, "e").agg(F.min("o").alias("o"), F.max_by("t", "o").alias("t")).join(busy, chunk_col, "left_semi")
    if chunks is not None:
        ents = ents.join(chunks.select(chunk_col, F.lower("text").alias("low")), chunk_col).where(F.col("low").contains(F.lower("e"))).drop("low")
    rank = F.row_number().over(Window.partitionBy(chunk_col).orderBy("o", "e"))
    ents = ents.select(chunk_col, "e", "t", rank.alias("r"))
    if cap is not None:
        ents = ents.where(F.col("r") <= cap)
    a, b = ents.select(
        c, F.col("e").alias("subject"), F.col("t").alias("subject_type"), F.col("r").alias("ra"),
    ), ents.select(c, F.col("e").alias("target"), F.col("t").alias("target_type"), F.col("r").alias("rb"))
    pairs = a.join(b, chunk_col).where("ra < rb").withColumns({"lo": F.least("subject", "target"), "hi": F.greatest("subject", "target")})
    joined = triples.select(c, F.least("subject", "target").alias("lo"), F.greatest("subject", "target").alias("hi")).distinct()
    new = pairs.join(joined, [chunk_col, "lo", "hi"], "left_anti")
    return new.select(chunk_col, "subject", "subject_type", F.lit("related_to").alias("predicate"), "target", "target_type", F.lit(confidence).alias("confidence"))


def low_yield(chunks: DataFrame, triples: DataFrame, bound: int = 3, chunk_col: str = "chunk_id") -> DataFrame:
    """(chunk, n_triples) of chunks with fewer than ``bound`` triples, none included."""
    n = triples.groupBy(chunk_col).agg(F.count("*").alias("n"))
    return chunks.select(chunk_col).join(n, chunk_col, "left").select(chunk_col, F.coalesce("n", F.lit(0)).cast("long").alias("n_triples")).where(F.col("n_triples") < bound)


def resample(chunks: DataFrame, n: int = 3) -> DataFrame:
    """Each chunk once per run; n is a small constant."""
    return chunks.withColumn("run_id", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def least_votes(n: int, level: float = 0.05) -> int | None:
    """Fewest votes of n runs whose Beta posterior (prior 2, 1) has its 5% quantile at one half or above."""
    for k in range(n + 1):
        if sum(comb(n + 2, j) for j in range(k + 2, n + 3)) <= level * 2 ** (n + 2):
            return k
    return None


def consensus(triples: DataFrame, n_runs: int, chunk_col: str = "chunk_id") -> DataFrame:
    """Triples that enough runs agree on, case aside: (chunk, five fields, votes, confidence).

    Votes count runs, so a triple repeated in a run votes once.  The first seen spelling
    (by run, then seq) stands for the triple; confidence is the posterior mean.
    """
    need = least_votes(n_runs)
    key = [F.lower(c).alias(f"k{i}") for i, c in enumerate(("subject", "predicate", "target"))]
    first = F.min_by(F.struct("subject", "subject_type", "predicate", "target", "target_type"), F.struct("run_id", "seq"))
    voted = triples.groupBy(chunk_col, *key).agg(F.countDistinct("run_id").alias("votes"), first.alias("t"))
    if need is None:
        voted = voted.where(F.lit(False))
    else:
        voted = voted.where(F.col("votes") >= need)
    return voted.select(chunk_col, "t.*", "votes", ((F.col("votes") + 2) / F.lit(float(n_runs + 3))).alias("confidence"))


def replace_if_as_many(old: DataFrame, new: DataFrame, chunk_col: str = "chunk_id") -> DataFrame:
    """Each chunk's triples from ``new`` where it has at least as many as ``old``, else from ``old``."""
    n_old, n_new = old.groupBy(chunk_col).agg(F.count("*").alias("n_old")), new.groupBy(chunk_col).agg(F.count("*").alias("n_new"))
    better = n_new.join(n_old, chunk_col, "left").where(F.col("n_new") >= F.coalesce("n_old", F.lit(0))).select(chunk_col)
    return old.join(better, chunk_col, "left_anti").unionByName(new.join(better, chunk_col, "left_semi"), allowMissingColumns=True)


def running_entities(mentions: DataFrame, batch_col: str = "batch", entity_col: str = "entity") -> DataFrame:
    """(batch, new, seen): entities first seen in a batch and distinct entities so far.

    The window runs over one row per batch that brings something new.
    """
    first = mentions.groupBy(entity_col).agg(F.min(batch_col).alias(batch_col)).groupBy(batch_col).agg(F.count("*").alias("new"))
    every = mentions.select(batch_col).distinct().join(first, batch_col, "left").select(batch_col, F.coalesce("new", F.lit(0)).cast("long").alias("new"))
    return every.withColumn("seen", F.sum("new").over(Window.orderBy(batch_col).rowsBetween(Window.unboundedPreceding, 0)))


