"""Nearest-label classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..ontology import DOMAIN_LABELS

#: The tag of what has none, and the most labels of a broadcast.
UNCLASSIFIED, LABELS = "unclassified", 1024


def hashed_counts(df: DataFrame, id_col: str, text_col: str, size: int = 256) -> DataFrame:
    """(id, slot, x): unit bag-of-words vectors by hashing, sparse; stands in where no
    embedding model exists.  One row per text and slot, counted map-side first."""
    words = F.filter(F.split(F.lower(text_col), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    slots = df.select(id_col, F.explode(F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(size)))).alias("slot"))
    counts = slots.groupBy(id_col, "slot").agg(F.count("*").cast("double").alias("n"))
    norm = counts.groupBy(id_col).agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("norm"))
    return counts.join(norm, id_col).select(id_col, "slot", (F.col("n") / F.col("norm")).alias("x"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def nearest_label(rows: DataFrame, labels: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, label, score): the label of the highest inner product, ties to the first.

    labels (ord, label, vector) are counted and broadcast in blocks of LABELS at most, each
    of which the rows meet in a narrow pass; the best of a row's blocks wins.
    """
    named = labels.select("ord", "label", F.col("vector").alias("y"))
    blocks = max(1, -(-named.count() // LABELS))
    best = F.min(F.struct((-dot(F.col("x"), F.col("y"))).alias("neg"), "ord", "label")).alias("b")
    parts = []
    for i in range(blocks):
        block = named.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == i)
        parts.append(rows.select(id_col, F.col("vector").alias("x")).crossJoin(F.broadcast(block)).groupBy(id_col).agg(best))
    met = parts[0] if blocks == 1 else reduce(DataFrame.unionByName, parts).groupBy(id_col).agg(F.min("b").alias("b"))
    return met.select(id_col, F.col("b.label").alias("label"), (-F.col("b.neg")).alias("score"))


def classify_domains(texts: DataFrame, id_col: str = "id", text_col: str = "text", max_chars: int | None = 2000) -> DataFrame:
    """(id, label, score): the domain of each text's first ``max_chars`` characters, or of all of it if None."""
    spark = texts.sparkSession
    named = spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(DOMAIN_LABELS.items())], "ord int, label string, words string")
    labels = F.broadcast(hashed_counts(named, "ord", "words").select("ord", "slot", F.col("x").alias("y")))  # labels x slots at most
    judged = F.col(text_col) if max_chars is None else F.substring(text_col, 1, max_chars)
    vectors = hashed_counts(texts.select(id_col, judged.alias("t")), id_col, "t")
    dots = vectors.join(labels, "slot").groupBy(id_col, "ord").agg(F.sum(F.col("x") * F.col("y")).alias("score"))
    best = dots.groupBy(id_col).agg(F.min(F.struct((-F.col("score")).alias("neg"), "ord")).alias("b")).select(F.col(id_col).alias("__id"), "b")
    # a text that shares no slot with any label is as near to all: the first label
    out = texts.select(id_col).join(best, F.col(id_col) == F.col("__id"), "left").select(
        id_col, F.coalesce("b.ord", F.lit(0)).alias("ord"), F.coalesce(-F.col("b.neg"), F.lit(0.0)).alias("score"),
    )
    return out.join(F.broadcast(named.select("ord", "label")), "ord").select(id_col, "label", "score")


def histogram(tags: DataFrame, group: str | None = None, tag: str = "label") -> DataFrame:
    named = tags.withColumn(tag, F.coalesce(tag, F.lit(UNCLASSIFIED)))
    return named.groupBy(*([group] if group else []), tag).agg(F.count("*").alias("n"))
