"""Sentence co-occurrence graph over mentions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mention_nodes(mentions: DataFrame) -> DataFrame:
    """(label, type): labels longer than one character, the type of the first mention, UNK where none."""
    return mentions.where(F.length("label") > 1).groupBy("label").agg(F.coalesce(F.min_by("type", F.struct("doc_id", "sent", "pos")), F.lit("UNK")).alias("type"))


def sentence_edges(mentions: DataFrame) -> DataFrame:
    """(source, target, relationship, weight): pairs in text order within a sentence, counted.

    The self-join is an equi-join on the sentence; its rows are bounded by sentence length.
    """
    a = mentions.select("doc_id", "sent", F.col("pos").alias("pa"), F.col("label").alias("source"))
    b = mentions.select("doc_id", "sent", F.col("pos").alias("pb"), F.col("label").alias("target"))
    return a.join(b, ["doc_id", "sent"]).where("pa < pb AND source <> target").groupBy("source", "target").agg(F.lit("co_occurs").alias("relationship"), F.count("*").alias("weight"))


def svo_edges(tokens: DataFrame, mentions: DataFrame) -> DataFrame:
    """(doc_id, source, target, relationship, weight) from dependency arcs.

    tokens: (doc_id, sent, idx, text, lemma, dep, head), head being the idx of the word that a
    word depends on; mentions: (doc_id, sent, pos, label).  A subject's verb and the verb's
    first object give an edge named by the verb's lemma; either end grows to the first
    mention of the sentence that holds its text.  Of edges between two ends the last counts.

    Arcs meet in equi-joins on the sentence and a word of it; a sentence's mentions travel
    as one array, which is no longer than the sentence.
    """
    at = ["doc_id", "sent"]
    subject = tokens.where(F.col("dep").isin("nsubj", "nsubjpass")).select(*at, F.col("head").alias("verb"), F.col("idx").alias("si"), F.col("text").alias("s"))
    verb = tokens.select(*at, F.col("idx").alias("verb"), F.lower("lemma").alias("relationship"))
    child = tokens.where(F.col("dep").isin("dobj", "obj", "pobj", "attr")).groupBy(*at, F.col("head").alias("verb")).agg(F.min_by("text", "idx").alias("o"))
    names = mentions.where(F.length("label") > 1).groupBy(*at).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda m: m["label"]).alias("names"))
    arcs = subject.join(verb, [*at, "verb"]).join(child, [*at, "verb"]).join(names, at, "left")
    grown = lambda word: F.coalesce(F.get(F.filter("names", lambda m: F.contains(m, F.col(word))), F.lit(0)), F.col(word))
    found = arcs.select("doc_id", grown("s").alias("source"), grown("o").alias("target"), "relationship", F.struct("sent", "si").alias("order"))
    return found.groupBy("doc_id", "source", "target").agg(F.max_by("relationship", "order").alias("relationship"), F.lit(1).alias("weight"))


def node_size(size, degree):
    return F.greatest(F.lit(10), size + 3 * degree)


def edge_width(weight):
    return F.least(F.lit(6), 1 + weight)
