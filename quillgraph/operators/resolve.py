"""Entity resolution: fuzzy alias clusters, majority votes, rewriting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, entity_similarity, strip, token_sort_ratio, word_set
from ..storage import materialize
from .graph import connected_components
from .triples import endpoints


def _rare_words(base: DataFrame) -> DataFrame:
    """(label, low, w, place, n): each label's words, from the rarest on, with their place from 0 and their number."""
    words = base.select("label", "low", F.explode(word_set(F.col("low"))).alias("w"))
    seen = words.groupBy("w").agg(F.count("*").alias("df"))
    ordered = words.join(seen, "w").groupBy("label", "low").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("ws"))
    return ordered.select("label", "low", F.size("ws").alias("n"), F.posexplode("ws.w").alias("place", "w"))


def alias_pairs(labels: DataFrame, threshold: float = 0.82, ratio: float = 70.0, containment: str = "token") -> DataFrame:
    """(a, b, contained, similarity) of label pairs that would merge, the longer label first.

    Labels of a similarity t share at least (t - 0.6) / 0.4 of their words, so one of the
    rarest words of each, of as many as that leaves: only these are joined, and frequent
    words meet nothing unless a label has no other.  (Labels that share no word have a
    similarity of 0.6 at most; a threshold up to that finds them only by containment.)
    containment="token": a label whose words are all in another meets it by its rarest word.
    containment="substring" also finds labels inside others without a common word, by a
    join on the shorter label's rarest character trigram, so no pair is compared that
    shares none; labels of one or two characters use their whole text as the key.
    """
    base = labels.select(strip(F.col("label")).alias("label")).where(F.col("label") != "").distinct()
    base = materialize(base.select("label", F.lower("label").alias("low")), "labels")
    words = materialize(_rare_words(base), "words")
    longer = (F.length("a") > F.length("b")) | ((F.length("a") == F.length("b")) & (F.col("a") < F.col("b")))
    as_a, as_b = (words.select(F.col("label").alias(x), F.col("low").alias(f"low_{x}"), "w", F.col("place").alias(f"p{x}"), F.col("n").alias(f"n{x}")) for x in "ab")
    least = F.lit(min(1.0, max(0.0, (threshold - 0.6) / 0.4) - 1e-9))
    # sets of a share t or more of words have one in common among the first n - ceil(t n) + 1 of both
    first = lambda p, n: F.col(p) < F.col(n) - F.greatest(F.ceil(least * F.col(n)), F.lit(1)) + 1
    cand = as_a.where(first("pa", "na")).join(as_b.where(first("pb", "nb")), "w").where(longer).select("a", "b", "low_a", "low_b")
    if containment == "token":
        held = as_a.join(as_b.where("pb = 0"), "w").where(longer & (F.col("nb") <= F.col("na")))
    else:
        grams = lambda c, n: F.when(F.length(c) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.col(c).substr(i, F.lit(n))))).otherwise(F.array().cast("array<string>"))
        tri = base.select("label", "low", F.explode(F.concat(*[grams("low", n) for n in (1, 2, 3)])).alias("g"))
        df = tri.where(F.length("g") == 3).groupBy("g").agg(F.count("*").alias("df"))
        rare = tri.where(F.length("g") == 3).join(df, "g").groupBy("label", "low").agg(F.min_by("g", F.struct("df", "g")).alias("g"))
        short = base.where(F.length("low") < 3).select("label", "low", F.col("low").alias("g"))
        inner = rare.unionByName(short).select(F.col("label").alias("b"), F.col("low").alias("low_b"), "g")
        held = tri.select(F.col("label").alias("a"), F.col("low").alias("low_a"), "g").join(inner, "g").where(longer & F.col("low_a").contains(F.col("low_b")))
    cand = cand.unionByName(held.select("a", "b", "low_a", "low_b")).distinct()
    contained = F.array_size(F.array_intersect(word_set(F.col("low_a")), word_set(F.col("low_b")))) == F.array_size(word_set(F.col("low_b"))) if containment == "token" else F.col("low_a").contains(F.col("low_b"))
    scored = cand.select("a", "b", contained.alias("contained"), entity_similarity(F.col("a"), F.col("b")).alias("similarity"))
    likely = scored.where(F.col("contained") | (F.col("similarity") >= threshold))
    return likely.withColumn("ratio", token_sort_ratio(F.col("a"), F.col("b"))).where(F.col("contained") | (F.col("ratio") >= ratio)).drop("ratio")


def alias_clusters(labels: DataFrame, threshold: float = 0.82, ratio: float = 70.0, containment: str = "token") -> DataFrame:
    """(label, leader): greedy leader clustering, longest labels first, ties by label.

    A leader absorbs every later label that merges with it and is free.  Pairs are found
    by joins; clusters of pairs do not touch one another, so the greedy order runs
    inside each of them (Arrow groups, bounded by the largest cluster of similar labels).
    """
    pairs = alias_pairs(labels, threshold, ratio, containment)
    ids = pairs.select(entity_id(F.col("a")).alias("u"), entity_id(F.col("b")).alias("v"), "a", "b")
    comps = connected_components(ids.select("u", "v"))
    grouped = ids.join(comps.select(F.col("id").alias("u"), "component"), "u").select("component", "a", "b")

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        absorbs: dict[str, list[str]] = {}
        for a, b in zip(pdf.a, pdf.b, strict=True):
            absorbs.setdefault(a, []).append(b)
        names = sorted({*pdf.a, *pdf.b}, key=lambda s: (-len(s), s))
        leader: dict[str, str] = {}
        for a in names:
            if a not in leader:
                leader[a] = a
                for b in absorbs.get(a, []):
                    leader.setdefault(b, a)
        return pd.DataFrame({"label": list(leader), "leader": list(leader.values())})

    found = grouped.groupBy("component").applyInPandas(greedy, "label string, leader string")
    alone = labels.select(strip(F.col("label")).alias("label")).where(F.col("label") != "").distinct().join(found.select("label"), "label", "left_anti")
    return found.unionByName(alone.select("label", F.col("label").alias("leader")))


def rewrite_aliases(edges: DataFrame, aliases: DataFrame) -> DataFrame:
    """Both ends by their leader (identity where there is none), and their ids anew."""
    a = aliases.where(F.col("label") != F.col("leader"))
    out = edges
    for end in ("subject", "target"):
        out = out.join(a.select(F.col("label").alias(end), F.col("leader").alias(f"{end}_leader")), end, "left")
        out = out.withColumn(end, F.coalesce(f"{end}_leader", end)).drop(f"{end}_leader")
    return out.withColumns({"src_id": entity_id(F.col("subject")), "dst_id": entity_id(F.col("target"))})


def majority(ends: DataFrame, value: str, key: str = "id") -> DataFrame:
    """(key, value): the most frequent value of each key, ties to the smaller one."""
    counted = ends.groupBy(key, value).agg(F.count("*").alias("n"))
    return counted.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))


def resolve_votes(edges: DataFrame) -> DataFrame:
    """Each end's label and type replaced by the majority over all its mentions.

    The edges are read twice, for the votes and to be rewritten; the votes are counted once
    for both questions.
    """
    counted = materialize(endpoints(edges).groupBy("id", "label", "type").agg(F.count("*").alias("n")), "votes")

    def most(value: str) -> DataFrame:
        per = counted.groupBy("id", value).agg(F.sum("n").alias("n"))
        return per.groupBy("id").agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value))

    lut = materialize(most("label").join(most("type"), "id"), "voted")
    out = edges
    for id_col, label, kind in (("src_id", "subject", "subject_type"), ("dst_id", "target", "target_type")):
        l = lut.select(F.col("id").alias(id_col), F.col("label").alias("__l"), F.col("type").alias("__t"))  # noqa: E741
        out = out.join(l, id_col, "left").withColumns({label: F.coalesce("__l", label), kind: F.coalesce("__t", kind)}).drop("__l", "__t")
    return out
