"""Triple table and edges: ids, aggregation, node view, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_id, type_aware_id

NAMES = ["subject", "subject_type", "predicate", "target", "target_type"]


def with_ids(triples: DataFrame, type_aware: bool = False) -> DataFrame:
    """Adds src_id, rel_id, dst_id."""
    src, dst = (type_aware_id(F.col("subject"), F.col("subject_type")), type_aware_id(F.col("target"), F.col("target_type"))) if type_aware else (entity_id(F.col("subject")), entity_id(F.col("target")))
    return triples.withColumns({"src_id": src, "rel_id": entity_id(F.col("predicate")), "dst_id": dst})


def aggregate(triples: DataFrame) -> DataFrame:
    """Edges: mean confidence and count by (src_id, rel_id, dst_id), names of the first triple by seq.

    One grouped pass with map-side partial aggregation; the count needs no join.
    """
    first = F.min_by(F.struct(*NAMES), "seq")
    return triples.groupBy("src_id", "rel_id", "dst_id").agg(
        F.avg("confidence").alias("confidence"), F.count("*").alias("count"), F.min("seq").alias("seq"), first.alias("f"),
    ).select("src_id", "rel_id", "dst_id", "confidence", "count", "seq", "f.*")


def confident(edges: DataFrame, least: float = 0.4) -> DataFrame:
    return edges.where(F.col("confidence") >= least)


def reaggregate(edges: DataFrame, weighted: bool = False) -> DataFrame:
    """Edges again by (src_id, dst_id, predicate) after a merge: mean of means, or weighted by count; counts add up."""
    mean = F.sum(F.col("confidence") * F.col("count")) / F.sum("count") if weighted else F.avg("confidence")
    keep = [c for c in ("edge_source",) if c in edges.columns]
    first = F.min_by(F.struct("subject", "subject_type", "target", "target_type", *keep), "seq")
    return edges.groupBy("src_id", "dst_id", "predicate").agg(
        mean.alias("confidence"), F.sum("count").alias("count"), F.min("seq").alias("seq"), first.alias("f"),
    ).select("src_id", "dst_id", "predicate", "confidence", "count", "seq", "f.*")


def endpoints(edges: DataFrame) -> DataFrame:
    """(id, label, type, seq, side) of both ends, in one scan."""
    ends = F.array(
        F.struct(F.col("src_id").alias("id"), F.col("subject").alias("label"), F.col("subject_type").alias("type"), "seq", F.lit(0).alias("side")),
        F.struct(F.col("dst_id").alias("id"), F.col("target").alias("label"), F.col("target_type").alias("type"), "seq", F.lit(1).alias("side")),
    )
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def node_view(edges: DataFrame) -> DataFrame:
    """One row per id: smallest label and type."""
    return endpoints(edges).groupBy("id").agg(F.min("label").alias("label"), F.min("type").alias("type"))


def first_mention(edges: DataFrame) -> DataFrame:
    """One row per id: label and type of the first edge that names it, source before target."""
    return endpoints(edges).groupBy("id").agg(F.min_by(F.struct("label", "type"), F.struct("seq", "side")).alias("f")).select("id", "f.*")


def summary(edges: DataFrame) -> DataFrame:
    """One row: edges, distinct predicates, distinct labels, mean confidence (0 when empty)."""
    nodes = endpoints(edges).agg(F.countDistinct("label").alias("n_nodes"))
    return edges.agg(
        F.count("*").alias("n_edges"), F.countDistinct("predicate").alias("n_predicates"),
        F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"),
    ).crossJoin(F.broadcast(nodes))  # one row each


def batch_summary(triples: DataFrame, batch_col: str = "batch") -> DataFrame:
    """(batch, n_triples, mean_confidence); the mean is 0 where no triple has a confidence."""
    mean = F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence")
    return triples.groupBy(batch_col).agg(F.count("*").alias("n_triples"), mean)


def type_counts(edges: DataFrame) -> DataFrame:
    return endpoints(edges).groupBy("type").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type")


def degree_summary(degrees: DataFrame) -> DataFrame:
    return degrees.agg(F.avg("degree").alias("avg_degree"), F.max("degree").alias("max_degree"))


def community_count(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.countDistinct(F.when(F.col("community_id") != -1, F.col("community_id"))).alias("n_communities"))
