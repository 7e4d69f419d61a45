"""The whole way from texts to a graph, as one composition of operators."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich, graph, knn, resolve, segment, triples, validate
from ..sources import documents
from ..sources.pdf import read_pdfs
from ..storage import materialize


@dataclass(frozen=True)
class Settings:
    """Defaults of the pipeline."""

    max_input_tokens: int = 900
    overlap: float = 0.2
    confidence_filter: float = 0.4
    resolution_threshold: float = 0.82
    leiden_resolution: float = 1.2
    strict: bool = True
    max_entity_chars: int = 80
    max_entity_words: int = 7
    logprob_scale: float = 8.0
    enrichment_cap: int | None = 15
    enrichment_confidence: float = 0.65
    low_yield: int = 3
    reruns: int = 3
    index: str | None = "exact"
    duplicate_threshold: float = 0.9
    missing_threshold: float = 0.78
    most_proposals: int = 5000


def chunk_documents(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chunk_id, doc_id, chunk_no, text, n_tokens)."""
    rows = segment.chunk(docs, s.max_input_tokens, s.overlap)
    return rows.withColumn("chunk_id", F.xxhash64("doc_id", "chunk_no"))


def chunk_sections(sections: DataFrame, s: Settings = Settings()) -> DataFrame:
    """(chunk_id, doc_id, section_no, chunk_no, text, n_tokens): chunks do not cross sections."""
    rows = segment.chunk(sections, s.max_input_tokens, s.overlap, id_cols=("doc_id", "section_no"))
    return rows.withColumn("chunk_id", F.xxhash64("doc_id", "section_no", "chunk_no"))


def pdf_sections(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, section_no, title, text) of PDF files: by their outline, or blocks of pages where it gives none."""
    pages, toc = read_pdfs(spark, path)
    pages = materialize(pages, "pages")
    listed = materialize(documents.sections_from_toc(pages, toc), "sections")
    plain = documents.sections_from_blocks(pages.join(listed.select("doc_id").distinct(), "doc_id", "left_anti"))
    return listed.unionByName(plain)


def extract_two_pass(chunks: DataFrame, ask: Callable[[DataFrame], DataFrame], s: Settings = Settings()) -> DataFrame:
    """(chunk_id, step, five fields, confidence): a local pass, and one that names known entities.

    chunks: (chunk_id, text, known array<string> of entities seen before).  ask: (chunk_id,
    prompt) to (chunk_id, completion), null where it failed.  The first pass's triples get
    co-occurrence edges without a cap; a chunk whose first pass failed has none at all.  The
    second pass is asked where more than five entities are known; what it gives is added
    as it is, and where it failed the first pass stands.
    """
    local = materialize(ask(chunks.select("chunk_id", segment.prompt(F.col("text")).alias("prompt"))).select("chunk_id", "completion"), "local")
    answered = chunks.join(local.where("completion IS NOT NULL").select("chunk_id"), "chunk_id", "left_semi")
    base = validate.parse_toon(local.where("completion IS NOT NULL"), "chunk_id", "completion").withColumn("seq", F.col("pos").cast("long"))
    base = materialize(base, "base")
    near = enrich.cooccurrence(base, answered, None, s.enrichment_confidence)
    asked = answered.where(F.size("known") > 5).select("chunk_id", segment.prompt(F.col("text"), F.col("known")).alias("prompt"))
    second = ask(asked).select("chunk_id", "completion").where("completion IS NOT NULL")
    linked = validate.parse_toon(second, "chunk_id", "completion")
    cols = ["subject", "subject_type", "predicate", "target", "target_type", "confidence"]
    parts = [df.select("chunk_id", F.lit(i).alias("step"), *cols) for df, i in ((base, 1), (near, 1), (linked, 2))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def extract_triples(chunks: DataFrame, extract: Callable[[DataFrame], DataFrame], s: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Accepted triples, enriched, and the counts of drop reasons."""
    raw = extract(chunks).withColumn("confidence", validate.logprob_confidence(F.col("token_logprobs"), s.logprob_scale)).drop("token_logprobs")
    parsed = validate.rule_filter(validate.parse_completions(raw, "completion", s.strict, max_chars=s.max_entity_chars, max_words=s.max_entity_words))
    good = validate.accepted(parsed).withColumn("seq", F.col("pos").cast("long")).drop("pos")
    new = enrich.cooccurrence(good, chunks, s.enrichment_cap, s.enrichment_confidence)
    return good.unionByName(new, allowMissingColumns=True), validate.drop_counts(parsed)


def rescue(chunks: DataFrame, found: DataFrame, extract: Callable[[DataFrame], DataFrame], s: Settings = Settings()) -> DataFrame:
    """Low-yield chunks are asked again a few times; what enough runs agree on replaces them if it is no less."""
    low = chunks.join(enrich.low_yield(chunks, found, s.low_yield).select("chunk_id"), "chunk_id", "left_semi")
    runs = None
    for run in range(s.reruns):
        got, _ = extract_triples(low, extract, s)
        got = got.withColumn("run_id", F.lit(run))
        runs = got if runs is None else runs.unionByName(got)
    agreed = enrich.consensus(runs, s.reruns).drop("votes").withColumn("seq", F.lit(0).cast("long"))
    return enrich.replace_if_as_many(found, agreed)


def build_graph(found: DataFrame, s: Settings = Settings(), vectors: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Edges: aggregated, filtered, aliases merged, votes settled, aggregated again; then semantic
    duplicates merged and proposals appended, if s.index names a backend.

    vectors: nodes (id, label, type) to (id, label, embedding); without it labels' words stand in.
    """
    order = found.withColumn("seq", F.xxhash64("chunk_id", F.coalesce("seq", F.lit(-1).cast("long")), "subject", "target")) if "chunk_id" in found.columns else found
    edges = triples.confident(triples.aggregate(triples.with_ids(order)), s.confidence_filter)
    edges = materialize(edges, "edges")
    labels = triples.endpoints(edges).select("label").distinct()
    merged = materialize(resolve.rewrite_aliases(edges, resolve.alias_clusters(labels, s.resolution_threshold)), "merged")
    edges = materialize(triples.reaggregate(resolve.resolve_votes(merged)), "edges")
    if s.index is None:
        return edges
    embedded = vectors(triples.node_view(edges)) if vectors is not None else None
    return knn.semantic_resolution(edges, embedded, s.duplicate_threshold, s.missing_threshold, s.most_proposals, s.index)


def analyse(edges: DataFrame, s: Settings = Settings()) -> DataFrame:
    """Node table with PageRank, degrees and communities."""
    return graph.export_nodes(edges, graph.pagerank(edges), graph.communities(edges, s.leiden_resolution))
