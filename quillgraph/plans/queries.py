"""Registered queries over the driver's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import canonical_label, entity_similarity, good_shape, type_aware_id
from ..operators import classify, cooccur, enrich, graph, knn, quality, resolve, segment, triples, validate
from ..ontology import PREDICATE_ALIASES
from ..sources import documents as src
from ..sources import extractors, sinks
from ..storage import materialize, scratch
from ..streaming import micro
from . import pipeline
from .star import COMPLETIONS, completion_of, completions, star_edges, star_triples, table

QUERIES = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def r8(c):
    return F.round(c, 8)


def _edges(s: SparkSession, d: str) -> DataFrame:
    """The star schema's edges, written once, for queries that read them more than once."""
    return materialize(star_edges(s, d), "edges")


def _pages(s, d):
    return table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")


def _vectors(s, d):
    return table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.concat(F.lit("v"), F.col("vec_id")).alias("label"), "embedding")


def _sections(s, d):
    pages = _pages(s, d)
    entry, title = (F.col("page_no") / 3).cast("int").alias("entry_no"), F.concat(F.lit("T"), "page_no").alias("title")
    toc = pages.where("page_no % 3 = 0").select("doc_id", entry, F.lit(1).alias("level"), title, (F.col("page_no") + 1).alias("page_no"))
    return src.sections_from_toc(pages, toc)


@query
def sections_from_toc(s, d):
    return _sections(s, d)


@query
def section_chunks(s, d):
    return pipeline.chunk_sections(_sections(s, d), pipeline.Settings(max_input_tokens=60)).drop("chunk_id")


@query
def sections_fixed_blocks(s, d):
    return src.sections_from_blocks(_pages(s, d), 3)


@query
def sparse_document_flag(s, d):
    return src.sparse_flag(table(s, d, "documents").select("doc_id", "text"))


@query
def metrics_text_parse(s, d):
    line = F.concat(F.lit('# HELP x\nevents_total{type="'), "event_type", F.lit('",user="'), "user_id", F.lit('"} '), "event_id", F.lit("\nother_total 1"))
    got = src.parse_metrics(table(s, d, "events").select("event_id", line.alias("text")), prefixes=["events"])
    return got.select("event_id", "name", F.col("labels")["type"].alias("type"), F.col("labels")["user"].alias("user"), "value")


@query
def sentence_split(s, d):
    return segment.split_sentences(table(s, d, "documents"))


@query
def sentence_token_counts(s, d):
    return segment.sentence_tokens(table(s, d, "documents")).select("doc_id", "pos", "n_tokens")


@query
def chunk_overlap(s, d):
    return segment.chunk(table(s, d, "documents"), 90, 0.2)


@query
def chunk_plain(s, d):
    return segment.chunk(table(s, d, "documents"), 90, 0.0, whole=False).withColumn("n_tokens", F.round("n_tokens", 6))


@query
def chunk_batches(s, d):
    rows = segment.sentence_tokens(table(s, d, "documents")).withColumnRenamed("sentence", "text")
    return segment.batches(rows, 8, "doc_id").select("doc_id", "n_tokens", "text", "batch")


@query
def prompt_build(s, d):
    known = F.transform(F.sequence(F.lit(1), (F.col("doc_id") % 15).cast("int") + 1), lambda i: F.concat(F.lit("entity "), i))
    return table(s, d, "documents").select("doc_id", F.md5(segment.prompt(F.col("text"), known)).alias("prompt_md5"))


@query
def domain_classify(s, d):
    e = table(s, d, "embeddings")
    mean = e.select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    cents = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("vector")).select(F.col("label").alias("ord"), F.col("label").cast("string").alias("label"), "vector")
    got = classify.nearest_label(e.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector")), cents)
    return got.select("id", "label", F.round("score", 6).alias("score"))


@query
def domain_tags(s, d):
    return classify.classify_domains(table(s, d, "documents").select(F.col("doc_id").alias("id"), "text"), max_chars=None).select(
        "id", "label", F.round("score", 6).alias("score"),
    )


@query
def domain_histogram(s, d):
    docs = table(s, d, "documents").select((F.col("doc_id") % 8).alias("batch"), F.when(F.col("lang") != "es", F.col("lang")).alias("label"))
    return classify.histogram(docs, "batch")


@query
def json_triples_parse(s, d):
    got = validate.parse_completions(completions(s, d), strict=False)
    return got.select("chunk_id", F.col("pos").cast("long").alias("pos"), "subject", "predicate", "target", "drop_reason")


@query
def entity_shape_filter(s, d):
    docs = table(s, d, "documents").select(F.concat(F.lit("d"), "doc_id").alias("key"), F.col("text").alias("name"))
    parts = table(s, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("key"), F.col("p_name").alias("name"))
    return docs.unionByName(parts).select("key", good_shape(F.col("name")).alias("ok"))


@query
def schema_conformance(s, d):
    return completions(s, d).select("chunk_id", validate.conforms(F.col("completion")).alias("ok"))


def _toon(s, d, typed):
    part, supp = table(s, d, "part"), table(s, d, "supplier")
    met = part.join(supp, F.col("p_partkey") % 50 + 1 == F.col("s_suppkey"))
    kinds = (' type:"ORGANIZATION"', ' type:"PRODUCT" confidence:0.95') if typed else ("", "")
    line = F.concat(F.lit('x TRIPLE source:"'), "s_name", F.lit(f'"{kinds[0]} predicate:"supplies" target:"'), "p_name", F.lit(f'\'s kind"{kinds[1]}\n'))
    return validate.parse_toon(met.select("p_partkey", F.concat(line, line).alias("text")), "p_partkey", "text")


@query
def toon_parse(s, d):
    return _toon(s, d, True).withColumn("pos", F.col("pos").cast("long"))


@query
def toon_fallback(s, d):
    return _toon(s, d, False).withColumn("pos", F.col("pos").cast("long"))


@query
def predicate_normalize(s, d):
    names = [*PREDICATE_ALIASES, "related_to", "Works At ", " CREATED BY"]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("event_id") % len(names) + 1).cast("int"))
    return table(s, d, "events").select("event_id", validate.normalize_predicate(raw).alias("predicate"))


@query
def sitl_filter(s, d):
    return validate.rule_filter(star_triples(s, d)).select("seq", "subject", "predicate", "target", "drop_reason")


@query
def drop_reason_counts(s, d):
    return validate.drop_counts(validate.rule_filter(star_triples(s, d)))


@query
def logprob_confidence(s, d):
    lp = F.when(F.col("event_id") % 7 != 0, -F.col("value") / 1000.0)
    g = table(s, d, "events").groupBy("user_id").agg(F.collect_list(F.struct(lp.alias("x"))).alias("l"))
    return g.select("user_id", r8(validate.logprob_confidence(F.col("l.x"))).alias("confidence"))


def _order_triples(s, d):
    li = table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return li.select(
        F.col("l_orderkey").alias("chunk_id"), F.concat(F.lit("Order "), "l_orderkey").alias("subject"),
        F.lit("DOCUMENT").alias("subject_type"), F.lit("contains").alias("predicate"), F.col("p_name").alias("target"),
        F.lit("PRODUCT").alias("target_type"), F.col("l_linenumber").cast("long").alias("seq"),
    )


@query
def cooccurrence_enrich(s, d):
    # a fixed order inside a line number, which the tables do not promise to be unique
    t = _order_triples(s, d).groupBy("chunk_id", "subject", "subject_type", "predicate", "target", "target_type").agg(F.min("seq").alias("seq"))
    return enrich.cooccurrence(t, cap=5).select("chunk_id", "subject", "predicate", "target", "confidence")


@query
def cooccurrence_uncapped(s, d):
    t = _order_triples(s, d).groupBy("chunk_id", "subject", "subject_type", "predicate", "target", "target_type").agg(F.min("seq").alias("seq"))
    named = t.groupBy("chunk_id", "subject").agg(F.array_sort(F.collect_set(F.when(F.col("seq") % 2 == 1, F.col("target")))).alias("l"))
    chunks = named.select("chunk_id", F.concat("subject", F.lit(": "), F.upper(F.array_join("l", "; "))).alias("text"))
    return enrich.cooccurrence(t, chunks, cap=None).select("chunk_id", "subject", "predicate", "target", "confidence")


@query
def resample_chunks(s, d):
    return enrich.resample(table(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id")), 3)


@query
def two_pass_extraction(s, d):
    """Nations tell their region, and from the seventh on, by what is known, regions their nations."""
    nation, region = table(s, d, "nation"), table(s, d, "region")
    named = nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey"))  # fixed 25 and 5 rows
    before = nation.select(F.col("n_nationkey").alias("bk"), F.col("n_name").alias("bn"))
    known = nation.join(before, F.col("bk") < F.col("n_nationkey"), "left").groupBy("n_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("bk", "bn"))), lambda x: x["bn"]).alias("known"))
    text = F.concat("n_name", F.lit(" is part of "), "r_name", F.lit(" where Trade follows Law."))
    chunks = named.join(known, "n_nationkey").select(F.col("n_nationkey").cast("long").alias("chunk_id"), text.alias("text"), "known", "n_name", "r_name")

    def ask(asked: DataFrame) -> DataFrame:
        names = chunks.select("chunk_id", "n_name", "r_name")
        line = lambda a, p, b: F.concat(F.lit('TRIPLE source:"'), a, F.lit(f'" type:"LOCATION" predicate:"{p}" target:"'), b, F.lit('" type:"LOCATION" confidence:0.9\n'))
        local = F.concat(line(F.col("n_name"), "part_of", F.col("r_name")), line(F.lit("Trade"), "depends_on", F.lit("Law")))
        # one in seven first answers and one in five second ones fail
        said = F.when(F.col("prompt").contains("Known entities: "), F.when(F.col("chunk_id") % 5 != 2, line(F.col("r_name"), "contains", F.col("n_name")))).otherwise(F.when(F.col("chunk_id") % 7 != 3, local))
        return asked.join(names, "chunk_id").select("chunk_id", said.alias("completion"))

    return pipeline.extract_two_pass(chunks.select("chunk_id", "text", "known"), ask).select("chunk_id", "step", "subject", "predicate", "target", "confidence")


@query
def low_yield_chunks(s, d):
    return enrich.low_yield(table(s, d, "orders").select(F.col("o_orderkey").alias("chunk_id")), _order_triples(s, d))


def _runs(s, d):
    e = table(s, d, "events")
    return e.select(
        F.col("user_id").alias("chunk_id"), (F.col("event_id") % 5).alias("run_id"),
        F.when(F.col("event_id") % 2 == 0, F.upper("event_type")).otherwise(F.col("event_type")).alias("subject"),
        F.lit("CONCEPT").alias("subject_type"), F.lit("related_to").alias("predicate"), F.lit("Site").alias("target"),
        F.lit("PRODUCT").alias("target_type"), F.col("event_id").alias("seq"),
    )


@query
def consensus_vote(s, d):
    got = enrich.consensus(_runs(s, d), 5)
    return got.select("chunk_id", "subject", "predicate", "target", "votes", r8(F.col("confidence")).alias("confidence"))


@query
def rerun_replace(s, d):
    runs = _runs(s, d)
    old, new = runs.where("run_id < 2").withColumn("run", F.lit("old")), runs.where("run_id >= 2 AND seq % 3 <> 0").withColumn("run", F.lit("new"))
    return enrich.replace_if_as_many(old, new).groupBy("chunk_id").agg(F.max("run").alias("run"), F.count("*").alias("n"))


@query
def running_entities(s, d):
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("batch"), F.concat_ws(":", "user_id", "event_type").alias("entity"))
    return enrich.running_entities(e)


@query
def canonical_labels(s, d):
    name = F.concat(F.lit("  The  "), "text", F.lit(" . "))
    return table(s, d, "documents").select("doc_id", canonical_label(name).alias("label"))


@query
def triple_aggregate(s, d):
    e = triples.aggregate(triples.with_ids(validate.accepted(validate.rule_filter(star_triples(s, d)))))
    return e.select("subject", "predicate", "target", r8(F.col("confidence")).alias("confidence"), "count")


def _aliases(s):
    return s.createDataFrame([("FRANCE", "GERMANY"), ("RUSSIA", "GERMANY"), ("CHINA", "INDIA"), ("NATION_1", "NATION_0"), ("NATION_3", "NATION_2")], "label string, leader string")


def _aliased(s, d):
    return resolve.rewrite_aliases(star_edges(s, d), _aliases(s))


@query
def alias_rewrite(s, d):
    return _aliased(s, d).groupBy("subject", "predicate", "target").agg(F.count("*").alias("n"))


@query
def edge_reaggregate(s, d):
    got = triples.reaggregate(_aliased(s, d))
    return got.select(
        canonical_label(F.col("subject")).alias("subject"), "predicate", canonical_label(F.col("target")).alias("target"),
        r8(F.col("confidence")).alias("confidence"), "count",
    )


@query
def reaggregate_sources(s, d):
    origin = F.when(F.col("seq") % 3 == 0, "extracted").otherwise("co_occurrence")
    got = triples.reaggregate(_aliased(s, d).withColumn("edge_source", origin), weighted=True)
    return got.select(
        canonical_label(F.col("subject")).alias("subject"), "predicate", canonical_label(F.col("target")).alias("target"),
        r8(F.col("confidence")).alias("confidence"), "count", "edge_source",
    )


@query
def batch_confidence(s, d):
    t = validate.accepted(validate.rule_filter(star_triples(s, d))).withColumn("batch", F.floor(F.col("seq") / 10**12).cast("long"))
    return triples.batch_summary(t, "batch").select("batch", "n_triples", r8(F.col("mean_confidence")).alias("mean_confidence"))


@query
def node_view(s, d):
    return triples.node_view(star_edges(s, d)).select("label", "type")


@query
def first_mentions(s, d):
    return triples.first_mention(star_edges(s, d)).select("label", "type")


@query
def graph_summary(s, d):
    got = triples.summary(star_edges(s, d))
    return got.select("n_edges", "n_predicates", "n_nodes", r8(F.col("mean_confidence")).alias("mean_confidence"))


@query
def entity_type_counts(s, d):
    return triples.type_counts(star_edges(s, d))


@query
def degree_summary(s, d):
    got = triples.degree_summary(graph.degrees(star_edges(s, d)))
    return got.select(r8(F.col("avg_degree")).alias("avg_degree"), "max_degree")


@query
def community_counts(s, d):
    kinds = {"PRODUCT": 1, "DOCUMENT": 2, "LOCATION": 3}
    group = F.lit(-1)
    for kind, i in kinds.items():
        group = F.when(F.col("type") == kind, i).otherwise(group)
    return triples.community_count(triples.node_view(star_edges(s, d)).select("id", group.alias("community_id")))


@query
def entity_similarities(s, d):
    names = table(s, d, "part").select("p_name").distinct()
    a, b = names.select(F.col("p_name").alias("a")), names.select(F.col("p_name").alias("b"))
    word = lambda df, c: df.select(c, F.explode(F.split(c, " ")).alias("w"))
    pairs = word(a, "a").join(word(b, "b"), "w").where("a < b").select("a", "b").distinct()
    return pairs.select("a", "b", r8(entity_similarity(F.col("a"), F.col("b"))).alias("similarity")).where("similarity >= 0.55")


@query
def fuzzy_alias_pairs(s, d):
    return resolve.alias_pairs(table(s, d, "part").select(F.col("p_name").alias("label")), 0.6, 70.0, "substring").select(
        "a", "b", "contained", r8(F.col("similarity")).alias("similarity"),
    )


@query
def alias_clusters(s, d):
    return resolve.alias_clusters(table(s, d, "part").select(F.col("p_name").alias("label")), 0.6, 70.0, "substring")


@query
def majority_type(s, d):
    return resolve.majority(table(s, d, "events"), "event_type", "user_id")


@query
def majority_label(s, d):
    return resolve.majority(table(s, d, "lineitem"), "l_returnflag", "l_partkey")


@query
def vote_join_back(s, d):
    got = resolve.resolve_votes(_edges(s, d))
    return got.groupBy("subject", "subject_type", "predicate", "target", "target_type").agg(F.count("*").alias("n"))


@query
def knn_search(s, d):
    return knn.knn(_vectors(s, d), 5).select("id", "rank", "nbr_id", F.round("sim", 6).alias("sim"))


@query
def knn_approximate(s, d):
    return knn.knn_lsh(_vectors(s, d), 5, 0.35).select("id", "rank", "nbr_id", F.round("sim", 6).alias("sim"))


@query
def index_search(s, d):
    v = _vectors(s, d)
    asked = v.where("id % 50 = 0").select("id", "embedding")
    return knn.build_index(v).search(5, 0.2, asked).select("id", "rank", "nbr_id", F.round("sim", 6).alias("sim"))


@query
def nearest_to_query(s, d):
    q = [float(x) for x in table(s, d, "embeddings").where("vec_id = 0").first()["embedding"]]
    return knn.neighbours(_vectors(s, d), q, 10).select("id", F.round("sim", 6).alias("sim"))


@query
def semantic_duplicates(s, d):
    return knn.duplicates(_vectors(s, d), 0.4)


def _vector_edges(s, d):
    """Every vector's node points to another by a rule; those of one remainder are PRODUCTs."""
    v = _vectors(s, d)
    kind = lambda c: F.when(c % 4 == 0, "PRODUCT").otherwise("CONCEPT")
    to = (F.col("id") * 7 + 3) % 100
    return v.select(
        F.col("id").alias("src_id"), to.alias("dst_id"), F.lit("related_to").alias("predicate"), F.lit(0.5).alias("confidence"),
        F.lit(1).cast("long").alias("count"), F.col("id").alias("seq"), "label", kind(F.col("id")).alias("subject_type"),
        F.concat(F.lit("v"), to).alias("target"), kind(to).alias("target_type"),
    ).withColumnRenamed("label", "subject")


@query
def edge_proposals(s, d):
    e = _vector_edges(s, d)
    got = knn.with_proposals(e, knn.missing_edges(_vectors(s, d), e, 0.35, 8), triples.node_view(e))
    return got.select(
        "src_id", "dst_id", "predicate", F.round("confidence", 6).alias("confidence"), "count", "subject", "subject_type",
        "target", "target_type", "edge_source",
    )


@query
def semantic_resolution(s, d):
    got = knn.semantic_resolution(_vector_edges(s, d), _vectors(s, d), 0.4, 0.35)
    return got.select("src_id", "dst_id", "predicate", F.round("confidence", 6).alias("confidence"), "count", "subject", "target", "edge_source")


@query
def missing_edges(s, d):
    v = _vectors(s, d)
    known = v.select(F.col("id").alias("src_id"), ((F.col("id") * 7 + 3) % 100).alias("dst_id"))
    return knn.missing_edges(v, known, 0.35, 8).select("src_id", "dst_id", F.round("sim", 6).alias("sim"))


@query
def type_aware_ids(s, d):
    e = star_triples(s, d)
    return e.groupBy(type_aware_id(F.col("subject"), F.col("subject_type")).alias("id")).agg(
        F.min("subject").alias("label"), F.min("subject_type").alias("type"), F.count("*").alias("n"),
    ).drop("id")


@query
def in_out_degree(s, d):
    return graph.node_degrees(star_edges(s, d)).select("label", "in_degree", "out_degree", "degree")


def _ranks(edges):
    """Ten steps, which SQL can follow."""
    return graph.pagerank(edges, 10, tolerance=None)


@query
def pagerank(s, d):
    e = _edges(s, d)
    return triples.node_view(e).join(_ranks(e), "id").select("label", F.round("pagerank", 10).alias("pagerank"))


@query
def pagerank_converged(s, d):
    e = _edges(s, d)
    return triples.node_view(e).join(graph.pagerank(e), "id").select("label", F.round("pagerank", 4).alias("pagerank"))


@query
def communities(s, d):
    e = _edges(s, d)
    names = triples.node_view(e)
    got = graph.communities(e)
    low = names.select(F.col("id").alias("community_id"), F.col("label").alias("community"))
    return got.join(names, "id").join(low, "community_id").select("label", "community")


@query
def label_propagation(s, d):
    e = _edges(s, d)
    return graph.label_propagation(e).join(triples.node_view(e), "id").select("label", "community_id")


@query
def modularity(s, d):
    e = _edges(s, d)
    groups = triples.node_view(e).select("id", F.when(F.col("type") == "PRODUCT", 1).when(F.col("type") == "DOCUMENT", 1).otherwise(2).alias("community_id"))
    return graph.modularity(e, groups).select(r8(F.col("modularity")).alias("modularity"))


@query
def node_export(s, d):
    """Node table with ranks, and no communities, which then are -1."""
    e = _edges(s, d)
    got = graph.export_nodes(e, _ranks(e))
    return got.select("label", "type", F.round("pagerank", 10).alias("pagerank"), "in_degree", "out_degree", "community_id", "degree")


@query
def node_metrics(s, d):
    """Node table with ranks that have converged and communities."""
    e = _edges(s, d)
    names = triples.node_view(e).select(F.col("id").alias("community_id"), F.col("label").alias("community"))
    got = graph.export_nodes(e, graph.pagerank(e), graph.communities(e)).join(names, "community_id", "left")
    return got.select("label", "type", F.round("pagerank", 4).alias("pagerank"), "in_degree", "out_degree", "community", "degree")


@query
def hub_nodes(s, d):
    return graph.hubs(star_triples(s, d))


@query
def topk_subgraph(s, d):
    e = _edges(s, d)
    ranks = _ranks(e).select("id", F.round("pagerank", 9).alias("pagerank"))
    names = triples.node_view(e).select("id", "label")
    # ranks of equal size are settled by label here, since ids are no part of the result
    order = ranks.join(names, "id").orderBy(F.desc("pagerank"), "label").limit(120).select("id", F.lit(1.0).alias("pagerank"))
    return graph.top_subgraph(e, order, 120).select("subject", "predicate", "target")


@query
def topk_edges(s, d):
    return graph.top_edges(star_edges(s, d), 100).select("subject", "predicate", "target", r8(F.col("confidence")).alias("confidence"))


@query
def vis_encoding(s, d):
    nodes = graph.styled_nodes(graph.export_nodes(star_edges(s, d)))
    return nodes.select(
        "label", "size", "colour", cooccur.node_size(F.lit(10), F.col("degree")).alias("node_size"),
        cooccur.edge_width(F.col("degree")).alias("edge_width"),
    )


def _mentions(s, d):
    """All words of all sentences; capitalised ones, which stand in for a model's entities, have a type."""
    sents = segment.split_sentences(table(s, d, "documents")).withColumnRenamed("pos", "sent")
    words = F.filter(F.split("sentence", r"\s+"), lambda w: F.length(w) > 1)
    return sents.select("doc_id", "sent", F.posexplode(words).alias("pos", "label")).withColumn("type", F.when(F.col("label").rlike("^[A-Z]"), "NAME"))


@query
def sentence_cooccurrence(s, d):
    return cooccur.sentence_edges(_mentions(s, d).where("type = 'NAME'"))


@query
def mention_nodes(s, d):
    return cooccur.mention_nodes(_mentions(s, d))


@query
def svo_edges(s, d):
    """Arcs by a rule on places: of five words, a subject, its verb, two objects and one that is none."""
    words = _mentions(s, d)
    at, kind = F.col("pos"), F.col("pos") % 5
    dep = F.when(kind == 0, "nsubj").when(kind == 1, "ROOT").when(kind == 2, "attr").when(kind == 3, "dobj").otherwise("punct")
    head = F.when(kind == 0, at + 1).when(kind == 2, at - 1).when(kind == 3, at - 2).otherwise(at)
    tokens = words.select("doc_id", "sent", F.col("pos").alias("idx"), F.col("label").alias("text"), F.col("label").alias("lemma"), dep.alias("dep"), head.alias("head"))
    return cooccur.svo_edges(tokens, words.where("type = 'NAME'"))


@query
def edge_export(s, d):
    path = scratch(s, "export")
    sinks.write_graph(_edges(s, d), path)
    csv = s.read.option("header", True).csv(f"{path}/edges.csv").select("source", "target", F.col("label").alias("l2"))
    back = s.read.parquet(f"{path}/edges.parquet").join(csv, ["source", "target"]).where("label = l2")
    js = s.read.schema("source long, target long, label string, count long").json(f"{path}/edges.json").select(
        "source", "target", F.col("label").alias("l3"), F.col("count").alias("c3"),
    )
    return back.join(js, ["source", "target"]).where("label = l3 AND count = c3").select(
        "source_label", "target_label", "label", r8(F.col("weight")).alias("weight"), "count", "edge_source",
    )


@query
def node_files(s, d):
    """The node table as it is read back from its Parquet and CSV files."""
    path = scratch(s, "export")
    sinks.write_graph(_edges(s, d), path)
    csv = s.read.option("header", True).csv(f"{path}/nodes.csv").select(F.col("id").cast("long").alias("id"), F.col("degree").cast("long").alias("d2"))
    return s.read.parquet(f"{path}/nodes.parquet").join(csv, "id").where("degree = d2").select("label", "type", "in_degree", "out_degree", "degree")


@query
def checkpoint_files(s, d):
    c = table(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"), (F.col("c_custkey") % 2).alias("half"))
    path = scratch(s, "checkpoints")
    written = [sinks.checkpoint(c.where(F.col("half") == i), path) for i in (0, 1)]
    return s.read.parquet(*written).select("id", "label")


@query
def metric_rows(s, d):
    return sinks.metric_rows(triples.summary(star_edges(s, d)), "graph").select("name", r8(F.col("value")).alias("value"))


def _calibration(s, d):
    return table(s, d, "labels").select((F.col("doc_id") * 37 % 101 / 100).alias("confidence"), (F.col("quality") == 1).alias("correct"))


@query
def calibration_error(s, d):
    return quality.calibration_error(_calibration(s, d)).select(r8(F.col("error")).alias("error"))


@query
def platt_fit(s, d):
    m = quality.platt(_calibration(s, d))
    return s.createDataFrame([(round(float(m.coefficients[0]), 4), round(float(m.intercept), 4))], "slope double, intercept double")


@query
def completion_quality(s, d):
    got = quality.completion_quality(completions(s, d), ["chunk_id"])
    return got.select("chunk_id", "attempted", "kept", r8(F.col("score")).alias("score"))


@query
def candidate_scores(s, d):
    """Each chunk's completions under four settings, of which the rule gives one after another."""
    chunks = table(s, d, "customer").select(F.col("c_custkey").cast("long").alias("chunk_id"), F.col("c_name").alias("text"))

    def ask(asked: DataFrame) -> DataFrame:
        which = F.pmod(F.col("chunk_id") + F.col("setting"), F.lit(len(COMPLETIONS)))
        return asked.withColumn("completion", completion_of(which, F.col("chunk_id")))

    got = quality.candidates(chunks, ask)
    return got.select("chunk_id", "setting", "attempted", r8(F.col("score")).alias("score"))


def _preferences(s, d):
    o = table(s, d, "orders").select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("setting"))
    cand = o.select(
        F.col("o_orderkey").cast("string").alias("prompt"), F.concat_ws("-", "o_orderkey", "setting").alias("completion"),
        ((F.col("o_orderkey") + F.col("setting")) % 4).alias("attempted"),
        ((F.col("o_orderkey") * 7 + F.col("setting") * 13) % 10 / 10).alias("score"),
    )
    return quality.preference_pairs(cand)


@query
def preference_pairs(s, d):
    return _preferences(s, d)


@query
def preference_dataset(s, d):
    """The pairs as they are read back from the JSON lines that training takes."""
    path = scratch(s, "preferences")
    sinks.write_preferences(_preferences(s, d), path)
    return src.read_json_lines(s, path, sinks.PREFERENCES)


@query
def rule_extraction(s, d):
    named = table(s, d, "nation").join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat("n_name", F.lit(" is part of "), "r_name", F.lit(". Nothing here. "), "r_name", F.lit(" contains "), "n_name", F.lit("."))
    got = extractors.by_rules(named.select(F.col("n_nationkey").cast("long").alias("chunk_id"), text.alias("text")))
    return validate.parse_completions(got.drop("token_logprobs")).select(
        "chunk_id", F.col("pos").cast("long").alias("pos"), "subject", "predicate", "target", "drop_reason",
    )


def _event_stream(s, d):
    schema = table(s, d, "events").schema
    return s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").option("recursiveFileLookup", "true").parquet(d)


@query
def stream_triples(s, d):
    root = scratch(s, "stream")

    def to_triples(batch):
        return batch.select(
            F.concat(F.lit("user "), "user_id").alias("subject"), F.lit("PERSON").alias("subject_type"),
            F.lit("performs").alias("predicate"), F.col("event_type").alias("target"), F.lit("EVENT").alias("target_type"),
            F.least(F.lit(1.0), F.col("value") / 100).alias("confidence"), F.col("event_id").alias("seq"),
        )

    micro.stream_triples(_event_stream(s, d), to_triples, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return micro.edges_so_far(s, f"{root}/out").select("subject", "target", r8(F.col("confidence")).alias("confidence"), "count")


@query
def event_windows(s, d):
    root = scratch(s, "windows")
    events = _event_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    micro.stream_windows(events, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    got = micro.windows_so_far(s, f"{root}/out")
    return got.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 6).alias("total"))
