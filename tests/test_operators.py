"""Hand-made rows with outcomes that follow from the operators' rules."""

import math

import pytest
from pyspark.sql import functions as F

from quillgraph.functions.text import canonical_label, entity_similarity, exact_entity_id, good_shape, token_count, token_sort_ratio
from quillgraph.ontology import triple_json_schema
from quillgraph.operators import enrich, graph, knn, quality, resolve, segment, triples, validate
from quillgraph.sources import documents, extractors, sinks


def column(spark, values, expr, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("x"))).collect()]


def test_canonical_label(spark):
    given = ['  The   RBI. ', "the the bank", "Theory", ";A,", "An x", None, ""]
    assert column(spark, given, canonical_label) == ["rbi", "the bank", "theory", "a", "x", None, ""]


def test_entity_shape(spark):
    given = ["RBI", "A", "x" * 80, "x" * 81, "a_b c d e f g", "a_b c d e f g h", "Smith (2019)", "Yes. No.", "U.S. Treasury", "St. Louis"]
    assert column(spark, given, good_shape) == [True, False, True, False, True, False, False, False, False, True]


def test_similarity_and_ratio(spark):
    df = spark.createDataFrame([("export credit", "export credits"), ("a b", "b a")], "a string, b string")
    got = df.select(entity_similarity(F.col("a"), F.col("b")).alias("s"), token_sort_ratio(F.col("a"), F.col("b")).alias("r")).collect()
    assert abs(got[0].s - (0.4 / 3 + 0.6 * 13 / 14)) < 1e-9
    assert got[1].r == 100.0 and abs(got[0].r - 200 * 13 / 27) < 1e-9


def test_exact_ids_use_seed_zero(spark):
    assert column(spark, ["abc"], exact_entity_id) == [4952883123889572249]


def plain_chunks(text, most, overlap):
    import re

    parts = [s for s in re.split(r"(?<=[.!?])\s+", text) if s]
    n = lambda s: int(len(s.split()) * 1.3)
    done, cur, size = [], [], 0
    for s in parts:
        if cur and size + n(s) > most:
            done.append(cur)
            back, room = [], 0
            for t in reversed(cur):
                if room + n(t) > int(most * overlap):
                    break
                back.insert(0, t)
                room += n(t)
            cur, size = back, room
        cur, size = [*cur, s], size + n(s)
    if cur:
        done.append(cur)
    return [" ".join(c) for c in done] or [text]


@pytest.mark.parametrize("overlap", [0.2, 0.0])
def test_chunks_equal_a_plain_loop(spark, overlap):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, ""), (-2, "no mark at all"), (-3, None)], "doc_id long, text string")
    docs = docs.unionByName(extra)
    got = {}
    for r in segment.chunk(docs, 90, overlap).orderBy("doc_id", "chunk_no").collect():
        got.setdefault(r.doc_id, []).append(r.text)
    for r in docs.collect():
        assert got.get(r.doc_id, []) == ([] if r.text is None else plain_chunks(r.text, 90, overlap))


def test_token_count(spark):
    assert column(spark, ["one two three", "", " x "], token_count) == [3, 0, 1]


GOOD = '{"subject":"RBI","subject_type":"ORGANIZATION","predicate":"regulates","target":"banks","target_type":"ORGANIZATION"}'


def test_completion_parsing(spark):
    bad = GOOD.replace("regulates", "works_at")
    given = ["not json", f"```\n{GOOD}\n```", '{"foo":1}', '{"triples":null}', "7", f'{{"triples":[{GOOD},{bad}]}}', f'{{"triples":[{GOOD.replace(chr(34) + "RBI" + chr(34), "5")}]}}', f"[{GOOD},{GOOD}]", f'{{"triples":[{GOOD[:-1]},"z":1}}]}}', f'{{"triples":[{GOOD.replace("RBI", "   ")}]}}', None]
    df = spark.createDataFrame(list(enumerate(given)), "chunk_id int, completion string")
    got = {}
    for r in validate.parse_completions(df).collect():
        got.setdefault(r.chunk_id, []).append(r.drop_reason)
    json_error, schema = ["dropped_json_parse_error"], ["dropped_schema_invalid"]
    assert got == {0: json_error, 1: json_error, 3: schema, 4: schema, 5: schema, 6: schema, 7: [None, None], 8: [None], 9: ["dropped_missing_field"], 10: json_error}


def test_rules(spark):
    rows = [("A b", "ENTITY", "is_a", "Cc", "LAW", "dropped_sitl_type_enum"), ("Aa", "METRIC", "develops", "Bb", "PERSON", "dropped_sitl_combo"), ("Aa", "CONCEPT", "regulates", "Bb", "LAW", "dropped_sitl_subject_type"), ("x", "LAW", "is_a", "Bb", "LAW", "dropped_sitl_too_short"), ("RBI", "LAW", "related_to", "rbi", "LAW", "dropped_sitl_self_loop"), ("Paris", "LOCATION", "part_of", "France", "LOCATION", None)]
    df = spark.createDataFrame(rows, "subject string, subject_type string, predicate string, target string, target_type string, want string")
    assert validate.rule_filter(df).where(~F.col("drop_reason").eqNullSafe(F.col("want"))).count() == 0


def test_logprobs(spark):
    got = column(spark, [[], [None], [0.0], [-0.1, None, -0.3]], validate.logprob_confidence, "array<double>")
    assert got[:3] == [0.75, 0.75, 1.0] and abs(got[3] - math.exp(-1.6)) < 1e-9


def test_toon(spark):
    text = "TRIPLE source:\"Bengio's lab\" type:\"ORGANIZATION\" predicate:\"uses\" target:\"BERT\" confidence:1.5\nTRIPLE source:\"\" predicate:\"p\" target:\"t\" confidence:0.5"
    got = validate.parse_toon(spark.createDataFrame([(1, text), (2, 'TRIPLE source:"a" predicate:"b" target:"Google Inc"')], "id int, t string"), "id", "t").orderBy("id").collect()
    assert [(r.subject, r.subject_type, r.target, r.confidence) for r in got] == [("Bengio's lab", "ORGANIZATION", "BERT", 1.0), ("a", "ENTITY", "Google Inc", 0.8)]


def test_least_votes():
    assert [enrich.least_votes(n) for n in range(1, 9)] == [None, None, 3, 4, 5, 5, 6, 7]


def test_enrichment(spark):
    cols = "chunk_id long, subject string, subject_type string, predicate string, target string, target_type string, confidence double, seq long"
    one = [(1, "A", "LAW", "is_a", "B", "LAW", 0.9, 0)]
    two = [(2, "A", "LAW", "is_a", "B", "LAW", 0.9, 0), (2, "C", "LAW", "is_a", "D", "LAW", 0.9, 1)]
    chunks = spark.createDataFrame([(1, "a b"), (2, "a b c d")], "chunk_id long, text string")
    got = enrich.cooccurrence(spark.createDataFrame(one + two, cols), chunks).collect()
    assert sorted((r.chunk_id, r.subject, r.target, r.confidence) for r in got) == [(2, x, y, 0.65) for x in "AB" for y in "CD"]


def test_alias_clusters(spark):
    labels = spark.createDataFrame([("Reserve Bank of India",), ("Reserve Bank",), ("Bank",), ("CHAIR",), ("AI",)], "label string")
    got = {r.label: r.leader for r in resolve.alias_clusters(labels, containment="substring").collect()}
    assert got == {"Reserve Bank of India": "Reserve Bank of India", "Reserve Bank": "Reserve Bank of India", "Bank": "Reserve Bank of India", "CHAIR": "CHAIR", "AI": "CHAIR"}
    word = {r.label: r.leader for r in resolve.alias_clusters(labels).collect()}
    assert word["AI"] == "AI" and word["Bank"] == "Reserve Bank of India"


def edges_frame(spark, pairs):
    rows = [(f"n{a}", "LAW", "is_a", f"n{b}", "LAW", 0.9, i) for i, (a, b) in enumerate(pairs)]
    return triples.aggregate(triples.with_ids(spark.createDataFrame(rows, "subject string, subject_type string, predicate string, target string, target_type string, confidence double, seq long")))


def test_communities_are_connected_and_better_than_singletons(spark):
    clique = lambda vs: [(a, b) for a in vs for b in vs if a < b]
    e = edges_frame(spark, clique(range(5)) + clique(range(5, 10)) + [(0, 5)])
    got = graph.communities(e, 1.0)
    assert got.count() == 10 and got.select("community_id").distinct().count() == 2
    single = got.select("id", F.col("id").alias("community_id"))
    assert graph.modularity(e, got).first()[0] > graph.modularity(e, single).first()[0]


def test_pagerank_sums_to_one(spark):
    got = graph.pagerank(edges_frame(spark, [(0, 1), (1, 2), (2, 0), (3, 0), (4, 5)]), 30)
    assert abs(got.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9


def test_duplicates_and_lsh(spark):
    v = spark.createDataFrame([(1, "long name", [1.0, 0.0]), (2, "name", [0.999, 0.0447]), (3, "other", [0.0, 1.0])], "id long, label string, embedding array<double>")
    assert [(r.id, r.canonical) for r in knn.duplicates(v, 0.9).collect()] == [(2, 1)]
    assert {(r.id, r.nbr_id) for r in knn.knn_lsh(v, 1, 0.9).collect()} == {(1, 2), (2, 1)}


def test_calibration(spark):
    df = spark.createDataFrame([(0.95, True)] * 4, "confidence double, correct boolean")
    assert abs(quality.calibration_error(df).first()[0] - 0.05) < 1e-12
    assert quality.calibration_error(df.where("false")).first()[0] == 0
    bins = quality.calibration_bins(spark.createDataFrame([(0.0, True), (0.3, True)], "confidence double, correct boolean"))
    assert sorted(r.bin for r in bins.collect()) == [0, 2]
    with pytest.raises(ValueError):
        quality.platt(df)


def test_sections(spark):
    page = "x" * 90
    pages = spark.createDataFrame([(1, i, page) for i in range(17)], "doc_id long, page_no long, text string")
    assert sorted(r.title for r in documents.sections_from_blocks(pages).collect()) == ["pages_17_17", "pages_1_8", "pages_9_16"]
    toc = spark.createDataFrame([(1, 0, 1, "a", 2), (1, 1, 1, "b", 2), (1, 2, 3, "deep", 3)], "doc_id long, entry_no int, level int, title string, page_no long")
    assert [r.title for r in documents.sections_from_toc(pages, toc).collect()] == ["b"]
    short = spark.createDataFrame([(1, 0, "y" * 79), (2, 0, "y" * 80)], "doc_id long, page_no long, text string")
    assert [r.doc_id for r in documents.sections_from_blocks(short).collect()] == [2]


def test_files_and_html(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("é one".encode("latin-1"))
    (tmp_path / "b.txt").write_text("two ü")
    got = sorted(r.text for r in documents.read_files(spark, str(tmp_path)).collect())
    assert got == ["two ü", "é one"]
    page = sinks.html_view(edges_frame(spark, [(0, 1), (1, 2)]))
    assert "3 nodes, 2 edges" in page


def test_http_extractor_orders_choices(spark):
    def send(url, payload):
        assert url == "http://model/v1/completions"
        return {"choices": [{"index": i, "text": p[-9:], "logprobs": {"token_logprobs": [None, -0.5]}} for i, p in reversed(list(enumerate(payload["prompt"])))]}

    chunks = spark.createDataFrame([(i, f"t{i}") for i in range(5)], "chunk_id long, text string")
    got = extractors.by_http(chunks, "http://model/", "m", batch=2, send=send).orderBy("chunk_id").collect()
    assert [r.completion for r in got] == [f"t{i}\n\nJSON:" for i in range(5)] and got[0].token_logprobs == [-0.5]
    assert triple_json_schema()["properties"]["triples"]["maxItems"] == 20


def test_knn_settles_ties_of_many_copies_by_id(spark):
    # 60 copies of one vector, read in falling order of id: more ties than k + 8
    rows = [(i, "a", [0.6, 0.8, 0.0]) for i in range(60)] + [(i, "b", [0.0, 0.6, 0.8]) for i in range(60, 80)]
    v = spark.createDataFrame(rows[::-1], "id long, label string, embedding array<double>").repartition(3, "id")
    got = {}
    for r in knn.knn(v, 3).collect():
        got.setdefault(r.id, {})[r["rank"]] = r.nbr_id
    assert got == {i: dict(enumerate([j for j in (range(60) if i < 60 else range(60, 80)) if j != i][:3], 1)) for i in range(80)}


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["communities", "label_propagation"])
def test_communities_have_the_orders(spark, name):
    from quillgraph.operators import triples
    from quillgraph.plans.queries import QUERIES
    from quillgraph.plans.star import star_edges

    edges = star_edges(spark, SF)
    want = {r.label for r in triples.node_view(edges).select("label").collect()}
    got = {r.label for r in QUERIES[name](spark, SF).select("label").collect()}
    assert got == want and any(label.startswith("Order ") for label in got)


def test_domain_tags_read_whole_texts(spark, tmp_path):
    from quillgraph.ontology import DOMAIN_LABELS
    from quillgraph.plans.queries import QUERIES

    label, words = list(DOMAIN_LABELS.items())[-1]
    text = "zzz " * 500 + f"{words} " * 400  # every word of a domain is past character 2000
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["domain_tags"](spark, str(tmp_path)).first()
    assert got.label == label and got.score > 0.5
