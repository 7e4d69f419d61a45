"""The whole composition on a tiny corpus, in batch and as a stream."""

from pyspark.sql import functions as F

from quillgraph.plans import pipeline
from quillgraph.sources import extractors
from quillgraph.streaming import micro


def test_text_to_graph(spark):
    docs = spark.createDataFrame([(1, "Alpha unit regulates Beta works. Beta works contains Gamma plant."), (2, "Alpha unit regulates Beta works.")], "doc_id long, text string")
    chunks = pipeline.chunk_documents(docs)
    found, drops = pipeline.extract_triples(chunks, extractors.by_rules)
    assert {r.drop_reason: r.n for r in drops.collect()} == {"dropped_sitl_subject_type": 2}
    edges = pipeline.build_graph(found)
    assert [(r.subject, r.predicate, r.target) for r in edges.collect()] == [("Beta works", "contains", "Gamma plant")]
    nodes = pipeline.analyse(edges)
    assert nodes.count() == 2 and nodes.agg(F.sum("degree")).first()[0] == 2
    assert pipeline.rescue(chunks, found, extractors.by_rules).count() >= found.count()


def test_stream_equals_batch(spark, tmp_path):
    src = tmp_path / "in"
    rows = spark.createDataFrame([("a", "LAW", "is_a", "b", "LAW", 0.5, i) for i in range(6)], "subject string, subject_type string, predicate string, target string, target_type string, confidence double, seq long")
    rows.repartition(3).write.parquet(str(src))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(src))
    micro.stream_triples(stream, lambda b: b, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = micro.edges_so_far(spark, f"{tmp_path}/out").collect()
    assert len(got) == 1 and got[0]["count"] == 6
