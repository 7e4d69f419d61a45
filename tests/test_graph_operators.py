"""Operators without SQL, against brute force on small fixtures."""

import io
import itertools
import math
import re
import zipfile
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.operators import classify, cooccur, graph, knn, quality, resolve, segment, triples
from quillgraph.ontology import DOMAIN_LABELS
from quillgraph.plans import pipeline
from quillgraph.plans.queries import QUERIES
from quillgraph.plans.star import star_edges
from quillgraph.sources import documents, sinks
from quillgraph.streaming import micro

SF = "/root/testdata/sf0.001"
EDGE = "subject string, subject_type string, predicate string, target string, target_type string, confidence double, seq long"


def edges_frame(spark, pairs):
    rows = [(f"n{a}", "LAW", "is_a", f"n{b}", "LAW", float(w), i) for i, (a, b, w) in enumerate(pairs)]
    return triples.aggregate(triples.with_ids(spark.createDataFrame(rows, EDGE)))


# --- chunks


def plain_chunks(sents, counts, most, overlap):
    done, cur, size = [], [], 0
    for i, n in enumerate(counts):
        if cur and size + n > most:
            done.append(cur)
            back, room = [], 0
            for j in reversed(cur if overlap else []):
                if room + counts[j] > int(most * overlap):
                    break
                back.insert(0, j)
                room += counts[j]
            cur, size = back, room
        cur, size = [*cur, i], size + n
    return [(" ".join(sents[i] for i in c), sum(counts[i] for i in c)) for c in [*done, cur] if c]


def test_chunks_by_fractions_and_by_sections(spark):
    weight = lambda s: len(s.split()) * 1.3
    split = lambda t: [s for s in re.split(r"(?<=[.!?])\s+", t) if s]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = defaultdict(list)
    for r in QUERIES["chunk_plain"](spark, SF).orderBy("doc_id", "chunk_no").collect():
        got[r.doc_id].append((r.text, r.n_tokens))
    for i, t in texts.items():
        s = split(t)
        want = plain_chunks(s, [weight(x) for x in s], 90, 0) or [(t, weight(t))]
        assert [c for c, _ in got[i]] == [c for c, _ in want] and np.allclose([n for _, n in got[i]], [n for _, n in want])
    sections = {(r.doc_id, r.section_no): r.text for r in QUERIES["sections_from_toc"](spark, SF).collect()}
    got = defaultdict(list)
    for r in QUERIES["section_chunks"](spark, SF).orderBy("doc_id", "section_no", "chunk_no").collect():
        got[r.doc_id, r.section_no].append((r.text, r.n_tokens))
    for key, t in sections.items():
        s = split(t)
        assert got[key] == plain_chunks(s, [int(weight(x)) for x in s], 60, 0.2)
    assert set(got) == set(sections)


def test_chunking_time_is_linear(spark):
    import time

    def took(n):
        docs = spark.createDataFrame([(1, "One two three four. " * n)], "doc_id long, text string")
        began = time.time()
        assert segment.chunk(docs, 90, 0.2).count() > n / 20
        return time.time() - began

    took(2000)
    assert took(40_000) < 12 * max(0.5, took(10_000))


def test_batches_without_a_group(spark):
    rows = [(i, (i * 37) % 11, f"t{i % 60}") for i in range(300)]
    got = segment.batches(spark.createDataFrame(rows, "i long, n_tokens long, text string").repartition(7), 8).collect()
    ordered = sorted(got, key=lambda r: (r.batch, r.n_tokens, r.text))
    assert [(r.n_tokens, r.text) for r in ordered] == sorted((n, t) for _, n, t in rows)
    assert [r.batch for r in ordered] == [i // 8 for i in range(300)]
    assert segment.batches(spark.createDataFrame([], "n_tokens long, text string"), 8).count() == 0


# --- labels and vectors


def test_nearest_label_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    labels = [(i, f"l{i}", [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(23, 4)))]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(40, 4)))]
    monkeypatch.setattr(classify, "LABELS", 5)
    got = {r.id: r.label for r in classify.nearest_label(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame(labels, "ord int, label string, vector array<double>")).collect()}
    assert got == {i: max(labels, key=lambda l: sum(a * b for a, b in zip(x, l[2])))[1] for i, x in rows}


def test_domain_tags_equal_plain_counts(spark):
    def vector(text):
        out = [0] * 256
        for w in re.findall(r"[^\W_]+", text.lower()):
            h = xxhash.xxh64_intdigest(w.encode(), seed=42)
            out[(h - 2**64 if h >= 2**63 else h) % 256] += 1
        norm = math.sqrt(sum(v * v for v in out)) or 1.0
        return [v / norm for v in out]

    labels = {k: vector(v) for k, v in DOMAIN_LABELS.items()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in QUERIES["domain_tags"](spark, SF).collect():
        x = vector(texts[r.id])
        scores = {k: sum(a * b for a, b in zip(x, y)) for k, y in labels.items()}
        assert abs(max(scores.values()) - r.score) < 1e-5 and scores[r.label] > max(scores.values()) - 1e-9


@pytest.mark.parametrize("block", [7, 16_384])
def test_knn_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(knn, "QUERY_BLOCK", block)
    monkeypatch.setattr(knn, "TILE_V", 16)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 5))
    x[30:50] = x[3]  # one vector twenty-one times
    rows = [(i, "a", [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(100, "a", None), (101, "a", [1.0, None, 0.0, 0.0, 0.0]), (102, "a", [float("nan")] * 5), (103, "a", []), (104, "a", [1.0, 2.0])]
    v = spark.createDataFrame(rows + odd, "id long, label string, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in knn.knn(v, 4).orderBy("id", "rank").collect():
        got[r.id].append((r.nbr_id, round(r.sim, 9)))
    whole = {i: r for i, _, r in rows} | {104: [1.0, 2.0, 0.0, 0.0, 0.0]}
    for i, a in whole.items():
        best = sorted((-round(float(np.dot(a, b)), 9), j) for j, b in whole.items() if j != i)[:4]
        assert got[i] == [(j, -s) for s, j in best]
    assert set(got) == set(whole)
    near = knn.knn(v, 4, threshold=1.0).collect()
    assert near and all(r.sim >= 1.0 for r in near)
    assert knn.knn(v.where("false")).count() == 0


def test_index_backends(spark):
    nodes = spark.createDataFrame([(1, "reserve bank of india"), (2, "india reserve bank"), (3, "solar power"), (4, "")], "id long, label string")
    for backend in ("exact", "lsh"):
        got = knn.build_index(knn.embed_labels(nodes), backend).search(2, 0.7).collect()
        assert {(r.id, r.nbr_id) for r in got} == {(1, 2), (2, 1)}
    with pytest.raises(ValueError):
        knn.build_index(knn.embed_labels(nodes), "other")


def test_lsh_finds_most_neighbours(spark):
    got = {(r.id, r.nbr_id) for r in QUERIES["knn_approximate"](spark, SF).collect()}
    v = spark.read.parquet(f"{SF}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.lit("").alias("label"), "embedding")
    want = {(r.id, r.nbr_id) for r in knn.knn(v, 5, 0.35).collect()}
    assert want and len(got & want) >= 0.9 * len(want) and got <= want | got


def test_cells_find_neighbours_without_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = np.repeat(rng.normal(size=(40, 8)), 50, axis=0) + 0.2 * rng.normal(size=(2000, 8))
    x[100:160] = x[100]  # one vector sixty times
    rows = [(i, [float(c) for c in r]) for i, r in enumerate(x)]
    odd = [(5000, None), (5001, [1.0, None] + [0.0] * 6), (5002, [float("nan")] * 8), (5003, [])]
    v = spark.createDataFrame(rows + odd, "id long, embedding array<double>").repartition(4)
    asked, ask = [], knn._cells_to_ask
    monkeypatch.setattr(knn, "_cells_to_ask", lambda rows, c, *a: asked.append((ask(rows, c, *a), len(c))) or asked[-1][0])
    s = x @ x.T
    np.fill_diagonal(s, -np.inf)
    for block, threshold in ((16_384, None), (700, 5.0)):
        monkeypatch.setattr(knn, "QUERY_BLOCK", block)
        got = {(r.id, r.nbr_id): r.sim for r in knn.knn_lsh(v, 4, threshold).collect()}
        want = {(r.id, r.nbr_id) for r in knn.knn(v, 4, threshold).collect()}
        assert len(got.keys() & want) >= 0.9 * len(want) and all(abs(s[p] - sim) < 1e-9 for p, sim in got.items())
        assert threshold is None or min(got.values()) >= threshold
    assert all(few <= n / 2 for few, n in asked) and len(asked) == 2
    some = knn.knn_lsh(v, 4, None, v.where("id % 50 = 0 OR id >= 5000")).collect()
    assert {r.id for r in some} == set(range(0, 2000, 50)) and max(r["rank"] for r in some) == 4
    assert [r.nbr_id for r in sorted(some, key=lambda r: r["rank"]) if r.id == 100] == [101, 102, 103, 104] or s[100].max() > s[100, 101]


def greedy_merges(vectors, lengths, k, threshold):
    """id -> canonical, by plain loops."""
    near = {}
    for i, a in vectors.items():
        sims = sorted((-float(np.dot(a, b)), j) for j, b in vectors.items() if j != i)[:k]
        near[i] = [j for s, j in sims if -s >= threshold]
    parent = {}
    for i in sorted(near):
        for j in near[i]:
            if i not in parent and j not in parent:
                keep, drop = sorted((i, j), key=lambda v: (-lengths[v], v))
                parent[drop] = keep

    def root(v):
        while v in parent:
            v = parent[v]
        return v

    return {v: root(v) for v in parent}


def test_semantic_duplicates_and_resolution(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    vectors = {r.vec_id: np.array(r.embedding, float) for r in rows}
    unit = {i: v / np.linalg.norm(v) for i, v in vectors.items()}
    merged = greedy_merges(vectors, {i: len(f"v{i}") for i in vectors}, 5, 0.4)
    assert {r.id: r.canonical for r in QUERIES["semantic_duplicates"](spark, SF).collect()} == merged and merged
    edges = defaultdict(lambda: [0, 0])
    for i in vectors:
        a, b = i, (7 * i + 3) % 100
        e = edges[merged.get(a, a), merged.get(b, b)]
        e[0] += 1
    got = QUERIES["semantic_resolution"](spark, SF).collect()
    assert {(r.src_id, r.dst_id): r["count"] for r in got if r.edge_source == "extracted"} == {k: v[0] for k, v in edges.items()}
    pairs = {}
    unit = {i: v for i, v in unit.items() if i not in merged}
    for i, a in unit.items():
        for s, j in sorted((-float(np.dot(a, b)), j) for j, b in unit.items() if j != i)[:8]:
            if -s >= 0.35 and (min(i, j), max(i, j)) not in {(min(e), max(e)) for e in edges}:
                pairs[min(i, j), max(i, j)] = round(-s, 6)
    assert {(r.src_id, r.dst_id): r.confidence for r in got if r.edge_source == "semantic_similarity"} == pairs


# --- aliases


def similarity(a, b):
    a, b = a.lower().strip(), b.lower().strip()
    wa, wb = set(a.split()), set(b.split())
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return 0.4 * len(wa & wb) / len(wa | wb) + 0.6 * (1 - row[-1] / max(len(a), len(b)))


def ratio(a, b):
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    row = [0] * (len(b) + 1)
    for x in a:
        old, row = row, [0]
        for j, y in enumerate(b, 1):
            row.append(old[j - 1] + 1 if x == y else max(old[j], row[-1]))
    return 200 * row[-1] / (len(a) + len(b))


@pytest.mark.parametrize("kind", ["token", "substring"])
@pytest.mark.parametrize("threshold", [0.6, 0.82])
def test_alias_pairs_equal_brute_force(spark, kind, threshold):
    words = ["national", "bank", "of", "india", "reserve", "export", "credit", "credits", "the"]
    rng = np.random.default_rng(1)
    names = {" ".join(rng.choice(words, size=rng.integers(1, 5))) for _ in range(70)} | {"Bank", "ank", "na", "Reserve Bank"}
    want = set()
    for a, b in itertools.permutations(names, 2):
        if (-len(a), a) < (-len(b), b):
            inside = b.lower() in a.lower() if kind == "substring" else set(b.lower().split()) <= set(a.lower().split())
            shared = set(a.lower().split()) & set(b.lower().split())
            if inside or (shared and similarity(a, b) >= threshold and ratio(a, b) >= 70):
                want.add((a, b))
    frame = spark.createDataFrame([(n,) for n in names], "label string")
    got = {(r.a, r.b) for r in resolve.alias_pairs(frame, threshold, 70.0, kind).collect()}
    assert got == want and len(want) > 20


# --- graphs


def test_pagerank_equals_power_iteration(spark):
    rng = np.random.default_rng(2)
    pairs = {(int(a), int(b)): 0.5 + 0.05 * int(rng.integers(0, 9)) for a, b in rng.integers(0, 30, size=(80, 2)) if a != b and b % 7}
    edges = edges_frame(spark, [(a, b, w) for (a, b), w in pairs.items()])
    names = {r.label: r.id for r in triples.node_view(edges).collect()}
    nodes = sorted(names)
    at = {n: i for i, n in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for (a, b), w in pairs.items():
        m[at[f"n{b}"], at[f"n{a}"]] += w
    total = m.sum(axis=0)
    share = m / np.where(total > 0, total, 1)
    x = np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        x = 0.15 / len(nodes) + 0.85 * (share @ x + x[total == 0].sum() / len(nodes))
    got = {r.id: r.pagerank for r in graph.pagerank(edges, tolerance=1e-8).collect()}
    assert np.allclose([got[names[n]] for n in nodes], x, atol=1e-7)
    loose = graph.pagerank(edges, 3, tolerance=None)
    assert loose.count() == len(nodes) and abs(loose.agg(F.sum("pagerank")).first()[0] - 1) < 1e-9
    assert graph.pagerank(edges.where("false")).count() == 0


def plain_modularity(pairs, group, resolution):
    two_m, inside, degree = 2 * sum(w for *_, w in pairs), defaultdict(float), defaultdict(float)
    for a, b, w in pairs:
        degree[group[a]] += w
        degree[group[b]] += w
        if group[a] == group[b]:
            inside[group[a]] += 2 * w
    return sum(inside[c] / two_m - resolution * (d / two_m) ** 2 for c, d in degree.items())


@pytest.mark.parametrize("small", [0, 40, 10**6])
def test_communities_at_every_size(spark, small):
    rng = np.random.default_rng(5)
    block = lambda lo: [(lo + int(a), lo + int(b), 0.5) for a, b in {tuple(sorted(p)) for p in rng.integers(0, 12, size=(60, 2)) if p[0] != p[1]}]
    pairs = [*block(0), *block(12), *block(24), (0, 12, 0.5), (13, 25, 0.5), (40, 41, 0.5)]
    edges = edges_frame(spark, pairs)
    label = {r.id: int(r.label[1:]) for r in triples.node_view(edges).collect()}
    found = graph.communities(edges, 1.0, small=small).collect()
    group = {label[r.id]: r.community_id for r in found}
    assert len(found) == len(label) and set(group.values()) <= set(label)
    for c in set(group.values()):  # named after the smallest id, and connected
        inside = {v for v in group if group[v] == c}
        assert c == min(i for i, v in label.items() if v in inside)
        reach, todo = set(), [min(inside)]
        while todo:
            v = todo.pop()
            if v not in reach:
                reach.add(v)
                todo += [b if a == v else a for a, b, _ in pairs if v in (a, b) and {a, b} <= inside]
        assert reach == inside
    planted = {v: 0 if v < 12 else 1 if v < 24 else 2 if v < 36 else 3 for v in group}
    assert plain_modularity(pairs, group, 1.0) > 0.9 * plain_modularity(pairs, planted, 1.0) > 0.3
    assert group[40] == group[41]


def test_label_propagation_equals_plain_rounds(spark):
    rng = np.random.default_rng(7)
    pairs = {tuple(sorted((int(a), int(b)))): 0.5 for a, b in rng.integers(0, 25, size=(50, 2)) if a != b}
    edges = edges_frame(spark, [(a, b, w) for (a, b), w in pairs.items()])
    ident = {r.label: r.id for r in triples.node_view(edges).collect()}
    near = defaultdict(list)
    for a, b in pairs:
        near[ident[f"n{a}"]].append(ident[f"n{b}"])
        near[ident[f"n{b}"]].append(ident[f"n{a}"])
    c = {v: v for v in near}
    for _ in range(5):
        votes = {v: defaultdict(float) for v in near}
        for v in near:
            for x in near[v]:
                votes[v][c[x]] += 0.5
        c = {v: min(votes[v], key=lambda l: (-votes[v][l], l)) for v in near}
    assert {r.id: r.community_id for r in graph.label_propagation(edges).collect()} == c


def test_star_graph_queries_without_sql(spark):
    edges = star_edges(spark, SF)
    metrics = {r.label: r for r in QUERIES["node_metrics"](spark, SF).collect()}
    ranks = {r.label: r.pagerank for r in QUERIES["pagerank_converged"](spark, SF).collect()}
    groups = {r.label: r.community for r in QUERIES["communities"](spark, SF).collect()}
    degree = {r.label: r.degree for r in QUERIES["in_out_degree"](spark, SF).collect()}
    assert set(metrics) == set(ranks) == set(groups) == {r.label for r in triples.node_view(edges).select("label").collect()}
    assert all((m.pagerank, m.community, m.degree) == (ranks[n], groups[n], degree[n]) for n, m in metrics.items())


def test_subject_verb_object(spark):
    words = [("Ada", "Ada", "nsubj", 1), ("founded", "Found", "ROOT", 1), ("Acme", "Acme", "dobj", 1), ("Ltd", "Ltd", "punct", 2), ("it", "it", "nsubj", 5), ("grew", "grow", "ROOT", 5)]
    more = [("Ada", "Ada", "nsubjpass", 1), ("sold", "sell", "ROOT", 1), ("x", "x", "attr", 1), ("Acme", "Acme", "obj", 1)]
    tokens = [(1, s, i, t, lemma, dep, h) for s, sent in ((0, words), (1, more)) for i, (t, lemma, dep, h) in enumerate(sent)]
    names = [(1, 0, 0, "Ada Byron"), (1, 0, 1, "Acme Ltd"), (1, 1, 0, "Acme Ltd")]
    got = cooccur.svo_edges(spark.createDataFrame(tokens, "doc_id long, sent int, idx int, text string, lemma string, dep string, head int"), spark.createDataFrame(names, "doc_id long, sent int, pos int, label string"))
    assert sorted(map(tuple, got.collect())) == [(1, "Ada", "x", "sell", 1), (1, "Ada Byron", "Acme Ltd", "found", 1)]


# --- quality, sources, streams


def test_platt_equals_newton(spark):
    x = np.array([0.1, 0.2, 0.3, 0.4, 0.6, 0.7, 0.8, 0.9, 0.95, 0.5])
    y = np.array([0, 0, 1, 0, 1, 0, 1, 1, 1, 0])
    m = quality.platt(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(x, y)], "confidence double, correct boolean"))
    w = np.zeros(2)
    design, penalty = np.stack([x, np.ones(10)], axis=1), np.diag([1 / 10, 0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-design @ w))
        grad = design.T @ (p - y) / 10 + penalty @ w
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) / 10 + penalty, grad)
    assert np.allclose([m.coefficients[0], m.intercept], w, atol=1e-4)


def test_files_of_every_kind(spark, tmp_path):
    body = "<w:document><w:body><w:p><w:r><w:t>One &amp; two</w:t></w:r></w:p><w:p><w:r><w:t xml:space='preserve'>three </w:t></w:r><w:r><w:t>four</w:t></w:r></w:p></w:body></w:document>"
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "a.docx").write_bytes(packed.getvalue())
    (tmp_path / "b.txt").write_text("five\nsix")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in documents.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "One & two\nthree four", "b.txt": "five\nsix"}
    assert [r.text for r in documents.read_texts(spark, f"{tmp_path}/b.txt").collect()] == ["five\nsix"]


def test_checkpoints_are_numbered_and_lines_read_strictly(spark, tmp_path):
    one = spark.createDataFrame([(1,)], "x int")
    paths = [sinks.checkpoint(one, f"{tmp_path}/c") for _ in range(3)]
    assert [p.rsplit("-", 1)[1] for p in paths] == ["00000", "00001", "00002"]
    (tmp_path / "lines.json").write_text('{"prompt":"a","chosen":"b","rejected":"c","chosen_score":1.0,"rejected_score":0.5}\n')
    assert documents.read_json_lines(spark, f"{tmp_path}/lines.json", sinks.PREFERENCES).first().chosen == "b"
    (tmp_path / "bad.json").write_text('{"prompt": \n')
    with pytest.raises(Exception, match="(?i)malformed|corrupt|parse"):
        documents.read_json_lines(spark, f"{tmp_path}/bad.json", sinks.PREFERENCES).collect()


def test_windows_leave_out_late_rows(spark, tmp_path):
    src = tmp_path / "in"
    schema = "event_type string, value double, ts timestamp"
    day = lambda d, h: f"2024-01-{d:02d} {h:02d}:00:00"

    def send(rows):
        frame = spark.createDataFrame(rows, "event_type string, value double, t string").select("event_type", "value", F.col("t").cast("timestamp").alias("ts"))
        frame.coalesce(1).write.mode("append").parquet(str(src))
        stream = spark.readStream.schema(schema).parquet(str(src))
        micro.stream_windows(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()

    send([("a", 1.0, day(1, 10)), ("a", 2.0, day(3, 10))])
    send([("a", 4.0, day(3, 9)), ("a", 8.0, day(1, 11))])  # late but allowed; too late
    got = {r.start.day: (r.n, r.total) for r in micro.windows_so_far(spark, f"{tmp_path}/out").collect()}
    assert got == {1: (1, 1.0), 3: (2, 6.0)}


def test_semantic_stage_of_the_composition(spark):
    rows = [("Alpha Unit", "ORGANIZATION", "regulates", "Trade", "CONCEPT", 0.9, 0), ("First Office", "ORGANIZATION", "regulates", "Credit", "CONCEPT", 0.9, 1), ("Credit", "CONCEPT", "is_a", "Topic", "CONCEPT", 0.9, 2)]
    found = spark.createDataFrame(rows, EDGE).withColumn("chunk_id", F.lit(1).cast("long"))
    places = {"Alpha Unit": [1.0, 0.0, 0.0], "First Office": [0.99, 0.1, 0.0], "Trade": [0.0, 1.0, 0.0], "Credit": [0.0, 0.8, 0.6], "Topic": [0.0, 0.0, 1.0]}

    def vectors(nodes):
        known = spark.createDataFrame(list(places.items()), "label string, embedding array<double>")
        return nodes.select("id", "label").join(known, "label").select("id", "label", "embedding")

    got = pipeline.build_graph(found, pipeline.Settings(), vectors).collect()
    regulates = [r for r in got if r.predicate == "regulates"]
    assert len(regulates) == 2 and len({r.src_id for r in regulates}) == 1  # the two offices are one now
    proposed = {(*sorted((r.subject, r.target)), round(r.confidence, 3), r.edge_source) for r in got if r.predicate == "semantically_similar_to"}
    assert proposed == {("Credit", "Trade", 0.8, "semantic_similarity")}
    plain = pipeline.build_graph(found, pipeline.Settings(index=None), vectors).collect()
    assert len(plain) == 3 and len({r.src_id for r in plain if r.predicate == "regulates"}) == 2
