"""Graph analytics over edge tables: degrees, PageRank, components, communities, exports."""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ontology import TYPE_COLOURS, map_literal
from ..storage import discard, materialize
from .triples import endpoints

#: Edges up to which communities are settled in one worker for each connected component;
#: larger graphs are moved and aggregated by joins until they are as small.
SMALL = 300_000


def simple_edges(edges: DataFrame, multigraph: bool = False) -> DataFrame:
    """(src_id, dst_id, weight): parallel edges become one of the least confidence, unless multigraph."""
    if multigraph:
        return edges.select("src_id", "dst_id", F.col("confidence").alias("weight"))
    return edges.groupBy("src_id", "dst_id").agg(F.min("confidence").alias("weight"))


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v, weight), u <= v, one row per pair."""
    return edges.groupBy(F.least("src_id", "dst_id").alias("u"), F.greatest("src_id", "dst_id").alias("v")).agg(F.min("confidence").alias("weight"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, in_degree, out_degree, degree), in one grouped pass over both ends."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"), F.count("*").alias("degree"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(id, label, type, in_degree, out_degree, degree): smallest label and type, in one grouped pass over both ends."""
    return endpoints(edges).groupBy("id").agg(
        F.min("label").alias("label"), F.min("type").alias("type"),
        F.sum("side").alias("in_degree"), F.sum(1 - F.col("side")).alias("out_degree"), F.count("*").alias("degree"),
    )


def pagerank(edges: DataFrame, iterations: int = 100, damping: float = 0.85, weighted: bool = True, tolerance: float | None = 1e-5) -> DataFrame:
    """(id, pagerank) from a uniform start, until a step moves less than ``tolerance`` in all, or
    for ``iterations`` steps (exactly so many if tolerance is None).

    The edges are read once.  A step is one join on src_id and one grouped sum; its result is
    written, and two numbers come back: the mass of nodes without out-edges, and what moved.
    """
    w = F.col("weight") if weighted else F.lit(1.0)
    flat = materialize(simple_edges(edges).select("src_id", "dst_id", w.alias("w")), "flat")
    out = flat.groupBy("src_id").agg(F.sum("w").alias("total")).where("total > 0")
    links = materialize(flat.join(out, "src_id").select("src_id", "dst_id", (F.col("w") / F.col("total")).alias("share")), "links")
    ends = flat.select(F.explode(F.array("src_id", "dst_id")).alias("id"), F.lit(False).alias("has"))
    nodes = ends.unionByName(links.select(F.col("src_id").alias("id"), F.lit(True).alias("has"))).groupBy("id").agg(F.max("has").alias("has"))
    nodes = materialize(nodes, "nodes")
    n, loose = nodes.agg(F.count("*"), F.coalesce(F.avg((~F.col("has")).cast("double")), F.lit(0.0))).first()
    if n == 0:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    ranks, written = nodes.select("id", "has", F.lit(1.0 / n).alias("r")), [flat]
    for _ in range(iterations):
        # a node's own row carries its old rank beside what its neighbours give
        given = links.join(ranks.select(F.col("id").alias("src_id"), "r"), "src_id").select(
            F.col("dst_id").alias("id"), F.lit(False).alias("has"), (F.col("r") * F.col("share")).alias("g"),
            F.lit(0.0).alias("was"),
        )
        own = ranks.select("id", "has", F.lit(0.0).alias("g"), F.col("r").alias("was"))
        met = given.unionByName(own).groupBy("id").agg(F.max("has").alias("has"), F.sum("g").alias("g"), F.sum("was").alias("was"))
        new = materialize(met.select("id", "has", ((1 - damping) / n + damping * (F.col("g") + F.lit(loose / n))).alias("r"), "was"), "ranks")
        discard(*written)
        loose, moved = new.agg(F.coalesce(F.sum(F.when(~F.col("has"), F.col("r"))), F.lit(0.0)), F.sum(F.abs(F.col("r") - F.col("was")))).first()
        ranks, written = new.select("id", "has", "r"), [new]
        if tolerance is not None and moved < tolerance:
            break
    return ranks.select("id", F.col("r").alias("pagerank"))


def connected_components(pairs: DataFrame) -> DataFrame:
    """(id, component): smallest id that each end of the pairs (u, v) reaches."""
    edges = materialize(pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "pairs")
    labels = written = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("id"), F.least("u", "m").alias("c")), "labels")
    while True:
        near = edges.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u").agg(F.min("c").alias("m"))
        low = labels.join(near.withColumnRenamed("u", "id"), "id", "left").select("id", "c", F.least("c", "m").alias("d"))
        jump = low.select(F.col("id").alias("d"), F.col("d").alias("e"))
        new = materialize(low.join(jump, "d", "left").select("id", F.least("d", "e").alias("c"), (F.least("d", "e") < F.col("c")).alias("moved")), "labels")
        discard(written)
        labels, written = new.select("id", "c"), new
        if new.where("moved").isEmpty():
            discard(edges)
            return labels.select("id", F.col("c").alias("component"))


def _local_moves(edges: list[tuple[int, int, float]], degree: dict[int, float], two_m: float, resolution: float) -> dict[int, int]:
    """Greedy modularity moves from a queue of nodes whose neighbourhood changed, then a split of every
    community into connected parts; aggregated until stable."""
    member = {v: v for v in sorted(degree)}
    graph: dict[int, dict[int, float]] = {v: {} for v in member}
    for u, v, w in edges:
        if u != v:
            graph[u][v] = graph[u].get(v, 0.0) + w
            graph[v][u] = graph[v].get(u, 0.0) + w
    weight = dict(degree)
    while True:
        com, total = {v: v for v in graph}, dict(weight)
        queue, waits = deque(sorted(graph)), set(graph)
        while queue:
            v = queue.popleft()
            waits.discard(v)
            links: dict[int, float] = {}
            for x, w in graph[v].items():
                c = com[x]
                links[c] = links.get(c, 0.0) + w
            own, k = com[v], resolution * weight[v] / two_m
            total[own] -= weight[v]
            best, most = own, round(links.get(own, 0.0) - k * total[own], 12)
            for c in sorted(links):
                gain = round(links[c] - k * total[c], 12)
                if gain > most:
                    best, most = c, gain
            total[best] += weight[v]
            if best != own:
                com[v] = best
                for x in graph[v]:
                    if com[x] != best and x not in waits:
                        queue.append(x)
                        waits.add(x)
        # refinement: a community that fell apart becomes its connected parts
        part: dict[int, int] = {}
        for v in sorted(graph):
            if v not in part:
                part[v], stack = v, [v]
                while stack:
                    for x in graph[stack.pop()]:
                        if x not in part and com[x] == com[v]:
                            part[x] = v
                            stack.append(x)
        if len(set(part.values())) == len(graph):
            return member
        member = {v: part[c] for v, c in member.items()}
        merged: dict[int, dict[int, float]] = {c: {} for c in set(part.values())}
        heavy: dict[int, float] = dict.fromkeys(merged, 0.0)
        for v, near in graph.items():
            heavy[part[v]] += weight[v]
            for x, w in near.items():
                if part[x] != part[v]:
                    merged[part[v]][part[x]] = merged[part[v]].get(part[x], 0.0) + w
        graph, weight = merged, heavy


def _spread_moves(flat: DataFrame, nodes: DataFrame, two_m: float, resolution: float, rounds: int) -> DataFrame:
    """(id, part): the same moves by joins, all nodes at once, split into connected parts.

    In each round every node weighs its neighbours' communities, and a hash of node and round
    lets half of those that gain by it move, so that two neighbours do not swap for ever.
    """
    both = materialize(flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")), "both")
    labels = written = materialize(nodes.select("id", "k", F.col("id").alias("c")), "labels")
    for step in range(rounds):
        total = labels.groupBy("c").agg(F.sum("k").alias("total"))
        near = both.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy(F.col("u").alias("id"), "c").agg(F.sum("weight").alias("w"))
        own = labels.select("id", "c", F.lit(0.0).alias("w"))
        choice = near.unionByName(own).groupBy("id", "c").agg(F.sum("w").alias("w")).join(total, "c").join(labels.select("id", "k", F.col("c").alias("own")), "id")
        without = F.col("total") - F.when(F.col("c") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("w") - resolution * F.col("k") * without / two_m, 12)
        best = choice.groupBy("id", "k", "own").agg(F.min(F.struct((-gain).alias("g"), (F.col("c") != F.col("own")).alias("other"), "c")).alias("b"))
        go = F.pmod(F.xxhash64("id", F.lit(step)), F.lit(2)) == 0
        new = best.select("id", "k", F.when(go, F.col("b.c")).otherwise(F.col("own")).alias("c"), F.col("b.other").alias("wants"))
        new = materialize(new, "labels")
        discard(written)
        labels, written = new.select("id", "k", "c"), new
        if new.where("wants").isEmpty():
            break
    inside = flat.join(labels.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(labels.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v").where("cu = cv")
    parts = connected_components(inside.select("u", "v"))
    out = materialize(nodes.select("id").join(parts, "id", "left").select("id", F.coalesce("component", "id").alias("part")), "parts")
    discard(both, written)
    return out


def communities(edges: DataFrame, resolution: float = 1.2, rounds: int = 8, small: int = SMALL) -> DataFrame:
    """(id, community_id): modularity communities, every one connected; ids are their smallest member's.

    Move, refine and aggregate as in Leiden.  While a graph has more than ``small`` edges this
    goes by joins, level after level; the aggregated rest is settled in node order, one
    connected component per Arrow group, with the whole graph's weight.  Should levels stop
    shrinking a graph before it is small, its parts are the communities.
    """
    flat = materialize(undirected(edges).where("u <> v"), "undirected")
    ends = flat.select(F.explode(F.array("u", "v")).alias("id"), "weight")
    nodes = materialize(ends.groupBy("id").agg(F.sum("weight").alias("k")), "nodes")
    two_m = float(nodes.agg(F.coalesce(F.sum("k"), F.lit(0.0))).first()[0]) or 1.0
    member = nodes.select("id", F.col("id").alias("part"))
    count, before = flat.count(), nodes.count()
    while count > small:
        parts = _spread_moves(flat, nodes, two_m, resolution, rounds)
        member = materialize(member.join(parts.select(F.col("id").alias("part"), F.col("part").alias("to")), "part").select("id", F.col("to").alias("part")), "member")
        sides = flat.join(parts.select(F.col("id").alias("u"), F.col("part").alias("pu")), "u").join(parts.select(F.col("id").alias("v"), F.col("part").alias("pv")), "v").where("pu <> pv")
        flat = materialize(sides.groupBy(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).agg(F.sum("weight").alias("weight")), "undirected")
        nodes = materialize(nodes.join(parts, "id").groupBy(F.col("part").alias("id")).agg(F.sum("k").alias("k")), "nodes")
        count, left = flat.count(), nodes.count()
        if left == before:
            break
        before = left
    if count > small:
        settled = nodes.select("id", F.col("id").alias("community"))
    else:
        comps = connected_components(flat.select("u", "v"))
        rows = flat.join(comps.select(F.col("id").alias("u"), "component"), "u")
        rows = rows.join(nodes.select(F.col("id").alias("u"), F.col("k").alias("ku")), "u").join(nodes.select(F.col("id").alias("v"), F.col("k").alias("kv")), "v")

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            degree = dict(zip(pdf.u.tolist(), pdf.ku.tolist(), strict=True)) | dict(zip(pdf.v.tolist(), pdf.kv.tolist(), strict=True))
            got = _local_moves(sorted(zip(pdf.u.tolist(), pdf.v.tolist(), pdf.weight.tolist(), strict=True)), degree, two_m, resolution)
            return pd.DataFrame({"id": list(got), "community": list(got.values())})

        found = rows.groupBy("component").applyInPandas(run, "id long, community long")
        settled = nodes.select("id").join(found, "id", "left").select("id", F.coalesce("community", "id").alias("community"))
    named = materialize(member.join(settled.select(F.col("id").alias("part"), "community"), "part").select("id", "community"), "settled")
    low = named.groupBy("community").agg(F.min("id").alias("community_id"))
    return named.join(low, "community").select("id", "community_id")


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """(id, community_id): synchronous, deterministic; the heaviest neighbouring label, ties to the smaller."""
    flat = materialize(undirected(edges).where("u <> v"), "undirected")
    both = materialize(flat.unionByName(flat.select(F.col("v").alias("u"), F.col("u").alias("v"), "weight")), "both")
    labels = both.select(F.col("u").alias("id"), F.col("u").alias("c")).distinct()
    for _ in range(rounds):
        votes = both.join(labels.select(F.col("id").alias("v"), "c"), "v").groupBy("u", "c").agg(F.sum("weight").alias("w"))
        labels = materialize(votes.groupBy("u").agg(F.min_by("c", F.struct(-F.col("w"), "c")).alias("c")).withColumnRenamed("u", "id"), "labels")
    return labels.select("id", F.col("c").alias("community_id"))


def modularity(edges: DataFrame, groups: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row (modularity) of a grouping (id, community_id) over undirected weights."""
    flat = undirected(edges)
    g = groups.select(F.col("id"), F.col("community_id").alias("c"))
    j = flat.join(g.select(F.col("id").alias("u"), F.col("c").alias("cu")), "u").join(g.select(F.col("id").alias("v"), F.col("c").alias("cv")), "v")
    inside = j.where("cu = cv").groupBy(F.col("cu").alias("c")).agg(F.sum("weight").alias("inside"))
    total = j.select(F.explode(F.array(F.struct(F.col("cu").alias("c"), "weight"), F.struct(F.col("cv").alias("c"), "weight"))).alias("x")).groupBy("x.c").agg(F.sum("x.weight").alias("deg"))
    m = flat.agg(F.sum("weight").alias("m"))
    per = total.join(inside, "c", "left").crossJoin(F.broadcast(m))  # m is one row
    return per.agg(F.coalesce(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("deg") / (2 * F.col("m")), 2)), F.lit(0.0)).alias("modularity"))


def export_nodes(edges: DataFrame, ranks: DataFrame | None = None, groups: DataFrame | None = None) -> DataFrame:
    """id, label, type, pagerank, in_degree, out_degree, community_id, degree; missing metrics are 0, 0, 0, -1."""
    nodes = node_degrees(edges)
    nodes = nodes.join(ranks, "id", "left") if ranks is not None else nodes.withColumn("pagerank", F.lit(0.0))
    nodes = nodes.join(groups, "id", "left") if groups is not None else nodes.withColumn("community_id", F.lit(-1).cast("long"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select(
        "id", "label", "type", F.coalesce("pagerank", F.lit(0.0)).alias("pagerank"), zero("in_degree"), zero("out_degree"),
        F.coalesce("community_id", F.lit(-1).cast("long")).alias("community_id"), zero("degree"),
    )


def export_edges(edges: DataFrame) -> DataFrame:
    source = F.col("edge_source") if "edge_source" in edges.columns else F.lit("extracted")
    return edges.select(
        F.col("src_id").alias("source"), F.col("dst_id").alias("target"), F.col("subject").alias("source_label"),
        F.col("target").alias("target_label"), F.col("predicate").alias("label"), F.col("confidence").alias("weight"), "count",
        source.alias("edge_source"),
    )


def hubs(triples: DataFrame, n: int = 5) -> DataFrame:
    """(label, connections): the n most connected labels of raw triples, ties by label."""
    return triples.select(F.explode(F.array("subject", "target")).alias("label")).groupBy("label").agg(F.count("*").alias("connections")).orderBy(F.desc("connections"), "label").limit(n)


def top_edges(edges: DataFrame, n: int = 20_000) -> DataFrame:
    return edges.orderBy(F.desc("confidence"), "subject", "predicate", "target").limit(n)


def top_subgraph(edges: DataFrame, ranks: DataFrame, n: int = 60) -> DataFrame:
    """Edges between the n nodes of the highest rank (ties to the smaller id)."""
    top = ranks.orderBy(F.desc("pagerank"), "id").limit(n).select("id")
    out = edges.join(F.broadcast(top.withColumnRenamed("id", "src_id")), "src_id", "left_semi")  # n rows
    return out.join(F.broadcast(top.withColumnRenamed("id", "dst_id")), "dst_id", "left_semi")


def styled_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"size": 15 + 10 * F.col("degree"), "colour": F.coalesce(F.element_at(map_literal(TYPE_COLOURS), F.col("type")), F.lit(TYPE_COLOURS["ENTITY"]))})


def styled_edges(edges: DataFrame) -> DataFrame:
    return edges.withColumn("value", F.col("confidence") * 10)
