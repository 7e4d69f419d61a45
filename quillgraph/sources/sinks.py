"""Sinks: tables as Parquet, CSV and JSON, checkpoints, a small HTML view, metric rows."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import export_edges, export_nodes, styled_edges, styled_nodes, top_edges


def write_graph(edges: DataFrame, path: str, ranks: DataFrame | None = None, groups: DataFrame | None = None) -> None:
    """nodes and edges under path, as Parquet and CSV; edges also as JSON."""
    for name, df in (("nodes", export_nodes(edges, ranks, groups)), ("edges", export_edges(edges))):
        df.write.mode("overwrite").parquet(f"{path}/{name}.parquet")
        df.write.mode("overwrite").option("header", True).csv(f"{path}/{name}.csv")
    export_edges(edges).write.mode("overwrite").json(f"{path}/edges.json")


#: Columns of a preference data set.
PREFERENCES = "prompt string, chosen string, rejected string, chosen_score double, rejected_score double"


def checkpoint(df: DataFrame, path: str) -> str:
    """df as the next numbered Parquet folder under path; returns the folder."""
    spark = df.sparkSession
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    taken = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    number = 1 + max((int(n.rsplit("-", 1)[1]) for n in taken if n.startswith("checkpoint-")), default=-1)
    target = f"{path}/checkpoint-{number:05d}"
    df.write.option("compression", "snappy").parquet(target)
    return target


def write_preferences(pairs: DataFrame, path: str) -> None:
    """Pairs as JSON lines."""
    pairs.write.mode("overwrite").json(path)


def metric_rows(df: DataFrame, prefix: str) -> DataFrame:
    """A one-row frame of numbers as (name, labels, value) rows."""
    cols = [F.struct(F.lit(f"{prefix}_{c}").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), F.col(c).cast("double").alias("value")) for c in df.columns]
    return df.select(F.explode(F.array(*cols)).alias("m")).select("m.*")


def html_view(edges: DataFrame, title: str = "graph", most_edges: int = 500) -> str:
    """A page with the best edges and their nodes on a circle, and a panel of statistics.

    Only most_edges rows are collected; they are what the page shows.
    """
    top = top_edges(edges, most_edges)
    rows = [r.asDict() for r in styled_edges(top).select("src_id", "dst_id", "subject", "target", "predicate", "confidence", "value").collect()]
    nodes = [r.asDict() for r in styled_nodes(export_nodes(top)).collect()]
    counts: dict[str, int] = {}
    for n in nodes:
        counts[n["type"]] = counts.get(n["type"], 0) + 1
    panel = "".join(f"<li>{html.escape(k)}: {v}</li>" for k, v in sorted(counts.items(), key=lambda x: (-x[1], x[0])))
    mean = sum(n["degree"] for n in nodes) / len(nodes) if nodes else 0
    data = json.dumps({"nodes": nodes, "edges": rows}, default=str).replace("</", "<\\/")
    script = (
        "const n=g.nodes,c=document.getElementById('c').getContext('2d'),p={};"
        "n.forEach((x,i)=>{const a=2*Math.PI*i/n.length;p[x.id]=[450+380*Math.cos(a),450+380*Math.sin(a)]});"
        "c.strokeStyle='#bbb';g.edges.forEach(e=>{const a=p[e.src_id],b=p[e.dst_id];if(a&&b){c.beginPath();c.moveTo(...a);c.lineTo(...b);c.stroke()}});"
        "n.forEach(x=>{c.fillStyle=x.colour;c.beginPath();c.arc(...p[x.id],Math.min(20,4+x.size/20),0,7);c.fill();c.fillStyle='#333';c.fillText(x.label,...p[x.id])});"
    )
    return (
        f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body>"
        f"<aside><p>{len(nodes)} nodes, {len(rows)} edges, mean degree {mean:.2f}, largest {max((n['degree'] for n in nodes), default=0)}</p><ul>{panel}</ul></aside>"
        f"<canvas id='c' width='900' height='900'></canvas><script>const g={data};{script}</script></body></html>"
    )
