"""Exact top-k inner products by a three-phase uniform threshold.

The dimensions are cut into blocks; a vector's local score in a block is its partial
inner product there.

1. Each task gathers, for every query and block, the list of its k best local scores,
   resolves those vectors, and reports its k best totals.  The k-th best of all reports
   is a total that k vectors reach: a safe cutoff.
2. The cutoff is broadcast.  A vector whose local scores are all below cutoff/blocks
   cannot reach it; the others are sufficient entries.  Blocks are scored one after
   another and only the entries are kept, as one bit each.
3. The entries' remaining scores are resolved exactly, from the whole numbers, and each
   task hands on its k best that reach the cutoff.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import appended, discard, materialize

#: Queries per broadcast (bounds its size), tile sides, dimension blocks, scale of a component.
QUERY_BLOCK, TILE_Q, TILE_V, BLOCKS, SCALE = 32_768, 512, 2048, 4, 1024
_LOW, _NO_ID = -(1 << 62), (1 << 63) - 1


def quantized(vec: str) -> Column:
    """Components as floor(SCALE * x), or null if any is null or not finite."""
    whole = F.transform(vec, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    fine = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.col(vec).isNotNull() & fine, whole)


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones padded with zeros."""
    lens = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy()
    if len(lens) and (lens == width).all():
        return flat.reshape(len(lens), width)
    out = np.zeros((len(lens), max(width, int(lens.max(initial=0)))), np.int64)
    out[np.repeat(np.arange(len(lens)), lens), np.concatenate([np.arange(n) for n in lens]) if len(lens) else []] = flat
    return out


def _exact_type(q: np.ndarray, v: np.ndarray):
    """A type in which every partial sum of every product is exact (Cauchy-Schwarz bound)."""
    norm = lambda x: float(np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max(initial=0)))
    bound = norm(q) * norm(v) * 1.01 * BLOCKS
    return np.float32 if bound < 2**24 else np.float64 if bound < 2**53 else np.int64 if bound < 2**62 else object


class _Best:
    """The k best (score, smaller id first) of every query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.score = np.full((queries, k), _LOW)
        self.ids = np.full((queries, k), _NO_ID)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Entries of several queries; row says whose each one is."""
        rows = np.unique(row)
        if not len(rows):
            return
        of = np.concatenate([np.repeat(rows, self.k), row])
        s, i = np.concatenate([self.score[rows].ravel(), score]), np.concatenate([self.ids[rows].ravel(), ids])
        order = np.lexsort((i, -s, of))
        of = of[order]
        nth = np.arange(len(of)) - np.searchsorted(of, of)
        kept = order[nth < self.k]  # k of each row at least, since it had so many before
        self.score[rows], self.ids[rows] = s[kept].reshape(-1, self.k), i[kept].reshape(-1, self.k)

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, score, id) of all entries, by row."""
        row, at = np.nonzero(self.ids != _NO_ID)
        return row, self.score[row, at], self.ids[row, at]


def _tiles(batches: Iterator[pa.RecordBatch], width: int):
    for b in batches:
        for at in range(0, b.num_rows, TILE_V):
            p = b.slice(at, TILE_V)
            lists = p.column(1)
            yield p.column(0).to_numpy(), _matrix(pa.ListArray.from_arrays(pa.array((lists.offsets.to_numpy() - lists.offsets[0].as_py()).astype(np.int32)), lists.flatten()), width)


def _local_scores(q: np.ndarray, v: np.ndarray) -> Iterator[np.ndarray]:
    """For one block of dimensions after another, (queries, vectors) partial inner products."""
    kind, width = _exact_type(q, v), min(q.shape[1], v.shape[1])  # shorter vectors count as padded with zeros
    cuts = np.linspace(0, width, BLOCKS + 1).astype(int)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield q[:, a:b].astype(kind) @ v[:, a:b].astype(kind).T


def _resolved(q: np.ndarray, v: np.ndarray, r: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (q[r], v[j])."""
    width, step = min(q.shape[1], v.shape[1]), 1 << 16
    parts = [np.einsum("ij,ij->i", q[r[at : at + step], :width], v[j[at : at + step], :width]) for at in range(0, len(r), step)]
    return np.concatenate(parts) if parts else np.zeros(0, np.int64)


def _gather(batches, qid: np.ndarray, q: np.ndarray, k: int) -> _Best:
    best = _Best(len(qid), k)
    for ids, v in _tiles(batches, q.shape[1]):
        n = min(k, len(ids))
        for at in range(0, len(qid), TILE_Q):
            part, own = q[at : at + TILE_Q], qid[at : at + TILE_Q, None] == ids[None, :]
            listed = np.zeros(own.shape, bool)
            for local in _local_scores(part, v):
                # which entries a list holds is free, their totals are exact
                local = np.where(own, -np.inf, local.astype(np.float64, copy=False))
                np.put_along_axis(listed, np.argpartition(local, len(ids) - n, axis=1)[:, len(ids) - n :], True, axis=1)
            r, j = np.nonzero(listed & ~own)
            best.add(at + r, _resolved(part, v, r, j), ids[j])
    return best


def _resolve(batches, qid: np.ndarray, q: np.ndarray, cut: np.ndarray, k: int) -> _Best:
    best = _Best(len(qid), k)
    for ids, v in _tiles(batches, q.shape[1]):
        for at in range(0, len(qid), TILE_Q):
            part, c = q[at : at + TILE_Q], cut[at : at + TILE_Q, None]
            enough = np.zeros((len(part), len(ids)), bool)
            for local in _local_scores(part, v):
                enough |= local * BLOCKS >= c
            r, j = np.nonzero(enough & (qid[at : at + TILE_Q, None] != ids[None, :]))
            total = _resolved(part, v, r, j)
            keep = total >= cut[at + r]
            best.add(at + r[keep], total[keep], ids[j[keep]])
    return best


def topk(vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), id, score: each query's k best other vectors, exactly.

    Queries go in blocks of QUERY_BLOCK, the most that is broadcast; each block meets all
    vectors in two narrow passes, and its result is written before the next.  What tasks
    hand on is k rows per query and task.

    Edge cases: null vectors and vectors with null or non-finite components take no
    part; ties go to the smaller id; fewer than k candidates give fewer rows; shorter
    vectors count as padded with zeros; rows that repeat an id are candidates each,
    never for the query of that id; a repeated query id counts once; an empty table
    or no query gives an empty result.
    """
    spark = vectors.sparkSession
    src = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), is_query.alias("asks"))
    src = materialize(src.select("id", "asks", quantized("vec").alias("v")).where(F.col("v").isNotNull()), "vectors")
    queries = src.where("asks").groupBy("id").agg(F.min("v").alias("v"))
    rows = src.select("id", "v")
    total = src.where("asks").select("id").distinct().count()
    blocks = max(1, -(-total // QUERY_BLOCK))
    parts = []
    for block in range(blocks):
        held = queries.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).toPandas()
        if not len(held):
            continue
        lens = [len(v) for v in held.v]
        q = np.zeros((len(held), max(lens)), np.int64)
        for i, v in enumerate(held.v):
            q[i, : len(v)] = v
        qid = held.id.to_numpy()
        shared = spark.sparkContext.broadcast((qid, q))

        def gather(batches, shared=shared):
            row, score, _ = _gather(batches, *shared.value, k).lists()
            if len(row):
                kept, n = np.unique(row, return_counts=True)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.array(score))
                yield pa.RecordBatch.from_arrays([pa.array(kept.astype(np.int32)), lists], names=["q", "s"])

        merged = F.slice(F.sort_array(F.flatten(F.collect_list("s")), asc=False), 1, k).alias("s")
        reports = rows.mapInArrow(gather, "q int, s array<long>").withColumn("salt", F.spark_partition_id() % 64)
        kth = reports.groupBy("q", "salt").agg(merged).groupBy("q").agg(merged).select("q", F.when(F.size("s") >= k, F.element_at("s", k)).alias("cut"))
        cut = np.full(len(qid), _LOW)
        for row in kth.collect():  # one number for each query of the block
            if row.cut is not None:
                cut[row.q] = row.cut
        cutoff = spark.sparkContext.broadcast(cut)

        def resolve(batches, shared=shared, cutoff=cutoff):
            ids, m = shared.value
            row, score, vec = _resolve(batches, ids, m, cutoff.value, k).lists()
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(vec), pa.array(score)], names=["query_id", "vec_id", "score"])

        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = rows.mapInArrow(resolve, "query_id long, vec_id long, score long")
        found = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
        parts.append(materialize(found, "topk", shared, cutoff))
    discard(src)
    if not parts:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    return appended(parts, "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", id_col)
