"""Quality classifier: supervised subword embeddings.

Every word and its character n-grams hash to learned vectors; a document is their
average, a softmax layer scores it.  Trained by plain stochastic gradient descent in
numpy, in one task over a bounded sample.  Because the output is linear in the average, each bucket's contribution to
the logit is tabulated once, and scoring a text is gathers and a sum.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction_filter, freeing, small_batches

#: Hash buckets, vector size, character n-grams, passes, first learning rate, and the
#: documented bound on the labelled documents that the classifier is fitted on.
BUCKETS, DIM, NGRAMS, EPOCHS, RATE, MAX_LABELLED = 1 << 16, 8, (3, 4), 6, 0.5, 4000
STEP_TEXTS = 64
_BIAS, _REPEAT = 0, 1  # reserved buckets: every document's, and a word equal to the one before it
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def features(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """Bucket of every feature occurrence of the whole text."""
    b = np.frombuffer(b" " + (text or "").encode() + b" ", np.uint8)
    space = _SPACE[b]
    start = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    if not len(start):
        return np.array([_BIAS], np.int64)
    end = np.flatnonzero(~space[:-1] & space[1:]) + 1
    shift = np.uint64(64 - int(buckets).bit_length() + 1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    c = b.astype(np.uint64)
    c[space] = 1  # one mark for every kind of white space, at both ends of a word
    # word hash: positions inside the word weigh the bytes, so order counts
    inside = np.flatnonzero(~space)
    length = end - start
    pos = np.arange(len(inside)) - np.repeat(np.cumsum(length) - length, length)
    term = (c[inside] + np.uint64(7)) * (pos.astype(np.uint64) * np.uint64(2) + np.uint64(3)) * mix
    term ^= term >> np.uint64(29)
    word = np.add.reduceat(term * (pos.astype(np.uint64) + np.uint64(0x100000001B3)), np.cumsum(length) - length)
    out = [np.array([_BIAS], np.int64), ((word * mix) >> shift).astype(np.int64)]
    same = int((word[1:] == word[:-1]).sum())
    if same:
        out.append(np.full(same, _REPEAT, np.int64))
    h = c[:]
    for n in range(2, max(NGRAMS) + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * np.uint64(1_000_003) + c[n - 1 :]
        if n in NGRAMS:
            # inside a word with its end marks: no white space strictly within the n-gram
            ok = np.ones(len(h), bool)
            for k in range(1, n - 1):
                ok &= ~space[k : k + len(h)]
            out.append((((h[ok] + np.uint64(n)) * mix) >> shift).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Classifier:
    table: np.ndarray  # each bucket's part of the logit

    def score(self, text: str | None) -> float:
        z = float(self.table[features(text, len(self.table))].mean())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(docs: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Classifier:
    """docs: distinct buckets, their counts, label 0 or 1.  One class or none: a constant score."""
    labels = {d[2] for d in docs}
    if len(labels) < 2:
        level = 0.0 if not labels else 4.0 if 1 in labels else -4.0
        return Classifier(np.full(BUCKETS, level, np.float32))
    rng = np.random.default_rng(seed)
    vec = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out = np.zeros((2, DIM), np.float32)
    steps, done = EPOCHS * len(docs), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(docs)):
            idx, cnt, label = docs[i]
            rate = RATE * (1 - done / steps)
            done += 1
            share = (cnt / cnt.sum()).astype(np.float32)
            mean = share @ vec[idx]
            z = out @ mean
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            # buckets weigh by their share; scaled so that a long text still moves its vectors
            grad = (p @ out) * rate
            out -= rate * np.outer(p, mean)
            vec[idx] -= np.outer(share * min(len(idx), 200), grad)
    return Classifier((vec @ (out[1] - out[0])).astype(np.float32))


def _trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, y, idx, cnt) rows of one partition, in order of id, to one row with the table's bytes."""
    rows = []
    for b in batches:
        idx, cnt = b.column(2), b.column(3)
        ends, flat, n = idx.offsets.to_numpy() - idx.offsets[0].as_py(), idx.flatten().to_numpy(), cnt.flatten().to_numpy()
        for i, (key, y) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
            rows.append((key, flat[ends[i] : ends[i + 1]].copy(), n[ends[i] : ends[i + 1]].copy(), y))
    # repeated ids are settled by their features, so that the order of arrival cannot count
    rows.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    table = train([r[1:] for r in rows]).table
    yield pa.RecordBatch.from_arrays([pa.array([table.tobytes()], pa.binary())], names=["table"])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", limit: int = MAX_LABELLED) -> Classifier:
    """Fit on at most about ``limit`` labelled documents, picked by a hash of the id.

    The picked ids (bounded by limit) are broadcast against documents, so no long text is
    shuffled; hashed features of the picked documents meet in one task, which trains, and
    only the table of BUCKETS floats reaches the driver.

    Edge cases: labels other than 0 and 1 are not learned from; an id labelled both ways
    counts as 1; a labelled id without a document, and null labels, count for nothing;
    null and empty texts teach what a text without words is; rows that repeat an id are
    learned from each; without labels, or with one class only, every score is the same.
    """
    small_batches(docs.sparkSession)
    known = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("y")).where("y IN (0, 1) AND lid IS NOT NULL")
    total = known.count()
    if not total:
        return train([])
    picked = known.where(fraction_filter(min(1.0, limit / total), "lid")).groupBy("lid").agg(F.max("y").alias("y"))
    schema = "id string, y int, idx array<int>, cnt array<int>"

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP_TEXTS):
                p = b.slice(at, STEP_TEXTS)
                pairs = [np.unique(features(t), return_counts=True) for t in p.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([p.column(0), p.column(1), pa.array([x.astype(np.int32) for x, _ in pairs], pa.list_(pa.int32())), pa.array([n.astype(np.int32) for _, n in pairs], pa.list_(pa.int32()))], names=["id", "y", "idx", "cnt"])

    texts = docs.select(F.col(id_col).alias("lid"), F.col(text_col).alias("t")).join(F.broadcast(picked), "lid")
    rows = texts.select(F.col("lid").cast("string").alias("id"), "y", "t").mapInArrow(freeing(made), schema)
    fitted = rows.repartition(1).mapInArrow(freeing(_trained), "table binary").collect()
    return Classifier(np.frombuffer(bytes(fitted[0].table), np.float32)) if fitted else train([])


def score(df: DataFrame, fitted: Classifier, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """One row per input row: id (or the columns in ``keep``), score, predicted (1 if score >= 0.5).

    A narrow map over Arrow batches; the broadcast table has BUCKETS floats.  ``names`` are
    those of the two new columns; they must not be among the kept ones.

    Edge cases: null and empty texts and texts of white space only get the score of
    a document without words; repeated rows stay; an empty table gives an empty result;
    columns not named are ignored.
    """
    cols = keep if keep is not None else [id_col]
    if set(names) & set(cols):
        raise ValueError(f"kept columns are named like new ones: {sorted(set(names) & set(cols))}")
    small_batches(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    schema = T.StructType([*[df.schema[c] for c in cols], T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    fields = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, STEP_TEXTS):
                p = b.slice(at, STEP_TEXTS)
                s = np.array([m.score(t) for t in p.column(p.num_columns - 1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*p.columns[:-1], pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], names=fields)

    # inside, columns go by their place, so that no name can clash
    return df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)], F.col(f"`{text_col}`").alias("judged")).mapInArrow(freeing(run), schema)
