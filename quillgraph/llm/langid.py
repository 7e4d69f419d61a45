"""Language identification by nearest centroid.

Texts become hashed character n-gram counts, TF-IDF weighted and normalised.  Each
language has several spherical k-means centroids; the most similar centroid by
cosine decides, and a similarity under the learned floor marks a rejection.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fraction_filter

#: Hash buckets, n-gram lengths, centroids per language, and the documented bound on
#: the labelled rows per language that the classifier is fitted on.
BUCKETS, NGRAMS, CENTROIDS, MAX_PER_LANGUAGE = 4096, (1, 2, 3), 4, 400
STEP_TEXTS = 64
UNKNOWN = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """True for the letters of the basic plane; made once per worker."""
    if not _LETTER:
        _LETTER.append(np.array([chr(c).isalpha() for c in range(0x10000)]))
    return _LETTER[0]


def counts(text: str | None, buckets: int = BUCKETS) -> tuple[np.ndarray, bool]:
    """Hashed n-gram counts of the whole text (letters lower-cased, all else a space), and if it has a letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
    table = _letters()
    letter = table[np.minimum(codes, 0xFFFF)]
    high = np.flatnonzero(codes > 0xFFFF)
    if len(high):
        letter = letter.copy()
        letter[high] = [chr(c).isalpha() for c in codes[high].tolist()]
    c = np.where(letter, codes, np.uint32(32))
    c = c[~((c == 32) & np.concatenate([[False], c[:-1] == 32]))] if len(c) else c
    out = np.zeros(buckets, np.int64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(NGRAMS) + 1):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) + c[n - 1 :] + np.uint32(n)
        if n in NGRAMS:
            out += np.bincount((h * np.uint32(2654435761)) >> shift, minlength=buckets)
    return out, bool(letter.any())


def weigh(matrix: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Normalised TF-IDF rows."""
    x = np.log1p(matrix.astype(np.float32)) * idf
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Centroids:
    languages: list[str]  # of each centroid
    vectors: np.ndarray
    idf: np.ndarray
    floor: float  # similarity under which a text is rejected

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        rows = [counts(t, len(self.idf)) for t in texts]
        if not self.languages:
            return [(UNKNOWN, 0.0, True) for _ in rows]
        x = weigh(np.stack([r[0] for r in rows]), self.idf)
        sim = x @ self.vectors.T
        best = sim.argmax(axis=1)
        out = []
        for i, (_, has_letter) in enumerate(rows):
            s = float(min(1.0, max(0.0, sim[i, best[i]])))
            out.append((self.languages[best[i]], s, s < self.floor) if has_letter else (UNKNOWN, 0.0, True))
        return out


def kmeans(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means with farthest-first seeds; repeatable."""
    seeds = [int((x @ x.mean(axis=0)).argmax())]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(near.argmin()))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == j].mean(axis=0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = MAX_PER_LANGUAGE) -> Centroids:
    """Fit on at most ``per_language`` labelled rows of each language, picked by a hash of the id.

    Only those rows' count vectors reach the driver.  Rows with null text, null
    language or no letter are not learned from; no labelled row gives an empty model.
    """
    known = labelled.where(F.col(lang_col).isNotNull())
    totals = {r[0]: r[1] for r in known.groupBy(lang_col).count().collect()}
    if not totals:
        return Centroids([], np.zeros((0, BUCKETS), np.float32), np.ones(BUCKETS, np.float32), 0.0)
    wanted = F.lit(False)
    for lang, n in sorted(totals.items()):
        wanted = wanted | ((F.col(lang_col) == lang) & fraction_filter(min(1.0, 1.1 * per_language / n), id_col))
    schema = "lang string, id string, idx array<int>, cnt array<int>"

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, STEP_TEXTS):
                p = b.slice(at, STEP_TEXTS)
                made = [counts(t) for t in p.column(2).to_pylist()]
                keep = [i for i, m in enumerate(made) if m[1]]
                idx = [np.flatnonzero(made[i][0]) for i in keep]
                yield pa.RecordBatch.from_arrays(
                    [p.column(0).take(pa.array(keep, pa.int64())), p.column(1).take(pa.array(keep, pa.int64())), pa.array([i.astype(np.int32) for i in idx], pa.list_(pa.int32())), pa.array([made[k][0][i].astype(np.int32) for k, i in zip(keep, idx, strict=True)], pa.list_(pa.int32()))],
                    names=["lang", "id", "idx", "cnt"],
                )

    rows = known.where(wanted).select(F.col(lang_col).alias("lang"), F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t")).mapInArrow(vectors, schema).toPandas()
    rows = rows.sort_values(["lang", "id"], kind="stable").groupby("lang").head(per_language)
    matrix = np.zeros((len(rows), BUCKETS), np.float32)
    for i, (idx, cnt) in enumerate(zip(rows.idx, rows.cnt, strict=True)):
        matrix[i, idx] = cnt
    idf = np.log((1 + len(rows)) / (1 + (matrix > 0).sum(axis=0))).astype(np.float32) + 1
    x = weigh(matrix, idf)
    langs, cents = [], []
    for lang in sorted(set(rows.lang)):
        c = kmeans(x[(rows.lang == lang).to_numpy()], CENTROIDS)
        langs += [lang] * len(c)
        cents.append(c)
    if not cents:
        return Centroids([], np.zeros((0, BUCKETS), np.float32), idf, 0.0)
    v = np.concatenate(cents).astype(np.float32)
    floor = float(np.quantile((x @ v.T).max(axis=1), 0.005)) * 0.5
    return Centroids(langs, v, idf, floor)


def identify(df: DataFrame, fitted: Centroids, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, lang_pred, score (cosine, 0 to 1), rejected.

    A narrow map over Arrow batches.  The broadcast model holds languages x
    CENTROIDS x BUCKETS floats, whatever the size of the table.

    Edge cases: null texts and texts without a letter give "und", 0 and rejected; a
    text under the similarity floor keeps the nearest language and is marked
    rejected; ties go to the alphabetically first language; repeated rows stay.
    """
    shared = df.sparkSession.sparkContext.broadcast(fitted)
    schema = T.StructType([df.schema[id_col], *T._parse_datatype_string("lang_pred string, score double, rejected boolean").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            for at in range(0, b.num_rows, STEP_TEXTS):
                p = b.slice(at, STEP_TEXTS)
                got = m.predict(p.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[2] for g in got], pa.bool_())], names=[id_col, "lang_pred", "score", "rejected"])

    return df.select(F.col(id_col), F.col(text_col).alias("__text")).mapInArrow(run, schema)
