"""Segmentation: sentences, overlapping token-bounded chunks, batches, prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import sentences, token_count, word_weight
from ..ontology import INSTRUCTIONS
from ..storage import materialize


def split_sentences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, pos, sentence), pos from 0."""
    return docs.select(F.col(id_col), F.posexplode(sentences(F.col(text_col))).alias("pos", "sentence"))


def sentence_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return split_sentences(docs, id_col, text_col).withColumn("n_tokens", token_count(F.col("sentence")))


def _bounds(max_tokens: int, overlap: float):
    """Arrow UDF: sentences' token counts to the chunks' first and past-the-last places, flat.

    A chunk closes when the next sentence would pass max_tokens; its trailing sentences are
    carried over while they fit the overlap.  One pass over numbers; no text comes to Python.
    """
    budget = int(max_tokens * overlap)

    def pack(counts: list[float]) -> list[int]:
        out, start, total = [], 0, 0
        for i, n in enumerate(counts):
            if i > start and total + n > max_tokens:
                out += [start, i]
                start, total = i, 0
                while start > out[-2] and total + counts[start - 1] <= budget:
                    start -= 1
                    total += counts[start]
                if overlap <= 0:
                    start, total = i, 0
            total += n
        return [*out, start, len(counts)] if len(counts) > start else out

    @F.pandas_udf("array<int>")
    def bounds(counts: pd.Series) -> pd.Series:
        return counts.map(lambda c: None if c is None else pack(c.tolist()))

    return bounds


def chunk(docs: DataFrame, max_tokens: int = 900, overlap: float = 0.2, id_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text", whole: bool = True) -> DataFrame:
    """(ids, chunk_no, text, n_tokens).  Narrow; a sentence longer than max_tokens is never
    cut; a text without sentences is one chunk, unchanged; null text gives none.

    Sentences are split and counted, and chunks joined, in the JVM; time is linear in the
    number of sentences.  whole: counts are cut to whole numbers, else they are fractions.
    """
    count = token_count if whole else word_weight
    packed = docs.where(F.col(text_col).isNotNull()).select(*id_cols, F.col(text_col).alias("whole"), sentences(F.col(text_col)).alias("s"))
    packed = packed.withColumn("n", F.transform("s", count)).withColumn("b", _bounds(max_tokens, overlap)(F.col("n")))
    zero = F.lit(0) if whole else F.lit(0.0)
    lo, size = (lambda i: F.get(F.col("b"), 2 * i)), (lambda i: F.get(F.col("b"), 2 * i + 1) - F.get(F.col("b"), 2 * i))
    part = lambda i: F.struct(F.array_join(F.slice("s", lo(i) + 1, size(i)), " ").alias("text"), F.aggregate(F.slice("n", lo(i) + 1, size(i)), zero, lambda a, n: a + n).alias("n_tokens"))
    chunks = F.transform(F.sequence(F.lit(0), (F.size("b") / 2).cast("int") - 1), part)
    alone = F.array(F.struct(F.col("whole").alias("text"), count(F.col("whole")).alias("n_tokens")))
    rows = packed.select(*id_cols, F.posexplode(F.when(F.size("b") > 0, chunks).otherwise(alone)).alias("chunk_no", "c"))
    return rows.select(*id_cols, "chunk_no", "c.text", "c.n_tokens")


def numbered(rows: DataFrame, order: list[str], name: str = "number") -> DataFrame:
    """rows with their number from 0 in an order of the whole table.

    A range sort deals the rows out evenly; tasks number their own, and only one count for
    each task comes back, to shift the numbers by.
    """
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    spread = materialize(spread, "numbered")
    part = F.shiftright("__at", 33)
    counts = spread.groupBy(part.alias("__part")).agg(F.count("*").alias("n")).orderBy("__part").collect()
    starts, done = [], 0
    for r in counts:  # one row for each task
        starts.append((r["__part"], done - (r["__part"] << 33)))
        done += r.n
    shifts = rows.sparkSession.createDataFrame(starts, "__part long, __shift long")
    met = spread.join(F.broadcast(shifts), part == F.col("__part"))
    return met.select(*rows.columns, (F.col("__at") + F.col("__shift")).alias(name))


def batches(chunks: DataFrame, size: int = 8, group: str | None = None) -> DataFrame:
    """Chunks ordered by (n_tokens, text) and numbered in batches, per group where one is named."""
    if group is None:
        return numbered(chunks, ["n_tokens", "text"], "batch").withColumn("batch", F.floor(F.col("batch") / size).cast("long"))
    order = Window.partitionBy(group).orderBy("n_tokens", "text")
    return chunks.withColumn("batch", F.floor((F.row_number().over(order) - 1) / size).cast("long"))


def prompt(chunk_text: Column, known: Column | None = None) -> Column:
    """Instructions, the chunk, and where more than five entities are known, the first twelve short ones."""
    base = F.concat(F.lit(INSTRUCTIONS + "\n\n"), chunk_text)
    if known is not None:
        short = F.slice(F.filter(known, lambda e: F.length(e) < 64), 1, 12)
        base = F.concat(base, F.when(F.size(known) > 5, F.concat(F.lit("\n\nKnown entities: "), F.array_join(short, ", "))).otherwise(F.lit("")))
    return F.concat(base, F.lit("\n\nJSON:"))
