"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Characters of the normalised text that the second level hashes.
PREFIX_CHARS = 256


def normalized(text: str) -> Column:
    """Null becomes empty; every run of ASCII white space becomes one space."""
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", " ")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Level 1 keeps lengths that occur twice, level 2 the (length, prefix hash)
    pairs among them that occur twice, level 3 groups the survivors by SHA-256.
    Texts are scanned once: the scan writes the narrow row (id, length, prefix
    hash, digest), and all shuffles move such rows only, never a text.  The
    digest of every row is part of the result, so it is taken in that scan.

    Skew: every aggregate combines map-side.  The two joins use a key that is
    not the aggregate's own, so both inputs are exchanged for the join and
    adaptive execution can split a group that holds much of the table.

    Edge cases: null texts are equal to empty ones; an empty table gives an empty
    result; other columns are ignored, whatever their names.  Rows that repeat
    id and text count in group_size and are all reported kept, because nothing
    tells them apart.  A null id sorts after all others and keeps only if alone.
    """
    norm = normalized(text_col)
    rows = df.select(
        F.col(id_col).alias("id"),
        F.length(norm).alias("n"),
        F.xxhash64(F.substring(norm, 1, prefix_chars)).alias("p"),
        F.unhex(F.sha2(norm, 256)).alias("digest"),
    )
    rows = materialize(rows, "dedup")
    lengths = rows.groupBy("n").agg(F.count("*").alias("c")).where("c > 1").select(F.xxhash64("n").alias("kn"))
    pairs = (
        rows.withColumn("kn", F.xxhash64("n")).join(lengths, "kn", "left_semi")
        .groupBy("n", "p").agg(F.count("*").alias("c")).where("c > 1")
        .select(F.xxhash64("n", "p").alias("k"))
    )
    survivors = rows.withColumn("k", F.xxhash64("n", "p")).join(pairs, "k", "left_semi")
    # grouped by digest and length, joined by digest: see "Skew" above
    groups = (
        survivors.groupBy("n", "digest").agg(F.min("id").alias("keep"), F.count("*").alias("size")).where("size > 1")
        .select(F.col("digest").alias("d"), "keep", "size")
    )
    found = rows.select("id", "digest").join(groups, F.col("digest") == F.col("d"), "left")
    keep = F.coalesce("keep", "id")
    return found.select(
        F.col("id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        keep.eqNullSafe(F.col("id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
