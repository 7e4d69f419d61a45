"""Training-corpus pipeline over documents: each stage calls one operator of quillgraph.llm.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next one's docs.  All but
the last return the columns of documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import quality
from quillgraph.llm.common import materialize, split_by_ids, table
from quillgraph.llm.exact_dedup import exact_dedup, normalized
from quillgraph.llm.mixing import mix
from quillgraph.llm.queries_mixing import language_labels
from quillgraph.llm.queries_quality import fitted_on
from quillgraph.llm.queries_tokens import model_path
from quillgraph.llm.sentencepiece_bpe import encode_decode
from quillgraph.llm.shingle_join import jaccard_components


def _same_columns(docs: DataFrame, df: DataFrame) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in docs.columns])


def _unused(docs: DataFrame, prefix: str, *names: str) -> str:
    """A prefix with which none of the names is a column of docs."""
    while any(f"{prefix}{n}" in docs.columns for n in names):
        prefix = f"_{prefix}"
    return prefix


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier does not reject (score >= 0.5).

    The classifier learns from labelled documents outside its held-out fold.

    Edge cases: null and empty texts get the score of a text without words; repeated rows
    share a verdict; an empty table gives an empty result, and labels without a document
    score every text 0.5, which keeps it; columns named like the classifier's stay as they are.
    """
    fitted = fitted_on(docs, table(spark, sf_dir, "labels"))
    prefix = _unused(docs, "quality_", "score", "predicted")
    scored = quality.score(docs, fitted, keep=docs.columns, names=(f"{prefix}score", f"{prefix}predicted"))
    return _same_columns(docs, scored.where(F.col(f"{prefix}predicted") == 1))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, white space aside, the row with the smallest doc_id stays.

    Only rows whose id a filter of the concerned ids lets through are hashed again and
    shuffled, to meet the dropped ones exactly; all others pass in a narrow scan.

    Edge cases: null equals empty; of rows that repeat id and text one stays; one id on two
    texts is two documents; an empty table gives an empty result; other columns are kept
    whatever their names.
    """
    found = materialize(exact_dedup(docs), "exact")
    key = [F.col("doc_id").alias("__qg_id"), F.col("text_sha256").alias("__qg_sha")]
    dropped = found.where(~F.col("kept")).select(*key, F.lit(False).alias("__qg_stays")).distinct()
    again = found.where("kept").groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select("__qg_id", "__qg_sha", F.lit(True).alias("__qg_stays"))
    concerned = materialize(dropped.unionByName(again), "concerned")
    clear, doubtful = split_by_ids(docs, concerned.select(F.col("__qg_id").alias("doc_id")), "doc_id")
    same = F.col("doc_id").eqNullSafe(F.col("__qg_id")) & (F.col("__qg_own") == F.col("__qg_sha"))
    met = doubtful.withColumn("__qg_own", F.sha2(normalized("text"), 256)).join(concerned, same, "left")
    parts = [clear, _same_columns(docs, met.where("__qg_stays IS NULL"))]
    if not concerned.where("__qg_stays").isEmpty():
        parts.append(_same_columns(docs, met.where("__qg_stays").dropDuplicates(["__qg_id", "__qg_sha"])))
    return reduce(DataFrame.unionByName, parts)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a shingle similarity of 0.75 or more the smallest doc_id stays.

    Edge cases: null and empty texts have no shingle and all stay; repeated rows of an id
    that stays all stay (exact dedup comes before); an empty table gives an empty result;
    other columns are kept whatever their names.
    """
    found = jaccard_components(docs).where(F.col("component_id") != F.col("doc_id"))
    dropped = materialize(found.select("doc_id").distinct(), "near")
    clear, doubtful = split_by_ids(docs, dropped, "doc_id")
    gone = dropped.select(F.col("doc_id").alias("__qg_id"))
    return clear.unionByName(doubtful.join(gone, F.col("doc_id") == F.col("__qg_id"), "left_anti"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its rate, so that languages meet tempered shares of tokens.

    Rates come from the documents' posteriors; at the default total none falls under
    one on average over its domain, and a document at a rate of 1.6 is written once
    or twice.

    Edge cases: a null or empty text has rate 1; without a known language every rate is 1;
    repeated rows get equal rates; an empty table gives an empty result; columns named
    like the mixer's stay as they are.
    """
    prefix = _unused(docs, "mix_", "tokens", "posterior", "rate", "copies", "copy")
    mixed = mix(docs, language_labels(docs), prefix=prefix)
    # an outer explode, filtered after it: a filter on the number of copies would be pushed
    # below the projections and evaluate the posteriors once more for each reference
    repeated = mixed.withColumn(f"{prefix}copy", F.explode_outer(F.array_repeat(F.lit(1), F.col(f"{prefix}copies").cast("int"))))
    return _same_columns(docs, repeated.where(F.col(f"{prefix}copy").isNotNull()))


def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece ids of every document: doc_id, n_tokens, ids, decoded_chars.

    Edge cases: null counts as empty and has the end id only; repeated rows stay; an empty
    table gives an empty result; other columns are left out.
    """
    coded = encode_decode(docs, model_path())
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.length("decoded").cast("long").alias("decoded_chars"))


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_dedup_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("tokens", tokens_stage),
]

#: Learned and iterative stages have no SQL form: the tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
