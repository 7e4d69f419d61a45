"""op6: rates that mix the languages of documents to tempered shares of tokens."""

from pyspark.sql import functions as F

from .common import table
from .mixing import mix


def language_labels(docs):
    """The labelled table: documents whose language is known."""
    return docs.where(F.col("lang").isNotNull()).select("doc_id", F.col("lang").alias("domain"))


def op6_mixing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = mix(docs.select("doc_id", "text"), language_labels(docs))
    return got.select("doc_id", F.col("mix_tokens").alias("n_tokens"), F.transform("mix_posterior", lambda p: F.round(p, 6)).alias("posterior"), F.col("mix_rate").alias("rate"), F.col("mix_copies").alias("copies"))


QUERIES = {"op6_mixing": op6_mixing}
ORACLE: dict[str, str] = {}  # iterative: tests compare with a plain numpy version
