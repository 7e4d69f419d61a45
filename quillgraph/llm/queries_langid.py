"""op2: language of documents, learned from four fifths of the labelled rows."""

from pyspark.sql import functions as F

from . import langid
from .common import crc_bucket, table


def op2_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    fold = crc_bucket("doc_id", 5)
    fitted = langid.fit(docs.where(fold != 0).where(F.col("lang").isNotNull() & F.col("text").isNotNull()))
    got = langid.identify(docs, fitted)
    return got.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score", "rejected")


QUERIES = {"op2_language_id": op2_language_id}
ORACLE: dict[str, str] = {}  # no SQL: tests measure held-out accuracy
