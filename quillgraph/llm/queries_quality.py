"""op3: quality score of documents, learned from two thirds of the labelled rows."""

from . import quality
from .common import crc_bucket, table


def fitted_on(docs, labels):
    return quality.fit(docs, labels.where(crc_bucket("doc_id", 3) != 1))


def op3_quality(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    got = quality.score(docs, fitted_on(docs, table(spark, sf_dir, "labels")))
    return got.select("doc_id", (crc_bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": op3_quality}
ORACLE: dict[str, str] = {}  # no SQL: tests measure held-out accuracy
