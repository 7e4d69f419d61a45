"""op10: near-duplicate components of documents."""

from .common import table
from .shingle_join import jaccard_components


def op10_ngram_jaccard(spark, sf_dir):
    return jaccard_components(table(spark, sf_dir, "documents"))


QUERIES = {"op10_ngram_jaccard": op10_ngram_jaccard}
ORACLE: dict[str, str] = {}  # whole tables are too slow in SQL: tests compare with brute force
