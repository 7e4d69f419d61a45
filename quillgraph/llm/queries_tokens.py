"""op1: SentencePiece ids and decoded text of documents, as digests."""

from pyspark.sql import functions as F

from .common import table
from .sentencepiece_bpe import encode_decode


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digests(coded):
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_sentencepiece(spark, sf_dir):
    return digests(encode_decode(table(spark, sf_dir, "documents"), model_path()))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLE: dict[str, str] = {}  # no SQL: tests compare with the library
