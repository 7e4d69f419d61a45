"""URL rules: a blocked Bloom filter passes possible hits to an exact hash join.

Everything is DataFrame expressions; no Python runs on executors.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bloom, bloom_block, bloom_mask

#: Bits of filter per rule, and the largest number of 64-bit blocks (2 MB broadcast
#: with keys).  A longer list fills the blocks more; the exact join keeps results right.
BITS_PER_RULE = 16
MAX_BLOCKS = 1 << 17

#: Rules of the registered query: (rule, verdict).
RULES = (
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def url_host(url: str) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def url_path(url: str) -> Column:
    return F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "rule string, verdict string")


def _key(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("\n"), path)


def url_filter(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule, verdict.

    A rule "host/path" fits its host and every subdomain when the url's path
    starts with the rule's path (which begins with the slash).  The longest
    fitting rule wins, the one with the longer host on equal length, then the
    verdict "block".  A url that no listed rule fits gets ``default`` and a null rule.

    Candidate keys are all host suffixes combined with path prefixes of the lengths
    that occur in the list.  They meet the filter's blocks in a broadcast join (at
    most MAX_BLOCKS rows, proven), and what passes meets the list in an exact
    equi-join that Spark is free to broadcast or shuffle.  No false negatives exist,
    and the exact join removes the false positives.

    Edge cases: null urls and urls without "://" have empty host and path and fit
    no rule; hosts are lower-cased A-Z only; repeated pages stay repeated rows;
    an empty list gives every page the default; rules that repeat count once.
    """
    parts = rules.select(
        "rule", "verdict",
        ascii_lower(F.substring_index("rule", "/", 1)).alias("rh"),
        F.expr("substring(rule, length(substring_index(rule, '/', 1)) + 1)").alias("rp"),
    )
    parts = parts.withColumn("rk", _key(F.col("rh"), F.col("rp")))
    # one row per distinct key; on a contradiction "block" outranks
    listed = parts.groupBy("rk").agg(F.max(F.struct(F.length("rule").alias("len"), F.length("rh").alias("hl"), (F.col("verdict") == "block").alias("b"), "rule", "verdict")).alias("r"))
    stats = parts.agg(F.count("*"), F.collect_set(F.length("rp"))).first()
    blocks, lengths = 1, sorted(stats[1])
    while blocks * 64 < stats[0] * BITS_PER_RULE and blocks < MAX_BLOCKS:
        blocks *= 2
    bits = bloom(listed, F.col("rk"), blocks)

    base = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), url_host(url_col).alias("host"), url_path(url_col).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    sizes = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.length("path"))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(sizes, lambda n: _key(h, F.expr("path").substr(F.lit(1), n)))))
    tried = base.where(F.col("host") != "").select("host", "path", F.explode(keys).alias("key"))
    tried = tried.withColumn("block", bloom_block(F.col("key"), blocks))
    possible = (
        tried.join(F.broadcast(bits), "block")
        .where(F.col("word").bitwiseAND(bloom_mask(F.col("key"))) == bloom_mask(F.col("key")))
        .select("host", "path", "key")
    )
    hits = possible.join(listed, F.col("key") == F.col("rk")).groupBy("host", "path").agg(F.max("r").alias("r"))
    # joined by one hash column, so that adaptive execution may split a hot url
    hits = hits.select(F.xxhash64("host", "path").alias("u"), F.col("host").alias("h2"), F.col("path").alias("p2"), "r")
    out = base.withColumn("u0", F.xxhash64("host", "path")).join(
        hits, (F.col("u0") == F.col("u")) & (F.col("host") == F.col("h2")) & (F.col("path") == F.col("p2")), "left"
    )
    return out.select(
        F.col("id").alias(id_col), "host", "path", F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.lit(default)).alias("verdict"),
    )
