"""Triples and completions derived from the star-schema tables; inputs of the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.triples import NAMES, aggregate, confident, with_ids
from ..operators.validate import accepted, rule_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _rows(df: DataFrame, subject, subject_type, predicate, target, target_type, confidence, seq) -> DataFrame:
    cols = zip(NAMES, (subject, subject_type, predicate, target, target_type), strict=True)
    text = lambda v: F.lit(v[1:]) if isinstance(v, str) and v[0] == "=" else F.col(v) if isinstance(v, str) else v
    return df.select(*[text(v).alias(c) for c, v in cols], confidence.cast("double").alias("confidence"), seq.cast("long").alias("seq"))


def star_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names, types, predicate, confidence, seq: legal triples and some that each rule must drop."""
    t = lambda n: table(spark, sf_dir, n)
    nation, region, cust, supp, part = t("nation"), t("region"), t("customer"), t("supplier"), t("part")
    c, s, p = F.col("c_custkey"), F.col("s_suppkey"), F.col("p_partkey")
    at_nation = lambda df, key: df.join(F.broadcast(nation), F.col(key) == F.col("n_nationkey"))  # noqa: E731  25 rows
    order = F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"))
    big = lambda k: F.lit(k * 10**12)
    parts = [
        _rows(at_nation(cust, "c_nationkey"), "c_name", "=ORGANIZATION", "=located_in", "n_name", "=LOCATION", (50 + c % 50) / 100, big(1) + c),
        _rows(at_nation(supp, "s_nationkey"), "s_name", "=ORGANIZATION", "=located_in", "n_name", "=LOCATION", (30 + s % 70) / 100, big(2) + s),
        _rows(nation.join(F.broadcast(region), F.col("n_regionkey") == F.col("r_regionkey")), "n_name", "=LOCATION", "=part_of", "r_name", "=LOCATION", F.lit(0.9), big(3) + F.col("n_nationkey")),
        _rows(t("lineitem").join(part, F.col("l_partkey") == p), order, "=DOCUMENT", "=contains", "p_name", "=PRODUCT", (35 + 5 * F.col("l_linenumber")) / 100, big(4) + F.col("l_orderkey") * 10 + F.col("l_linenumber")),
        _rows(at_nation(cust.where(c % 10 == 0), "c_nationkey"), "n_name", "=LOCATION", "=requires", "c_name", "=PERSON", F.lit(0.8), big(5) + c),
        _rows(part.where(p % 20 == 0), "p_name", "=PRODUCT", "=regulates", "p_brand", "=CONCEPT", F.lit(0.8), big(6) + p),
        _rows(supp.where(s % 7 == 0), "s_name", "=ORGANIZATION", "=affiliated_with", "=x", "=ORGANIZATION", F.lit(0.8), big(7) + s),
        _rows(region, "r_name", "=LOCATION", "=related_to", F.lower("r_name"), "=LOCATION", F.lit(0.8), big(8) + F.col("r_regionkey")),
        _rows(supp.where(s % 9 == 0), "s_name", "=ENTITY", "=related_to", "=the market", "=CONCEPT", F.lit(0.8), big(9) + s),
        _rows(supp.where(s % 5 == 0), F.concat(F.lit("The "), F.col("s_name"), F.lit(".")), "=PERSON", "=related_to", "=the market", "=CONCEPT", F.lit(0.7), big(10) + s),
    ]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def star_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confident(aggregate(with_ids(accepted(rule_filter(star_triples(spark, sf_dir))))), 0.4)


GOOD = '{"subject":"Acme %d","subject_type":"ORGANIZATION","predicate":"develops","target":"Widget","target_type":"PRODUCT"}'
OTHER = '{"subject":"Widget","subject_type":"PRODUCT","predicate":"part_of","target":"Machine","target_type":"PRODUCT"}'

#: Completions by number, which is the customer key modulo 8; %d stands for the key.
COMPLETIONS = (
    "not json",
    '{"foo":1}',
    '{"triples":null}',
    '{"triples":[' + OTHER.replace('"Widget"', "5", 1) + "]}",
    '{"triples":[' + GOOD + "," + OTHER.replace("part_of", "works_at") + "]}",
    "[" + GOOD + "," + OTHER + "]",
    '{"triples":[' + OTHER.replace('"Widget"', '"   "', 1) + "," + GOOD.replace("Widget", "x") + "]}",
    '{"triples":[' + GOOD[:-1] + ',"note":"extra"}]}',
)


def completion_of(which, key):
    """The completion of a number; %d stands for the key."""
    text = F.lit(COMPLETIONS[0])
    for i, c in enumerate(COMPLETIONS[1:], 1):
        text = F.when(which == i, F.replace(F.lit(c), F.lit("%d"), key.cast("string"))).otherwise(text)
    return text


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chunk_id, completion)."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(key.cast("long").alias("chunk_id"), completion_of(key % 8, key).alias("completion"))
