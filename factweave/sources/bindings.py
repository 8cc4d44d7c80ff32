"""Concept graphs bound to the test tables: the same definitions as the queries' SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(kind: str, key: str) -> Column:
    return F.concat(F.lit(f"{kind}:"), F.col(key).cast("string"))


def geo_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer and supplier located_in nation, nation part_of region."""
    parts = []
    for name, kind, key, up, up_kind, relation in (("customer", "customer", "c_custkey", "c_nationkey", "nation", "located_in"), ("supplier", "supplier", "s_suppkey", "s_nationkey", "nation", "located_in"), ("nation", "nation", "n_nationkey", "n_regionkey", "region", "part_of")):
        parts.append(table(spark, sf_dir, name).select(_id(kind, key).alias("source"), F.lit(relation).alias("relation"), _id(up_kind, up).alias("target")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def trade_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(a, b, weight): order lines between the nations of customer and supplier, without direction. Lines are counted for each order and supplier's nation before orders join."""
    nation_of = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("t"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").join(nation_of, "l_suppkey").groupBy(F.col("l_orderkey").alias("o_orderkey"), "t").agg(F.count("*").alias("n"))
    buyers = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("s")), "c_custkey")
    pairs = lines.join(buyers, "o_orderkey").filter("s <> t")
    return pairs.groupBy(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).agg(F.sum("n").cast("double").alias("weight"))


def status_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user last_event event_type, from one event of the user to the next."""
    after = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(_id("user", "user_id").alias("source"), F.lit("last_event").alias("relation"), F.col("event_type").alias("target"), F.col("ts").alias("valid_from"), F.lead("ts").over(after).alias("valid_to"), F.concat(F.lit("e-"), F.col("event_id").cast("string")).alias("id"))


def claim_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents support or contradict the claim that their source is good."""
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("src")), "doc_id").select(
        _id("doc", "doc_id").alias("source"), F.when(F.col("quality") == 1, "supports").otherwise("contradicts").alias("relation"),
        F.concat(F.lit("source "), F.col("src"), F.lit(" is good")).alias("target"), F.when(F.col("toxic") == 1, 0.5).otherwise(0.9).alias("confidence"), F.concat(F.lit("e-"), F.col("doc_id").cast("string")).alias("id"))
