"""Graphs: small examples with known answers, and graphs derived from a star schema.

An edge table has ``src long, dst long, w double``; a missing row is a missing edge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..tables import settle

EDGES = "src long, dst long, w double"
#: The 7-vertex digraph of Tarjan (1983): fixed values.
TARJAN = [(1, 2, 10), (2, 1, 12), (2, 3, 30), (4, 3, 6), (4, 5, 16), (5, 4, 13), (5, 6, 8), (6, 1, 26), (1, 7, 15), (7, 2, 35), (3, 7, 45), (7, 3, 22), (4, 7, 14), (7, 5, 50), (6, 7, 20)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def edges(spark: SparkSession, rows) -> DataFrame:
    return spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in rows], EDGES)


def tarjan_graph(spark: SparkSession) -> DataFrame:
    return edges(spark, TARJAN)


def example_graph(spark: SparkSession) -> DataFrame:
    """25 vertices, both directions: a clique on 1-8, a ring on 9-16 with links to the next two, a cycle on 17-24, and a hub 25 on 1, 9 and 17."""
    v = spark.range(1, 9)
    clique = v.alias("a").join(v.alias("b"), F.col("a.id") < F.col("b.id")).select(F.col("a.id").alias("src"), F.col("b.id").alias("dst"))
    step = lambda first, k: v.select((F.col("id") + first - 1).alias("src"), (F.pmod(F.col("id") - 1 + k, F.lit(8)) + first).alias("dst"))
    hub = spark.createDataFrame([(25, 1), (25, 9), (25, 17)], "src long, dst long")
    half = clique.union(step(9, 1)).union(step(9, 2)).union(step(17, 1)).union(hub)
    return half.union(half.select("dst", "src")).select("src", "dst", F.lit(1.0).alias("w"))


def nation_trade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue from supplier nation to customer nation."""
    read = lambda name: table(spark, sf_dir, name)
    joined = read("lineitem").join(read("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).join(read("supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    sums = joined.where("s_nationkey <> c_nationkey").groupBy(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))
    return settle(sums.agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("w")))


def event_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src_label, dst_label, w: how often one event type follows another of the same user."""
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    seen = table(spark, sf_dir, "events").select(F.col("event_type").alias("src_label"), after.alias("dst_label")).where("dst_label is not null")
    return seen.groupBy("src_label", "dst_label").agg(F.count("*").cast("double").alias("w"))


def supplier_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantity by supplier and part: a sparse graph that grows with the data."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")).agg(F.sum("l_quantity").cast("double").alias("w"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vertex, region, weight (order value of the nation's customers)."""
    read = lambda name: table(spark, sf_dir, name)
    value = read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(F.round(F.sum("o_totalprice"), 2).alias("weight"))
    out = read("nation").join(value, F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return settle(out.select(F.col("n_nationkey").cast("long").alias("vertex"), F.col("n_regionkey").cast("int").alias("region"), F.coalesce("weight", F.lit(0.0)).alias("weight")))
