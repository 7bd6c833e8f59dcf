"""The driver's tables as documents, vectors and a property graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph

REGION, NATION, CUSTOMER, ORDER, SUPPLIER, PART = (n * 10**12 for n in range(1, 7))
PLACED, IN_NATION, IN_REGION, LOCATED, CONTAINS = (n * 10**13 for n in range(1, 6))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ts as microseconds since the epoch."""
    return read(spark, sf_dir, "events").withColumn("ts", F.unix_micros(F.col("ts").cast("timestamp")))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, labels, key, name, balance, segment): customers, orders, suppliers, parts, nations and regions."""
    table = lambda n: read(spark, sf_dir, n)

    def rows(source, label, base, key, **columns):
        value = {"name": F.lit(None).cast("string"), "balance": F.lit(None).cast("double"), "segment": F.lit(None).cast("string")} | {k: F.col(v) for k, v in columns.items()}
        k = F.col(key).cast("long")
        return table(source).select((k + base).alias("id"), F.array(F.lit(label)).alias("labels"), k.alias("key"), *(v.alias(n) for n, v in value.items()))

    parts = [
        rows("region", "Region", REGION, "r_regionkey", name="r_name"),
        rows("nation", "Nation", NATION, "n_nationkey", name="n_name"),
        rows("customer", "Customer", CUSTOMER, "c_custkey", name="c_name", balance="c_acctbal", segment="c_mktsegment"),
        rows("orders", "Order", ORDER, "o_orderkey", name="o_orderstatus", balance="o_totalprice", segment="o_orderpriority"),
        rows("supplier", "Supplier", SUPPLIER, "s_suppkey", name="s_name", balance="s_acctbal"),
        rows("part", "Part", PART, "p_partkey", name="p_name", balance="p_retailprice", segment="p_brand"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rel_id, src, dst, type, weight)."""
    table = lambda n: read(spark, sf_dir, n)
    c = lambda x: F.col(x).cast("long")
    none = F.lit(None).cast("double")
    parts = [
        table("orders").select((c("o_orderkey") + PLACED).alias("rel_id"), (c("o_custkey") + CUSTOMER).alias("src"), (c("o_orderkey") + ORDER).alias("dst"), F.lit("PLACED").alias("type"), F.col("o_totalprice").alias("weight")),
        table("customer").select((c("c_custkey") + IN_NATION).alias("rel_id"), (c("c_custkey") + CUSTOMER).alias("src"), (c("c_nationkey") + NATION).alias("dst"), F.lit("IN_NATION").alias("type"), none.alias("weight")),
        table("nation").select((c("n_nationkey") + IN_REGION).alias("rel_id"), (c("n_nationkey") + NATION).alias("src"), (c("n_regionkey") + REGION).alias("dst"), F.lit("IN_REGION").alias("type"), none.alias("weight")),
        table("supplier").select((c("s_suppkey") + LOCATED).alias("rel_id"), (c("s_suppkey") + SUPPLIER).alias("src"), (c("s_nationkey") + NATION).alias("dst"), F.lit("LOCATED").alias("type"), none.alias("weight")),
        # a relationship for each order and part, as lines repeat their numbers
        table("lineitem").groupBy(c("l_orderkey").alias("o"), c("l_partkey").alias("p")).agg(F.sum("l_quantity").alias("weight")).select((F.col("o") * 10**7 + F.col("p") + CONTAINS).alias("rel_id"), (F.col("o") + ORDER).alias("src"), (F.col("p") + PART).alias("dst"), F.lit("CONTAINS").alias("type"), "weight"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def business_graph(spark: SparkSession, sf_dir: str) -> Graph:
    return Graph(nodes(spark, sf_dir), relationships(spark, sf_dir))


def turn_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Turns of conversations (id = conv_id * 1000 + turn) and NEXT relationships between them."""
    t = read(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "conv_id", "turn", "role", "text")
    return Graph(t.withColumn("labels", F.array(F.lit("Turn"))), t.join(t.select(F.col("id").alias("nid")), F.col("id") + 1 == F.col("nid")).select(F.col("id").alias("rel_id"), F.col("id").alias("src"), F.col("nid").alias("dst"), F.lit("NEXT").alias("type"), F.lit(1.0).alias("weight")))
