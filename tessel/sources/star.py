"""The sales tables as a graph: customers place orders of items, which are of parts and by suppliers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalog import ID, Edge, Graph, make_id

TABLES = {
    "REGION": ("region", ["r_regionkey"]),
    "NATION": ("nation", ["n_nationkey"]),
    "CUSTOMER": ("customer", ["c_custkey"]),
    "SUPPLIER": ("supplier", ["s_suppkey"]),
    "PART": ("part", ["p_partkey"]),
    "ORDER": ("orders", ["o_orderkey"]),
    "LINEITEM": ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice"]),
    "EVENT": ("events", ["event_id"]),
    "DOCUMENT": ("documents", ["doc_id"]),
    "RATING": ("labels", ["doc_id"]),
}
EDGES = [
    Edge("IN_REGION", "NATION", "REGION", ("n_regionkey", "r_regionkey")),
    Edge("FROM_NATION", "CUSTOMER", "NATION", ("c_nationkey", "n_nationkey")),
    Edge("FROM_NATION", "SUPPLIER", "NATION", ("s_nationkey", "n_nationkey")),
    Edge("PLACED", "CUSTOMER", "ORDER", ("c_custkey", "o_custkey")),
    Edge("HAS_ITEM", "ORDER", "LINEITEM", ("o_orderkey", "l_orderkey")),
    Edge("OF_PART", "LINEITEM", "PART", ("l_partkey", "p_partkey")),
    Edge("SUPPLIED_BY", "LINEITEM", "SUPPLIER", ("l_suppkey", "s_suppkey")),
    Edge("BY_USER", "EVENT", "CUSTOMER", ("user_id", "c_custkey")),
    Edge("RATES", "RATING", "DOCUMENT", ("doc_id", "doc_id")),
]


def load(spark: SparkSession, sf_dir: str, labels: list[str] | None = None) -> Graph:
    """The graph over the tables; parts get tags, the words of their names, and every fifth order lacks a priority."""
    graph = Graph(spark)
    for label in labels or TABLES:
        table, key = TABLES[label]
        df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        if label == "PART":
            df = df.withColumn("tags", F.split("p_name", " "))
        if label == "ORDER":
            df = df.withColumn("o_note", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")))
            df = df.withColumn("o_day", F.date_format("o_orderdate", "yyyy-MM-dd"))
        graph.labels[label] = df.withColumn(ID, make_id(label, *key))
        graph.keys[label] = tuple(key)
    graph.datetimes = {"ORDER": {"o_day"}}
    graph.edges = [e for e in EDGES if e.src in graph.labels and e.dst in graph.labels]
    return graph


def trades(graph: Graph) -> Edge:
    """NATION to NATION: from the suppliers' nation to that of the customers who bought most from them, itself aside."""
    r = graph.labels
    sold = (
        r["LINEITEM"].select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")), 4).cast("decimal(18,4)").alias("v"))
        .join(r["SUPPLIER"].select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
        .join(r["ORDER"].select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(r["CUSTOMER"].select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
        .where("s_nationkey <> c_nationkey").groupBy("s_nationkey", "c_nationkey").agg(F.sum("v").alias("v"))
    )
    first = Window.partitionBy("s_nationkey").orderBy(F.desc("v"), "c_nationkey")
    top = sold.withColumn("n", F.row_number().over(first)).where("n = 1")
    pairs: DataFrame = top.select(F.concat(F.lit("NATION:"), "s_nationkey").alias("src"), F.concat(F.lit("NATION:"), "c_nationkey").alias("dst"))
    return Edge("TRADES", "NATION", "NATION", df=pairs)
