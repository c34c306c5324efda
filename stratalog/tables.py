"""Logical tables of the catalogue over the given Parquet tables, and the same as SQL for the comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task sorts or keeps in a hash table, where the rows of a key are few.
TASK_ROWS = 500_000
#: Which outcome a pair of flags stands for.
OUTCOME = "CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 1 WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 0 WHEN l_returnflag = 'N' THEN 4 WHEN l_linestatus = 'F' THEN 1 ELSE 0 END"

EDGES_SQL = f"""edges AS (SELECT l_orderkey AS file_id, l_linenumber AS source_index, l_partkey AS object_id, p_brand AS package, p_name AS object_name,
  l_suppkey AS supplier, {OUTCOME} AS outcome, l_returnflag = 'N' AS hard, CASE WHEN {OUTCOME} = 1 THEN l_suppkey END AS provider FROM lineitem JOIN part ON l_partkey = p_partkey)"""
FILES_SQL = """files AS (SELECT o_orderkey AS file_id, c_nationkey AS game_id, o_orderstatus AS status, o_totalprice AS size, o_orderdate AS uploaded_at,
  o_orderpriority AS priority, o_custkey % 7 <> 0 AS payload_current, o_orderpriority <> '5-LOW' AS policy_current FROM orders JOIN customer ON o_custkey = c_custkey)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame, n: int, key: str) -> DataFrame:
    """Rows dealt by a key over so many tasks that each holds TASK_ROWS of n rows: adaptive execution joins small partitions
    by their compressed bytes, but sorts and hash tables hold them whole."""
    return rows.repartition(max(1, -(-n // TASK_ROWS)), key)


def edges(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("package"), F.col("p_name").alias("object_name"))
    line = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("source_index"), F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("supplier"),
        F.expr(OUTCOME).alias("outcome"), (F.col("l_returnflag") == "N").alias("hard"),
    )
    return line.join(part, line["object_id"] == part["p_partkey"]).drop("p_partkey").withColumn("provider", F.when(F.col("outcome") == 1, F.col("supplier")))


def files(spark: SparkSession, sf: str) -> DataFrame:
    customer = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("game_id"))
    orders = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("file_id"), "o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("uploaded_at"),
        F.col("o_orderpriority").alias("priority"), (F.col("o_custkey") % 7 != 0).alias("payload_current"), (F.col("o_orderpriority") != "5-LOW").alias("policy_current"),
    )
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).drop("o_custkey", "c_custkey")


def owned_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges with their file's game, the rows of a file in one task: what groups them by file moves none again."""
    n = table(spark, sf, "lineitem").count()  # from the files' footers
    owner = files(spark, sf).select("file_id", "game_id")
    return dealt(edges(spark, sf), n, "file_id").join(dealt(owner, n, "file_id"), "file_id")
