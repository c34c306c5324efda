"""Breadth-first closure by frontier joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import scratch_folder


def closure(edges: DataFrame, roots: list | DataFrame, max_depth: int = 10_000) -> DataFrame:
    """node, depth of all that roots (values, or a table with column node) reach over edges (src, dst).

    A round joins the frontier alone with the edges and leaves out what earlier rounds saw. Each round's nodes are written
    once, as a part of one table in the shared folder, so plans stay small and a lost executor costs a round at most.
    Raises ValueError if nodes are left at max_depth."""
    spark = edges.sparkSession
    folder = scratch_folder(spark, "closure")
    edges = edges.select("src", "dst")
    edges.write.parquet(f"{folder}/edges")
    edges = spark.read.schema(edges.schema).parquet(f"{folder}/edges")
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame([(r,) for r in roots], "node long")

    def add(nodes: DataFrame, depth: int) -> DataFrame:
        nodes = nodes.select("node", F.lit(depth).cast("long").alias("depth"))
        path = f"{folder}/rounds/round={depth}"
        nodes.write.parquet(path)
        return spark.read.schema(nodes.schema).parquet(path)

    def seen() -> DataFrame:
        return spark.read.schema(frontier.schema).parquet(f"{folder}/rounds").select("node", "depth")

    depth, frontier = 0, add(roots.select("node").distinct(), 0)
    while not frontier.isEmpty():
        if depth >= max_depth:
            raise ValueError(f"the closure is deeper than {max_depth}")
        depth += 1
        found = edges.join(frontier.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = add(found.join(seen(), "node", "left_anti"), depth)
    return seen()
