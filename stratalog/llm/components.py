"""Connected components of an edge table by least labels and pointer jumping, over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, remove, write_table


def connected(edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for all nodes of edges (src, dst), any direction.

    In a round each label hooks the least label that touches it and labels jump to their label's label, so the number
    of rounds grows with the logarithm of a component's width. A label that very many nodes share is joined without
    being shuffled to one task; minima are combined before they move. Every round's tables are written, so no lineage
    grows and a lost executor costs one round at most; tables of earlier rounds are removed. No edges give no rows;
    loops and repeats are harmless."""
    spark = edges.sparkSession
    links, links_at = write_table(edges.where("src != dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "edges")
    label = label_at = None
    while not links.isEmpty():
        nodes = links.select(F.col("u").alias("node"), F.col("v").alias("to")).unionByName(links.select(F.col("v").alias("node"), F.col("u").alias("to")))
        up, up_at = write_table(nodes.groupBy("node").agg(F.least(F.col("node"), F.min("to")).alias("up")), "hooks")
        for _ in range(2):
            parent = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
            before = up_at
            up, up_at = write_table(join_hot(up, parent, "up").select("node", F.col("upper").alias("up")), "jumps")
            remove(spark, before)
        upper = up.select(F.col("node").alias("up"), F.col("up").alias("upper"))
        if label is None:
            label, label_at = up, up_at
        else:
            before = label_at
            label, label_at = write_table(join_hot(label, upper, "up", "left").select("node", F.coalesce("upper", "up").alias("up")), "labels")
            remove(spark, before)
        left = join_hot(links.withColumnRenamed("u", "up"), upper, "up").select(F.col("upper").alias("a"), F.col("v").alias("up"))
        left, left_at = write_table(left, "half")
        merged = join_hot(left, upper, "up").where("a != upper").select(F.greatest("a", "upper").alias("u"), F.least("a", "upper").alias("v")).distinct()
        before = [links_at, left_at] + ([up_at] if up_at != label_at else [])
        links, links_at = write_table(merged, "edges")
        remove(spark, *before)
    if label is None:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("root")).limit(0)
    return label.select("node", F.col("up").alias("root"))
