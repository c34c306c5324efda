"""Roll-ups of dependency edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.codes import COMMON, MISSING, PACKAGE_ONLY, RESOLVED, UNRESOLVED


def n_if(condition: Column) -> Column:
    return F.count_if(condition).cast("long")


def package_summary(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Eight counters a key; the worst outcome wins (missing, unresolved, package only, resolved); the provider only where
    all resolved edges agree on it. One shuffle, combined before it."""
    out = F.col("outcome")
    s = edges.groupBy(*keys).agg(
        F.count("*").alias("dependency_count"), n_if(out == RESOLVED).alias("resolved_count"), n_if(out == MISSING).alias("missing_count"),
        n_if(out == PACKAGE_ONLY).alias("package_only_count"), n_if(out == COMMON).alias("common_count"), n_if(out == UNRESOLVED).alias("unresolved_count"),
        n_if((out == MISSING) & F.col("hard")).alias("hard_missing_count"), n_if((out == MISSING) & ~F.col("hard")).alias("nonhard_missing_count"),
        F.min("provider").alias("lo"), F.max("provider").alias("hi"),
    )
    worst = F.when(F.col("missing_count") > 0, MISSING).when(F.col("unresolved_count") + F.col("common_count") > 0, UNRESOLVED).when(F.col("package_only_count") > 0, PACKAGE_ONLY).otherwise(RESOLVED)
    return s.withColumn("summary_outcome", worst).withColumn("provider_file_id", F.when(F.col("lo") == F.col("hi"), F.col("lo"))).drop("lo", "hi")


def current(files: DataFrame) -> DataFrame:
    """The one freshness gate: verified files whose policy and payload are those of the last complete pass."""
    return files.where((F.col("status") == "F") & F.col("policy_current") & F.col("payload_current"))
