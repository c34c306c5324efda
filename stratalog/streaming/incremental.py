"""Incremental refresh: affected consumers of each batch of changes, and overlapping high-water-mark loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def affected(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """file_id of all that require a changed package (column package) or are resolved to a changed provider (provider)."""
    by_package = edges.join(changed.where("package IS NOT NULL").select("package").distinct(), "package", "left_semi").select("file_id")
    by_provider = edges.where("outcome = 1").join(changed.where("provider IS NOT NULL").select("provider").distinct(), "provider", "left_semi").select("file_id")
    return by_package.union(by_provider).distinct()


def stale(files: DataFrame, policy: str, payload: str, current_policy: str) -> DataFrame:
    """Files whose last pass has another policy or payload than now; null-safe, so files never passed are stale."""
    return files.where(~F.col(policy).eqNullSafe(F.lit(current_policy)) | ~F.col(payload).eqNullSafe(F.col("payload_sha256")))


def since(rows: DataFrame, updated: str, mark, overlap_seconds: int = 2) -> DataFrame:
    """Rows at or after the mark less an overlap, so rows of the same moment are never missed; load them by key."""
    return rows if mark is None else rows.where(F.col(updated) >= F.lit(mark) - F.expr(f"INTERVAL {overlap_seconds} SECOND"))


def upsert(old: DataFrame, new: DataFrame, key: str, updated: str) -> DataFrame:
    """The latest row of each key; loading the same rows again changes nothing."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    last = W.partitionBy(key).orderBy(F.col(updated).desc(), F.col("__new").desc())
    return both.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "__new")


def watch_changes(changes: DataFrame, edges: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes, a folder a batch, which files each batch of a stream of changes affects; a repeated batch overwrites its own."""

    def batch(df: DataFrame, number: int) -> None:
        affected(edges, df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return changes.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
