"""Stored sections of packages: partitioned by game and section, checked by a hash a block, read by page or by position.

A row has file_id, index and a payload; BLOCK rows of a file's section make a block. Publication replaces the rows of the
files it names and leaves the others: partitions are rewritten whole, by game and section, from old rows without those
files and the new ones, so a repeated publication changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

BLOCK = 1024
SCHEMA = "game_id long, section string, file_id long, index long, payload string"


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def blocks(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """A hash of each block: game_id, section, file_id, block, rows, sha256. A block is what a task holds of a file."""
    line = F.struct("index", F.coalesce("payload", F.lit("")).alias("payload"))
    b = rows.groupBy("game_id", "section", "file_id", F.floor(F.col("index") / size).alias("block")).agg(F.array_sort(F.collect_list(line)).alias("r"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws("\u0000", x["index"].cast("string"), x["payload"])), "\n")
    return b.select("game_id", "section", "file_id", "block", F.size("r").cast("long").alias("rows"), F.sha2(text.cast("binary"), 256).alias("sha256"))


def verify(rows: DataFrame, expected: DataFrame, size: int = BLOCK) -> DataFrame:
    """Blocks that are missing, unexpected or changed; no rows where all is well."""
    keys = ["game_id", "section", "file_id", "block"]
    a, b = blocks(rows, size).drop("rows"), expected.select(*keys, F.col("sha256").alias("want"))
    state = F.when(F.col("want").isNull(), "unexpected").when(F.col("sha256").isNull(), "missing").otherwise("changed")
    return a.join(b, keys, "full").where(~F.col("sha256").eqNullSafe(F.col("want"))).select(*keys, state.alias("problem"))


def page(rows: DataFrame, game_id: int, section: str, file_id: int, start: int, limit: int) -> DataFrame:
    """Rows start to start + limit of a section: partitions and row groups of others are not read."""
    return rows.where((F.col("game_id") == game_id) & (F.col("section") == section) & (F.col("file_id") == file_id) & F.col("index").between(start, start + limit - 1))


def at_positions(rows: DataFrame, positions: DataFrame) -> DataFrame:
    """Rows at the (file_id, index) that positions name."""
    return rows.join(positions.select("file_id", "index").distinct(), ["file_id", "index"], "left_semi").select(*rows.columns)


def publish(rows: DataFrame, path: str, staging: str) -> None:
    """Replaces the files that rows holds, in all their sections: what a file no longer has is removed. Only partitions with such files are rewritten; the new state of them is
    written to ``staging`` (a fresh shared folder) first, because a partition can't be read while it is overwritten."""
    spark, gone = rows.sparkSession, []
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = rows.select(*names)
    try:
        old = read(spark, path)
        files = rows.select("game_id", "file_id").distinct()
        touched = old.join(files, ["game_id", "file_id"], "left_semi").select("game_id", "section").union(rows.select("game_id", "section")).distinct()
        kept = old.join(touched, ["game_id", "section"], "left_semi").join(files, ["game_id", "file_id"], "left_anti").select(*names)
        rows = kept.unionByName(rows)
        gone = touched.join(rows.select("game_id", "section").distinct(), ["game_id", "section"], "left_anti").collect()  # emptied partitions
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.parquet(staging)
    new = spark.read.schema(SCHEMA).parquet(staging).repartition("game_id", "section", F.pmod(F.xxhash64("file_id"), F.lit(8)))
    new.sortWithinPartitions("game_id", "section", "file_id", "index").write.partitionBy("game_id", "section").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)
    for r in gone:
        part = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/game_id={r['game_id']}/section={r['section']}")
        part.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(part, True)
