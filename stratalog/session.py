"""A session with the settings that the queries expect."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def session(master: str = "local[*]", partitions: int | None = None, **conf: str) -> SparkSession:
    """On a cluster leave partitions unset: adaptive execution joins small shuffle partitions and splits skewed ones."""
    builder = SparkSession.builder.master(master).appName("stratalog").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the one that all executors share, named by spark.checkpoint.dir. Without it only a session whose
    tasks run in this process (tests) gets one of its own."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='stratalog-')}/{name}-{uuid.uuid4().hex}"
