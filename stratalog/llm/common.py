"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of characters outside this class; ``bytes.split()`` cuts at the same six characters.
WORD = r"[^\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the one that the cluster names in spark.checkpoint.dir.

    Only where that is unset and all tasks run in this process, as in tests, a folder of its own is set. On a cluster
    no other place is known to be shared, so it is an error there."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="stratalog-"))
    return sc.getCheckpointDir()


_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _made.get()) is not None:
        made.append(path)
    return path


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[str]]:
    """Removes, at its end, the folders that operators made inside; what is taken out of the list stays.

    For callers that have written their result by then: a result not yet written still reads these folders."""
    token = _made.set([])
    try:
        yield _made.get()
    finally:
        made = _made.get()
        _made.reset(token)
        remove(spark, *made)


def remove(spark: SparkSession, *folders: str) -> None:
    """Removes folders of new_folder whose rows are no longer needed."""
    sc = spark.sparkContext
    for folder in folders:
        path = sc._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def store(uri: str):
    """The pyarrow file system of a URI that executors share, and the path in it."""
    from pyarrow import fs

    scheme, sep, rest = uri.partition("://")
    if sep:
        return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")
    return fs.FileSystem.from_uri(uri if uri.startswith("file:") else f"file://{uri}")


def write_table(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df written as Parquet to the shared folder and read back, and its folder."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df with its rows computed once, in a table that outlives executors. The table stays, as the result reads it later."""
    return write_table(df, name)[0]


def join_hot(left: DataFrame, right: DataFrame, on: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left joined to right, which has one row a key, without a task for a hot key.

    Keys with more than 1/share of left's rows are fewer than share by counting, whatever the input; their rows of right
    are broadcast and left's stay where they are. All other keys are shuffled. left should be a written table, as it is
    read for the count and for both joins. A null key has no partner."""
    counts = left.groupBy(on).agg(F.count("*").alias("__n"))
    total = left.agg(F.count("*")).scalar()
    hot = counts.where((F.col("__n") * share > total) & F.col(on).isNotNull()).select(on)  # fewer than share rows
    rest = left.join(F.broadcast(hot), on, "left_anti").join(right.join(F.broadcast(hot), on, "left_anti"), on, how)
    few = right.join(F.broadcast(hot), on, "left_semi")
    return rest.unionByName(left.join(F.broadcast(hot), on, "left_semi").join(F.broadcast(few), on, how))


def texts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with each row kept whole in column ``row`` (so that no name can clash) and the text, null as empty, in ``t``."""
    return docs.select(F.struct("*").alias("row"), F.coalesce(F.col(text), F.lit("")).alias("t"))


def byte_lists(batch: pa.RecordBatch, i: int) -> list[bytes]:
    """A column of strings as UTF-8 bytes, null as empty."""
    column = batch.column(i)
    column = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def batches(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

