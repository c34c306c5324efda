"""Joins that a plain equality can't say, made of equalities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _aligned_blocks(lo, hi, bits: int):
    """A range as blocks whose size is a power of two and that start at a multiple of it: an array of (level, number), two a
    level at most. Going up a level, an odd start or an odd end is a block of its own."""

    def step(acc, k):
        active = acc["l"] < acc["r"]
        left, right = active & (acc["l"] % 2 == 1), active & (acc["r"] % 2 == 1)
        block = lambda take, n: F.when(take, F.array(F.struct(k.alias("level"), n.alias("block"))))
        none = F.array().cast("array<struct<level:int,block:bigint>>")
        out = F.concat(acc["out"], F.coalesce(block(left, acc["l"]), none), F.coalesce(block(right, acc["r"] - 1), none))
        return F.struct(F.shiftright(acc["l"] + left.cast("long"), 1).alias("l"), F.shiftright(acc["r"] - right.cast("long"), 1).alias("r"), out.alias("out"))

    start = F.struct(lo.cast("long").alias("l"), (hi.cast("long") + 1).alias("r"), F.array().cast("array<struct<level:int,block:bigint>>").alias("out"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), start, step, lambda acc: acc["out"])


def range_lookup(rows: DataFrame, ranges: DataFrame, key: str, lo: str, hi: str, value: str, bits: int = 32) -> DataFrame:
    """Left join of key to the range that holds it (ranges don't overlap, both ends belong to them; numbers of up to ``bits``
    bits, 62 at most). Ranges are cut into aligned blocks, at most twice ``bits`` however long they are; different keys meet
    them by level and block, so by equality, and rows meet their key's range. Ranges that end before they start hold none."""
    cut = ranges.select(F.explode(_aligned_blocks(F.col(lo), F.col(hi), bits)).alias("b"), F.col(value).alias("__v")).select("b.level", "b.block", "__v")
    levels = [r["level"] for r in cut.select("level").distinct().collect()]  # a row a level: at most bits
    keys = rows.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct()
    at = [F.struct(F.lit(k).alias("level"), F.shiftright(F.col("__k").cast("long"), k).alias("block")) for k in levels]
    none = F.array().cast("array<struct<level:int,block:bigint>>")
    found = keys.select("__k", F.explode(F.array(*at) if at else none).alias("b")).select("__k", "b.level", "b.block").join(cut, ["level", "block"]).select("__k", "__v")
    return rows.join(found, rows[key] == found["__k"], "left").select(*(rows[c] for c in rows.columns), F.col("__v").alias(value))


def either_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]], row_id: str) -> DataFrame:
    """Rows of left that match right by any of several key pairs: one equality join a pair, then distinct rows."""
    found = None
    for a, b in pairs:
        hit = left.where(F.col(a).isNotNull()).join(right.where(F.col(b).isNotNull()).select(F.col(b).alias(a)).distinct(), a, "left_semi").select(row_id)
        found = hit if found is None else found.union(hit)
    return left.join(found.distinct(), row_id, "left_semi")


def neither_key(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """Rows of left that match right by none of the key pairs; null keys never match."""
    for a, b in pairs:
        left = left.join(right.where(F.col(b).isNotNull()).select(F.col(b).alias(a)).distinct(), a, "left_anti")
    return left
