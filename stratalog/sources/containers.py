"""Tables of contents of containers (engine 5) as column expressions over the bytes that binaryFile reads.

A table of contents has a header of 144 bytes, then for each chunk an identifier (12 bytes) and its place (10), seeds of
hashes, compression blocks (12 each), names of methods, and at the end, for each chunk, a hash and flags. Each function
gives a row an entry: numbers of entries are read from the header and exploded, so Python never sees the bytes.

Defined cases: null or short bytes, another tag or another size of the header give the status alone, and no entries;
entries behind the end of the bytes are null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format.
TAG, HEADER = b"-==--==--==--==-", 144
FIRST_VERSION, LAST_VERSION, SEEDS_VERSION, OVERFLOW_VERSION, SHORT_HASH_VERSION = 2, 8, 4, 5, 8
FLAGS = {"compressed": 1, "encrypted": 2, "signed": 4, "indexed": 8, "on_demand": 16}


def _hex(data: Column, at, size: int, little: bool = False) -> Column:
    """Bytes from a place (from 0) in hex, turned round if little; null behind the end."""
    part = F.hex(F.substr(data, F.lit(at) + 1 if isinstance(at, int) else at + 1, F.lit(size)))
    turned = F.concat(*(F.substring(part, k, 2) for k in range(2 * size - 1, 0, -2))) if little else part
    return F.when(F.length(part) == 2 * size, turned)


def number(data: Column, at, size: int, little: bool = True) -> Column:
    """An unsigned number of up to seven bytes."""
    return F.conv(_hex(data, at, size, little), 16, 10).cast("long")


def toc_header(files: DataFrame, data: str = "content") -> DataFrame:
    """files with status, version, entries, blocks, methods, method_length, container_id, flags, seeds, overflow."""
    c = F.col(data)
    named = {"version": (16, 1), "__size": (20, 4), "entries": (24, 4), "blocks": (28, 4), "__block": (32, 4), "methods": (36, 4), "method_length": (40, 4), "flags": (80, 1), "seeds": (84, 4), "overflow": (96, 4)}
    read = files.withColumns({k: number(c, at, size) for k, (at, size) in named.items()} | {"container_id": _hex(c, 56, 8, little=True), "__tag": F.substring(c, 1, 16)})
    status = F.when(F.col("overflow").isNull(), "truncated").when(F.col("__tag") != F.lit(TAG), "bad_tag").when((F.col("__size") != HEADER) | (F.col("__block") != 12), "bad_header").when(~F.col("version").between(FIRST_VERSION, LAST_VERSION), "unsupported_version").otherwise("ok")
    read = read.withColumn("status", status)
    ok, fields = F.col("status") == "ok", ("version", "entries", "blocks", "methods", "method_length", "flags", "seeds", "overflow", "container_id")
    return read.withColumns({k: F.when(ok, F.col(k)) for k in fields}).drop("__size", "__block", "__tag")


def _entries(toc: DataFrame, n: str) -> DataFrame:
    return toc.where((F.col("status") == "ok") & (F.col(n) > 0)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col(n) - 1)))


def _blocks_at() -> Column:
    seeds = F.when(F.col("version") >= SEEDS_VERSION, F.col("seeds")).otherwise(0) + F.when(F.col("version") >= OVERFLOW_VERSION, F.col("overflow")).otherwise(0)
    return HEADER + 22 * F.col("entries") + 4 * seeds


def toc_chunks(toc: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key, i, package_id, chunk_index, chunk_type, offset, length of each chunk, from rows of toc_header."""
    c = F.col(data)
    e = _entries(toc, "entries")
    at, place = HEADER + 12 * F.col("i"), HEADER + 12 * F.col("entries") + 10 * F.col("i")
    return e.select(key, "i", _hex(c, at, 8, little=True).alias("package_id"), number(c, at + 8, 2, little=False).alias("chunk_index"), number(c, at + 11, 1).alias("chunk_type"), number(c, place, 5, little=False).alias("offset"), number(c, place + 5, 5, little=False).alias("length"))


def toc_blocks(toc: DataFrame, key: str, data: str = "content") -> DataFrame:
    """key, i, offset, packed, size, method (its name; None for number 0) of each compression block."""
    c, at = F.col(data), F.col("__at") + 12 * F.col("i")
    e = _entries(toc.withColumn("__at", _blocks_at()), "blocks")
    e = e.withColumn("m", number(c, at + 11, 1)).withColumn("name", F.substr(c, F.col("__at") + 12 * F.col("blocks") + (F.col("m") - 1) * F.col("method_length") + 1, F.col("method_length")))
    name = F.regexp_replace(F.decode("name", "UTF-8"), "\u0000.*", "")
    return e.select(key, "i", number(c, at, 5).alias("offset"), number(c, at + 5, 3).alias("packed"), number(c, at + 8, 3).alias("size"), F.when(F.col("m") == 0, "None").when(F.col("m") <= F.col("methods"), name).alias("method"))


def write_toc(chunks: Column, blocks: Column, version: Column, container: Column) -> Column:
    """Bytes of a table of contents from arrays of structs: chunks (package_id, index, type, offset, length) and blocks
    (offset, packed, size, method 0 or 1); one method, Zlib. For tests and samples."""
    big = lambda v, size: F.lpad(F.hex(v.cast("long")), 2 * size, "0")
    small = lambda v, size: F.concat(*(F.lpad(F.hex(F.shiftright(v.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(size)))
    zeros = lambda n: F.lit("00" * n)
    head = F.concat(F.lit(TAG.hex().upper()), small(version, 1), zeros(3), small(F.lit(HEADER), 4), small(F.size(chunks), 4), small(F.size(blocks), 4), small(F.lit(12), 4), small(F.lit(1), 4), small(F.lit(32), 4), small(F.lit(65536), 4), zeros(4), small(F.lit(1), 4), small(container, 8), zeros(16), small(F.lit(FLAGS["compressed"]), 1), zeros(3), small(F.lit(2), 4), F.lit("FF" * 8), small(F.lit(1), 4), zeros(44))
    ids = F.array_join(F.transform(chunks, lambda x: F.concat(small(x["package_id"], 8), big(x["index"], 2), zeros(1), big(x["type"], 1))), "")
    places = F.array_join(F.transform(chunks, lambda x: F.concat(big(x["offset"], 5), big(x["length"], 5))), "")
    seeds = F.repeat(F.lit("11223344"), F.when(version >= SEEDS_VERSION, 2).otherwise(0) + F.when(version >= OVERFLOW_VERSION, 1).otherwise(0))
    packed = F.array_join(F.transform(blocks, lambda x: F.concat(small(x["offset"], 5), small(x["packed"], 3), small(x["size"], 3), small(x["method"], 1))), "")
    return F.unhex(F.concat(head, ids, places, seeds, packed, F.rpad(F.lit(b"Zlib".hex().upper()), 64, "0")))
