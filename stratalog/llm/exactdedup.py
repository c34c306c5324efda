"""Exact deduplication by owners in Patricia tries.

Every text goes, without its white space, to the partition of its length and content hash. There the full byte strings
are put into a compressed radix trie, so equality is decided by all bytes; the terminal node of a string holds its owner:
the row with the most code points in the original text, then the smallest identifier, and the number of rows.

Before the shuffle each map task puts its rows into a trie of bounded size, so that a text with a third of all rows
crosses the network once a task. When that trie is full, its heaviest subtree is spilled into the shuffle. After the
shuffle rows come sorted by length and hash; a full trie is emptied where the hash changes, so it never holds more than
its bound and the texts of one hash, and what waits lies in Spark's own sort, which spills to disk.

Rows find their owner by the SHA-256 of the normalised text, which the terminal nodes give out; a text with over a
thousandth of all rows is joined by broadcast, of which there are fewer than a thousand.

Defined cases: a null text is an empty one; empty and blank texts are all equal; a null identifier is larger than any
other; of rows with equal text and identifier the one with the most code points stays, among those the smallest SHA-256
of the original text; rows that agree in the original text and identifier are one document, counted each in
group_size, and all marked kept in ``exact_groups`` while ``keep_owners`` leaves one of them; no rows give no rows;
further columns are ignored, and kept by ``keep_owners`` whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, batches, join_hot, materialise, texts
from .patricia import PatriciaTrie

#: Bytes of a task's trie before it spills a subtree.
TRIE_BYTES = 48 << 20
_PART = pa.schema([("norm", pa.binary()), ("cp", pa.int64()), ("id", pa.int64()), ("raw", pa.binary()), ("n", pa.int64()), ("len", pa.int64()), ("hash", pa.int64())])
_OWNER = pa.schema([("sha", pa.string()), ("keep_id", pa.int64()), ("raw", pa.binary()), ("group_size", pa.int64())])


def _rank(cp: int, ident: int | None, raw: bytes) -> tuple:
    return (-cp, ident is None, ident or 0, raw)


def _merge(a: tuple, b: tuple) -> tuple:
    """Payloads are (code points, identifier, SHA-256 of the original, rows, hash)."""
    best = a if _rank(*a[:3]) <= _rank(*b[:3]) else b
    return (*best[:3], a[3] + b[3], a[4])


def _rows(schema: pa.Schema, rows: Iterator[tuple], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += 64 + len(row[0])
        if size >= most_bytes or len(part) >= 20_000:
            yield batches(schema, [list(c) for c in zip(*part, strict=True)])
            part, size = [], 0
    if part:
        yield batches(schema, [list(c) for c in zip(*part, strict=True)])


def _combine(bound: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = PatriciaTrie(_merge)

        def out(found):
            return ((key, *p[:4], len(key), p[4]) for key, p in found)

        for batch in it:
            for norm, cp, ident, raw, h in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                trie.insert(norm, (cp, ident, raw, 1, h))
                while trie.size > bound and trie.by_first:
                    yield from _rows(_PART, out(trie.evict()))
        yield from _rows(_PART, out(trie.items()))

    return run


def _own(bound: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, last = PatriciaTrie(_merge), None

        def out():
            return ((hashlib.sha256(key).hexdigest(), p[1], p[2], p[3]) for key, p in trie.items())

        for batch in it:
            cols = [batch.column(i).to_pylist() for i in range(7)]
            for norm, cp, ident, raw, n, length, h in zip(*cols, strict=True):
                if trie.size > bound and (length, h) != last:
                    yield from _rows(_OWNER, out())
                    trie = PatriciaTrie(_merge)
                trie.insert(norm, (cp, ident, raw, n, h))
                last = (length, h)
        yield from _rows(_OWNER, out())

    return run


def normalised(t) -> F.Column:
    return F.translate(t, BLANKS, "")


def _digest(t) -> F.Column:
    return F.unhex(F.sha2(t.cast("binary"), 256))


def owners(docs: DataFrame, ident: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """One row (sha, keep_id, raw, group_size) for each different text; raw: SHA-256 of the owner's original text."""
    norm = texts(docs, text).select(normalised(F.col("t")).alias("norm"), F.length("t").cast("long").alias("cp"), F.col(f"row.{ident}").cast("long").alias("id"), _digest(F.col("t")).alias("raw"))
    norm = norm.select(F.col("norm").cast("binary").alias("norm"), "cp", "id", "raw", F.xxhash64("norm").alias("hash"))
    parts = norm.mapInArrow(_combine(trie_bytes), "norm binary, cp long, id long, raw binary, n long, len long, hash long")
    parts = parts.repartition("len", "hash").sortWithinPartitions("len", "hash")
    return parts.mapInArrow(_own(trie_bytes), "sha string, keep_id long, raw binary, group_size long")


def exact_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row."""
    rows = texts(docs, text).select(F.col(f"row.{ident}").cast("long").alias("doc_id"), F.sha2(normalised(F.col("t")).cast("binary"), 256).alias("sha"), _digest(F.col("t")).alias("own"))
    out = join_hot(materialise(rows, "exact-rows"), materialise(owners(docs, ident, text, trie_bytes), "exact-owners"), "sha")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("own") == F.col("raw"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def keep_owners(docs: DataFrame, ident: str = "doc_id", text: str = "text", trie_bytes: int = TRIE_BYTES) -> DataFrame:
    """The rows of docs, with their columns, that own their text; one for each different text.

    An owner is known by its identifier and original text, so rows meet owners without their copies."""
    key = F.col(f"row.{ident}").cast("long")
    rows = texts(docs, text).select("row", F.coalesce(key, F.lit(0)).alias("i"), key.isNull().alias("l"), _digest(F.col("t")).alias("raw"))
    own = owners(docs, ident, text, trie_bytes).select(F.coalesce("keep_id", F.lit(0)).alias("i"), F.col("keep_id").isNull().alias("l"), "raw")
    return rows.join(own, ["i", "l", "raw"], "left_semi").dropDuplicates(["i", "l", "raw"]).select("row.*")
