"""Token identifiers in sorted-string-table shards.

A shard holds documents in ascending order of their keys (the identifier as 8 big-endian bytes with the sign bit turned,
after one byte that is 1 for null, so nulls come last):

    block*    zstd of entries: varint(bytes shared with the key before), varint(further key bytes), varint(2 * identifiers
              + wide), key bytes, value. The first entry of a block shares nothing. A value is little-endian identifiers
              of 16 bits, or of 32 where wide is 1: if one of them needs more.
    index     for each block: first key (9 bytes), offset (u64), bytes (u32), bytes unpacked (u32), entries (u32)
    bloom     bits of a Bloom filter of all keys, 10 a key, 7 probes
    footer    offsets and sizes of index and bloom, numbers of blocks, documents and identifiers, probes, magic

Lookup reads footer and index once, asks the Bloom filter, finds the block by binary search and reads that block alone.

Writing: documents are range-partitioned by identifier and sorted, each task encodes its texts and writes one shard under
a name of its own attempt, then renames it, so a lost or repeated task leaves whole files only. There are as many shards
as shuffle partitions, or more where a shard would hold over ``shard_bytes`` of text. The manifest (one row a shard) is
what readers go by. Files are opened through pyarrow's file systems, so the folder may lie in any store that these reach;
it must be shared between executors. A task holds one block, the index, one batch of texts and 8 bytes for each key of
its shard, which the Bloom filter is made of at the end.

Defined cases: null and empty texts have the end identifier alone; equal identifiers are neighbours, in the order of a
hash of their texts, may fall into several shards, and a lookup yields all of them; a null identifier is larger than any
other; a very long text is one entry, and its block is as large; no rows give no shards and no rows; further columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bpe import codec, vocabulary_path
from .common import batches, materialise, new_folder, store

MAGIC = b"STRASST3"
BLOCK_BYTES = 64 << 10
#: Bytes of text in a shard, about.
SHARD_BYTES = 256 << 20
KEY = 9
_INDEX = struct.Struct(f"<{KEY}sQIII")
_FOOTER = struct.Struct("<QQQQQQQI8s")
BITS_A_KEY, PROBES = 10, 7


def pack_key(ident: int | None) -> bytes:
    return b"\x01" + bytes(8) if ident is None else b"\x00" + (ident + (1 << 63)).to_bytes(8, "big")


def unpack_key(key: bytes) -> int | None:
    return None if key[0] else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    """The bits of keys, one probe after another."""
    step = hashes * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(17) | np.uint64(1)
    for i in range(PROBES):
        yield ((hashes + np.uint64(i) * step) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Takes (identifier, value) in key order and writes a shard to a binary file object."""

    def __init__(self, out, block_bytes: int = BLOCK_BYTES):
        self.out, self.block_bytes, self.at = out, block_bytes, 0
        self.index: list[bytes] = []
        self.hashes = array("Q")
        self.block, self.first, self.last, self.entries, self.ids = bytearray(), b"", b"", 0, 0

    def add(self, ident: int | None, value: bytes) -> None:
        key = pack_key(ident)
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < KEY and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        ids = np.frombuffer(value, "<u4")
        wide = len(ids) > 0 and int(ids.max()) > 0xFFFF
        self.block += _varint(shared) + _varint(KEY - shared) + _varint(2 * len(ids) + wide) + key[shared:] + (value if wide else ids.astype("<u2").tobytes())
        self.last, self.entries, self.ids = key, self.entries + 1, self.ids + len(value) // 4
        self.hashes.append(xxhash.xxh3_64_intdigest(key))
        if len(self.block) >= self.block_bytes:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            packed = pa.compress(bytes(self.block), codec="zstd", asbytes=True)
            self.index.append(_INDEX.pack(self.first, self.at, len(packed), len(self.block), self.entries))
            self.out.write(packed)
            self.at += len(packed)
            self.block, self.entries = bytearray(), 0

    def close(self) -> dict:
        self._flush()
        index, n = b"".join(self.index), len(self.hashes)
        bits = max(64, n * BITS_A_KEY + 7 & ~7)
        bloom = np.zeros(bits // 8, np.uint8)
        for p in _probes(np.array(self.hashes, np.uint64), bits):
            np.bitwise_or.at(bloom, p >> 3, np.uint8(1) << (p & 7).astype(np.uint8))
        self.out.write(index + bloom.tobytes() + _FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom), len(self.index), n, self.ids, PROBES, MAGIC))
        return {"docs": n, "ids": self.ids, "blocks": len(self.index)}


class ShardReader:
    """Reads a shard from a seekable binary file object."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        size = file.tell() if size is None else size
        file.seek(size - _FOOTER.size)
        at, n_index, bloom_at, n_bloom, self.blocks, self.docs, self.ids, self.probes, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(at)
        self.index = list(_INDEX.iter_unpack(file.read(n_index)))
        file.seek(bloom_at)
        self.bloom = file.read(n_bloom)

    def may_hold(self, ident: int | None) -> bool:
        h = np.array([xxhash.xxh3_64_intdigest(pack_key(ident))], np.uint64)
        return all(self.bloom[p[0] >> 3] >> (p[0] & 7) & 1 for p in map(np.ndarray.tolist, _probes(h, len(self.bloom) * 8)))

    def _block(self, i: int) -> Iterator[tuple[int | None, bytes]]:
        _, at, size, unpacked, entries = self.index[i]
        self.file.seek(at)
        data, pos, key = pa.decompress(self.file.read(size), unpacked, codec="zstd", asbytes=True), 0, b""
        for _ in range(entries):
            shared, pos = _read_varint(data, pos)
            more, pos = _read_varint(data, pos)
            n, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + more]
            pos += more
            size = n >> 1 << 1 + (n & 1)
            value = data[pos : pos + size]
            yield unpack_key(key), value if n & 1 else np.frombuffer(value, "<u2").astype("<u4").tobytes()
            pos += size

    def get(self, ident: int | None) -> list[bytes]:
        """The values of a key: none, one, or as many as rows repeat it."""
        if not self.index or not self.may_hold(ident):
            return []
        key, found = pack_key(ident), []
        firsts = [x[0] for x in self.index]
        i = max(0, bisect_right(firsts, key) - 1)
        while i > 0 and firsts[i] == key:
            i -= 1
        while i < len(firsts) and (firsts[i] <= key):
            found += [v for k, v in self._block(i) if k == ident]
            i += 1
        return found

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)


_MANIFEST = pa.schema([("part", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("ids", pa.int64()), ("first", pa.binary()), ("last", pa.binary())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def write_shards(docs: DataFrame, folder: str, end_id: int = 2, ident: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Encodes all texts, writes the shards into folder (a URI that executors share) and returns the manifest: part,
    path, docs, ids, first and last key, in key order by part."""
    spark = docs.sparkSession
    end = end_id.to_bytes(4, "little")
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // shard_bytes))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, c = TaskContext.get().partitionId(), codec(vocabulary_path(vocabulary))
        writer = out = None
        for batch in it:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if writer is None:
                    files, root = store(folder)
                    files.create_dir(root, recursive=True)
                    trial = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
                    out = files.open_output_stream(trial)
                    writer, first = ShardWriter(out), pack_key(i)
                writer.add(i, c.encode(t or "") + end)
        if writer is not None:
            got = writer.close()
            out.close()
            files.move(trial, f"{root}/part-{part:06d}.sst")
            yield batches(_MANIFEST, [[part], [f"{folder}/part-{part:06d}.sst"], [got["docs"]], [got["ids"]], [first], [writer.last]])

    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    keys = (F.col("doc_id").asc_nulls_last(), "h")
    rows = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys, "t").select("doc_id", "t")
    return materialise(rows.mapInArrow(run, "part long, path string, docs long, ids long, first binary, last binary"), "sst-manifest")


def lookup(manifest: DataFrame, wanted: DataFrame, ident: str = "doc_id") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) of the wanted identifiers that the shards hold, one row for
    each document with it. Keys go to the shards whose range holds them; a task opens a shard once and reads, behind the
    Bloom filter, one block a key. The list of shards (a row a shard) is what every task knows."""
    shards = [(r["first"], r["last"], r["path"]) for r in manifest.orderBy("part").collect()]  # a row a shard
    lasts, out = [bytes(x[1]) for x in shards], pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def route(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found: tuple[list, list] = ([], [])
            for i in batch.column(0).to_pylist():
                key = pack_key(i)
                s = bisect_left(lasts, key)
                while s < len(shards) and bytes(shards[s][0]) <= key:
                    found[0].append(i)
                    found[1].append(s)
                    s += 1
            yield batches(pa.schema([("doc_id", pa.int64()), ("shard", pa.int32())]), list(found))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = reader = file = None
        for batch in it:
            for i, s in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != now:
                    files, name = store(shards[s][2])
                    now, file = s, files.open_input_file(name)
                    reader = ShardReader(file)
                got = reader.get(i)
                if got:
                    yield batches(out, [[i] * len(got), got])

    keys = wanted.select(F.col(ident).cast("long").alias("doc_id")).distinct()
    return keys.mapInArrow(route, "doc_id long, shard int").repartition("shard").sortWithinPartitions("shard", "doc_id").mapInArrow(read, "doc_id long, ids binary")


def read_shards(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files of a manifest; a task reads a shard."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                files, name = store(path)
                with files.open_input_file(name) as file:
                    rows = []
                    for key, value in ShardReader(file):
                        rows.append((key, start, len(value) // 4, zlib.crc32(value)))
                        start += len(value) // 4
                        if len(rows) == 50_000:
                            yield batches(_READ, [list(x) for x in zip(*rows, strict=True)])
                            rows = []
                    if rows:
                        yield batches(_READ, [list(x) for x in zip(*rows, strict=True)])

    before = F.coalesce(F.sum("ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = manifest.select("path", before.alias("start"), "part")
    n = max(1, manifest.count())
    return starts.repartitionByRange(n, "part").select("path", "start").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, **options) -> DataFrame:
    return read_shards(write_shards(docs, new_folder(docs.sparkSession, "sst"), **options))
