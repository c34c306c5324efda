"""Binary fields of packages: compact indexes, headers, and the block-sorting codec of redirect files."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAGIC = 0x9E2A83C1


def read_compact_index(data: bytes, at: int = 0) -> tuple[int, int]:
    """A signed number of 1 to 5 bytes, and where it ends. First byte: sign, more, 6 bits; then more and 7 bits.

    A fifth byte that says more, and numbers of more than 31 bits, are errors."""
    first = data[at]
    at += 1
    value, shift, more = first & 63, 6, first & 64
    while more and shift < 34:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        more, shift = b & 128, shift + 7
    if more or value > 0x7FFFFFFF:
        raise ValueError("a compact index of more than 31 bits")
    return (-value if first & 128 else value), at


def write_compact_index(value: int) -> bytes:
    n = abs(value)
    out = bytearray([(128 if value < 0 else 0) | (64 if n > 63 else 0) | n & 63])
    n >>= 6
    while n:
        out.append((128 if n > 127 else 0) | n & 127)
        n >>= 7
    return bytes(out)


def encode_compact_index(value: Column) -> Column:
    """write_compact_index as a column expression: null for numbers of more than 31 bits, which have no compact index."""
    n = F.abs(value.cast("long"))
    n = F.when(n <= 0x7FFFFFFF, n)
    first = F.when(value < 0, 128).otherwise(0) + F.when(n > 63, 64).otherwise(0) + n.bitwiseAND(63)
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    out = byte(first.cast("long"))
    for k in range(4):
        rest = F.shiftright(n, 6 + 7 * k)
        out = F.concat(out, F.when(rest > 0, byte(F.when(rest > 127, 128).otherwise(0) + rest.bitwiseAND(127))).otherwise(""))
    return F.unhex(out)


def compact_index_column(data: Column) -> Column:
    """read_compact_index of a column's first bytes as a column expression: null where it is cut short or too large."""
    at = lambda k: F.conv(F.hex(F.substring(data, k, 1)), 16, 10).cast("long")
    first = at(1)
    value, more = first.bitwiseAND(63), first.bitwiseAND(64) != 0
    for k in range(4):
        b = at(k + 2)
        value = F.when(more, value + F.shiftleft(b.bitwiseAND(127), 6 + 7 * k)).otherwise(value)
        more = more & (b.bitwiseAND(128) != 0)
    whole = F.when(~more & (value <= 0x7FFFFFFF), value)
    return F.when(first.bitwiseAND(128) != 0, -whole).otherwise(whole).cast("int")


def parse_header(data: bytes) -> dict:
    """Engine family and version of a package by its first bytes; what can't be read is named, never guessed."""
    if len(data) < 8:
        return {"status": "truncated", "engine": None, "version": None, "licensee": None, "names": None}
    tag, word = struct.unpack_from("<Ii", data)
    if tag != MAGIC:
        return {"status": "bad_tag", "engine": None, "version": None, "licensee": None, "names": None}
    if word < 0:
        return {"status": "ok", "engine": "UE5" if word <= -8 else "UE4", "version": word, "licensee": None, "names": None}
    version, licensee = word & 0xFFFF, word >> 16
    engine = "UE3" if 334 <= version <= 867 else "UE2" if 100 <= version <= 199 else "UE1" if 34 <= version <= 99 else None
    names = struct.unpack_from("<i", data, 12)[0] if len(data) >= 16 else None
    return {"status": "ok" if engine else "unknown_version", "engine": engine, "version": version, "licensee": licensee, "names": names}


def _little(data: Column, at: int) -> Column:
    """The signed 32-bit number at a byte, null where the data end before it."""
    part = F.hex(F.substring(data, at + 1, 4))
    turned = F.concat(*(F.substring(part, k, 2) for k in (7, 5, 3, 1)))
    n = F.when(F.length(part) == 8, F.conv(turned, 16, 10).cast("long"))
    return F.when(n >= 1 << 31, n - (1 << 32)).otherwise(n)


#: Versions of generated headers.
VERSIONS = (33, 60, 69, 118, 128, 400, 864, -4, -7, -8)


def legacy_header(size: Column, key: Column) -> Column:
    """Generated header bytes, some with a bad tag, some cut short."""
    four = lambda n: F.hex(F.concat(*(F.substring(F.unhex(F.lpad(F.hex(n.cast("long").bitwiseAND(0xFFFFFFFF)), 8, "0")), k, 1) for k in (4, 3, 2, 1))))
    version = F.element_at(F.array(*map(F.lit, VERSIONS)), (key % len(VERSIONS) + 1).cast("int"))
    whole = F.concat(four(F.when(key % 13 != 0, F.lit(MAGIC)).otherwise(F.lit(1))), four(version), four(F.lit(0)), four(size))
    return F.unhex(F.when(key % 17 == 0, F.substring(whole, 1, 12)).otherwise(whole))


def probe_headers(rows: DataFrame, data: str) -> DataFrame:
    """parse_header of a binary column as column expressions: rows with status, engine, version, licensee, names added."""
    col = F.col(data)
    read = rows.withColumns({"__tag": _little(col, 0), "__word": _little(col, 4), "__names": _little(col, 12)})
    word, legacy = F.col("__word"), F.col("__word") >= 0
    read = read.withColumn("version", F.when(legacy, word.bitwiseAND(0xFFFF)).otherwise(word).cast("int"))
    version = F.col("version")
    engine = F.when(word <= -8, "UE5").when(word < 0, "UE4").when(version.between(334, 867), "UE3").when(version.between(100, 199), "UE2").when(version.between(34, 99), "UE1")
    read = read.withColumn("engine", engine)
    status = F.when(word.isNull(), "truncated").when(F.col("__tag") != MAGIC - (1 << 32), "bad_tag").when(F.col("engine").isNull(), "unknown_version").otherwise("ok")
    read = read.withColumn("status", status)
    known = F.col("status").isin("ok", "unknown_version")
    out = {"engine": F.when(known, F.col("engine")), "version": F.when(known, version), "licensee": F.when(known & legacy, F.shiftright(word, 16)).cast("int"), "names": F.when(known & legacy, F.col("__names")).cast("int")}
    return read.withColumns(out).drop("__tag", "__word", "__names")


def bwt(data: bytes) -> tuple[bytes, int]:
    """Last column of the sorted rotations (with an end below all bytes left out), and where that end stands."""
    order = sorted(range(len(data) + 1), key=lambda i: data[i:])
    return bytes(data[i - 1] for i in order if i), order.index(0)


def unbwt(last: bytes, end: int) -> bytes:
    n = len(last) + 1
    column = [-1 if i == end else last[i - (i > end)] for i in range(n)]
    order = sorted(range(n), key=lambda i: column[i])
    out, at = bytearray(), order[end]
    for _ in range(n - 1):
        out.append(column[at])
        at = order[at]
    return bytes(out)


def mtf(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for b in data:
        i = table.index(b)
        out.append(i)
        table.insert(0, table.pop(i))
    return bytes(out)


def unmtf(data: bytes) -> bytes:
    table, out = list(range(256)), bytearray()
    for i in data:
        out.append(table[i])
        table.insert(0, table.pop(i))
    return bytes(out)


def rle(data: bytes) -> bytes:
    """Runs of five or more: five copies and a count byte of further ones."""
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while i + n < len(data) and data[i + n] == data[i] and n < 260:
            n += 1
        out += data[i : i + 1] * min(n, 5)
        if n >= 5:
            out.append(n - 5)
        i += n
    return bytes(out)


def unrle(data: bytes) -> bytes:
    out, i, run = bytearray(), 0, 0
    while i < len(data):
        b = data[i]
        run = run + 1 if out and run and out[-1] == b else 1
        out.append(b)
        i += 1
        if run == 5:
            out += bytes([b]) * data[i]
            i, run = i + 1, 0
    return bytes(out)


BLOCK = 4096


def compress(data: bytes) -> bytes:
    """Blocks of (length, end position, bytes): run lengths, block sort, move to front, run lengths."""
    data, out = rle(data), bytearray()
    for i in range(0, len(data), BLOCK):
        last, end = bwt(data[i : i + BLOCK])
        body = rle(mtf(last))
        out += struct.pack("<II", len(body), end) + body
    return bytes(out)


def decompress(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n, end = struct.unpack_from("<II", data, at)
        out += unbwt(unmtf(unrle(data[at + 8 : at + 8 + n])), end)
        at += 8 + n
    return unrle(bytes(out))


@F.pandas_udf(T.StructType().add("bytes_in", T.IntegerType()).add("bytes_out", T.IntegerType()).add("equal", T.BooleanType()))
def _round_trip(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        data = (x or "").encode()
        packed = compress(data)
        rows.append((len(data), len(packed), decompress(packed) == data))
    return pd.DataFrame(rows, columns=["bytes_in", "bytes_out", "equal"])


def redirect_round_trip(text: Column) -> Column:
    return _round_trip(text)
