"""Block codecs by name, chunked and tagged zlib of redirect files, and the LZO1X decoder.

``decode`` never returns bytes of a wrong length: a block that does not give the stated size is an error.
"""

from __future__ import annotations

import struct
import zlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a block of chunked zlib, and the tag of the tagged form. Fixed values.
CHUNK, TAG = 32768, 5678


def lzo1x(data: bytes, size: int) -> bytes:
    """Unpacks an LZO1X stream of a known unpacked size.

    A stream is a chain of (match, literals) instructions. What an instruction byte below 16 means depends on how many
    literals came before it: none, 1 to 3, or a long run; the state is kept in ``lits``."""
    out, at = bytearray(), 0

    def count(base: int) -> int:
        """A length spelled by zero bytes of 255 each and a last byte."""
        nonlocal at
        n = base
        while data[at] == 0:
            n, at = n + 255, at + 1
        at += 1
        return n + data[at - 1]

    def literals(n: int) -> None:
        nonlocal at
        if at + n > len(data):
            raise ValueError("truncated")
        out.extend(data[at : at + n])
        at += n

    def copy(distance: int, n: int) -> None:
        if distance > len(out):
            raise ValueError("bad distance")
        if distance >= n:
            out.extend(out[len(out) - distance : len(out) - distance + n])
        else:  # overlapping: the last bytes repeat
            tail = bytes(out[-distance:])
            out.extend((tail * (n // distance + 1))[:n])

    try:
        lits = 0
        if data[0] > 17:
            at, lits = 1, data[0] - 17
            literals(lits)
            lits = min(lits, 4)
        while True:
            op = data[at]
            at += 1
            if op >= 64:
                distance, n, lits = (data[at] << 3) + (op >> 2 & 7) + 1, (op >> 5) + 1, op & 3
                at += 1
            elif op >= 16:
                far = op < 32
                n = (op & (7 if far else 31)) or count(7 if far else 31)
                word = data[at] | data[at + 1] << 8
                at += 2
                distance, n, lits = (word >> 2) + (16384 + ((op & 8) << 11) if far else 1), n + 2, word & 3
                if far and distance == 16384:
                    break
            elif lits == 0:
                literals((op or count(15)) + 3)
                lits = 4
                continue
            else:
                distance, n, lits = (data[at] << 2) + (op >> 2) + (2049 if lits == 4 else 1), 3 if lits == 4 else 2, op & 3
                at += 1
            copy(distance, n)
            literals(lits)
            if len(out) > size:
                raise ValueError("longer than stated")
    except IndexError:
        raise ValueError("truncated") from None
    if len(out) != size:
        raise ValueError("shorter than stated")
    return bytes(out)


def decode(method: str, data: bytes, size: int) -> bytes:
    """A block by the name of its codec; a codec without a public description is named as unsupported."""
    method = method.lower()
    if method in ("", "none"):
        out = data
    elif method in ("zlib", "gzip"):
        unpack = zlib.decompressobj(31 if method == "gzip" else 15)
        try:
            out = unpack.decompress(data, size + 1)
        except zlib.error as e:
            raise ValueError(str(e)) from None
    elif method in ("lzo", "lzo1x"):
        out = lzo1x(data, size)
    else:
        raise ValueError(f"unsupported codec {method}")
    if len(out) != size:
        raise ValueError(f"{len(out)} bytes instead of {size}")
    return out


def write_chunked(data: bytes) -> bytes:
    """Blocks of (packed size, size, zlib bytes)."""
    out = bytearray()
    for i in range(0, len(data), CHUNK):
        block = data[i : i + CHUNK]
        packed = zlib.compress(block)
        out += struct.pack("<II", len(packed), len(block)) + packed
    return bytes(out)


def read_chunked(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        if at + 8 > len(data):
            raise ValueError("truncated")
        packed, size = struct.unpack_from("<II", data, at)
        if size > CHUNK:
            raise ValueError("block too large")
        out += decode("zlib", data[at + 8 : at + 8 + packed], size)
        at += 8 + packed
    return bytes(out)


def write_tagged(data: bytes) -> bytes:
    """The tag, the whole size, one zlib stream."""
    return struct.pack("<II", TAG, len(data)) + zlib.compress(data)


def read_tagged(data: bytes) -> bytes:
    if len(data) < 8 or struct.unpack_from("<I", data)[0] != TAG:
        raise ValueError("bad tag")
    return decode("zlib", data[8:], struct.unpack_from("<I", data, 4)[0])


@F.pandas_udf(T.StructType().add("bytes_in", T.LongType()).add("chunked", T.LongType()).add("tagged", T.LongType()).add("equal", T.BooleanType()))
def _round_trip(s: pd.Series) -> pd.DataFrame:
    rows = []
    for x in s:
        data = (x or "").encode()
        a, b = write_chunked(data), write_tagged(data)
        rows.append((len(data), len(a), len(b), read_chunked(a) == data == read_tagged(b)))
    return pd.DataFrame(rows, columns=["bytes_in", "chunked", "tagged", "equal"])


def zlib_round_trip(text: Column) -> Column:
    return _round_trip(text)
