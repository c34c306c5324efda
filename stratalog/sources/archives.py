"""Entries of archives (zip, mod containers, paks) and their bytes, from what binaryFile delivers.

Each kind has ``list_*`` (entries with path, size, offset, method and status) and is read by ``entry_bytes``. An entry
that can't be read keeps its row with the reason in status: encrypted, a codec without a decoder, an unsafe path, or a
place outside the file. Archives of 2 GB and more exceed what binaryFile hands to a task.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .binary import write_compact_index
from .codecs import decode
from .packages import Broken, Cursor

PAK_MAGIC, MOD_MAGIC = 0x5A6F12E1, 0x9FE3C5A3
#: Bytes from a pak's magic to its end, by what stands there: old; four, five names; five names and a frozen mark.
PAK_FOOTERS = (44, 172, 204, 205)
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_ENTRY = pa.schema([("path", pa.string()), ("kind", pa.string()), ("entry", pa.string()), ("size", pa.int64()), ("packed", pa.int64()), ("offset", pa.int64()), ("method", pa.string()), ("status", pa.string())])
ENTRY = "path string, kind string, entry string, size long, packed long, offset long, method string, status string"


def crc_forward(data: bytes) -> int:
    """CRC-32 with the highest bit first: the usual one over mirrored bytes, mirrored."""
    return int(f"{zlib.crc32(data.translate(_REVERSED)):032b}"[::-1], 2)


def safe(path: str) -> bool:
    """If a member stays below the folder it is unpacked to."""
    parts = path.replace("\\", "/").split("/")
    return bool(path) and ".." not in parts and ":" not in path and "\0" not in path and parts[0] != ""


def _row(entry: str, size: int, packed: int, offset: int, method: str, status: str = "ok", **more) -> dict:
    return {"entry": entry, "size": size, "packed": packed, "offset": offset, "method": method, "status": status if safe(entry) or status != "ok" else "unsafe_path", **more}


def list_zip(data: bytes) -> list[dict]:
    methods = {0: "none", 8: "deflate"}
    try:
        infos = zipfile.ZipFile(io.BytesIO(data)).infolist()
    except (zipfile.BadZipFile, ValueError) as e:
        raise Broken("bad_zip") from e
    return [_row(i.filename, i.file_size, i.compress_size, i.header_offset, methods.get(i.compress_type, str(i.compress_type)), "encrypted" if i.flag_bits & 1 else "ok" if i.compress_type in methods else "unsupported_method") for i in infos if not i.is_dir()]


def list_mod(data: bytes) -> list[dict]:
    """A table at the end: count, then (path, offset, size, flags); a footer with magic, table, size, version and checksum."""
    if len(data) < 20:
        raise Broken("truncated")
    magic, table, size, version, crc = struct.unpack_from("<IiiiI", data, len(data) - 20)
    if magic != MOD_MAGIC:
        raise Broken("bad_tag")
    if version != 1 or size != len(data) or not 0 <= table < size - 20:
        raise Broken("bad_footer")
    if crc_forward(data[:-20]) != crc:
        raise Broken("bad_checksum")
    c, out = Cursor(data[:-20], table), []
    for _ in range(c.compact()):
        path, offset, n, _ = c.sized(c.compact()), c.num("I"), c.num("I"), c.num("I")
        out.append(_row(path, n, n, offset, "none", "ok" if offset + n <= table else "outside"))
    return out


def write_mod(members: dict[str, bytes]) -> bytes:
    out, places = bytearray(), {}
    for path, body in members.items():
        places[path] = len(out)
        out += body
    table = len(out)
    out += write_compact_index(len(members))
    for path, body in members.items():
        out += write_compact_index(len(path) + 1) + path.encode("latin-1") + b"\0" + struct.pack("<III", places[path], len(body), 0)
    return bytes(out) + struct.pack("<IiiiI", MOD_MAGIC, table, len(out) + 20, 1, crc_forward(bytes(out)))


def _pak_footer(data: bytes) -> tuple[int, int, int, list[str], bool]:
    """Version, index offset and size, codec names, whether the index is encrypted."""
    for n in PAK_FOOTERS:
        at = len(data) - n
        if at < 0 or struct.unpack_from("<I", data, at)[0] != PAK_MAGIC:
            continue
        version, offset, size = struct.unpack_from("<iqq", data, at + 4)
        if 1 <= version <= 11 and offset >= 0 and size > 0 and offset + size <= len(data):
            names = [x.rstrip(b"\0").decode("latin-1") for x in struct.iter_unpack("32s", data[len(data) - (n - 44) // 32 * 32 :]) for x in x] if n > 44 else []
            return version, offset, size, names, version >= 4 and at >= 1 and data[at - 1] == 1
    raise Broken("no_footer")


def _method(number: int, version: int, names: list[str]) -> str:
    if version < 8:
        return {0: "none", 1: "zlib", 2: "gzip"}.get(number, f"method_{number}")
    return "none" if number == 0 else names[number - 1].lower() if number <= len(names) and names[number - 1] else f"method_{number}"


def _pak_entry(c: Cursor, version: int, names: list[str]) -> dict:
    """An entry as it stands in classic indexes and before its data."""
    offset, packed, size, number = c.num("q"), c.num("q"), c.num("q"), c.num("i")
    if version < 2:
        c.num("q")
    c.take(20)
    blocks, flags, block_size = [], 0, 0
    if version >= 3:
        blocks = [(c.num("q"), c.num("q")) for _ in range(c.num("i"))] if number else []
        flags, block_size = c.num("B"), c.num("I")
    return {"offset": offset, "packed": packed, "size": size, "method": _method(number, version, names), "blocks": blocks, "block_size": block_size, "encrypted": bool(flags & 1)}


def _encoded_entry(c: Cursor, names: list[str]) -> dict:
    """An entry packed into bits, as indexes of versions 10 and 11 have it; its blocks stand before its data as well."""
    bits = c.num("I")
    if bits & 63 == 63:
        c.num("I")
    offset = c.num("I" if bits >> 31 & 1 else "Q")
    size = c.num("I" if bits >> 30 & 1 else "Q")
    number = bits >> 23 & 63
    packed = c.num("I" if bits >> 29 & 1 else "Q") if number else size
    return {"offset": offset, "packed": packed, "size": size, "method": _method(number, 10, names), "encrypted": bool(bits >> 22 & 1)}


def list_pak(data: bytes) -> list[dict]:
    version, offset, size, names, hidden = _pak_footer(data)
    if hidden:
        raise Broken("encrypted_index")
    c = Cursor(data[: offset + size], offset)
    mount, count, found = c.sized(c.num("i")), c.num("i"), []
    if version < 10:
        for _ in range(count):
            path = c.sized(c.num("i"))
            found.append((path, _pak_entry(c, version, names)))
    else:
        c.num("Q")
        if c.num("I"):
            c.take(36)
        if not c.num("I"):
            raise Broken("no_directory")
        place, length = c.num("q"), c.num("q")
        c.take(20)
        packed = c.take(c.num("i"))
        plain = [_pak_entry(c, version, names) for _ in range(c.num("i"))]
        d = Cursor(data[: place + length], place)
        for _ in range(d.num("i")):
            folder = d.sized(d.num("i"))
            for _ in range(d.num("i")):
                path, at = folder.lstrip("/") + d.sized(d.num("i")), d.num("i")
                if at < 0 and -at > len(plain):
                    raise Broken("bad_entry")
                found.append((path, plain[-at - 1] if at < 0 else _encoded_entry(Cursor(packed, at), names)))
    rows = []
    for path, e in found:
        known = e["method"] in ("none", "zlib", "gzip")
        status = "encrypted" if e["encrypted"] else "unsupported_method" if not known else "outside" if e["offset"] + e["packed"] > offset else "ok"
        rows.append(_row(path, e["size"], e["packed"], e["offset"], e["method"], status, mount=mount, version=version, names=names))
    return rows


def pak_bytes(data: bytes, row: dict) -> bytes:
    """The bytes of an entry, by the header before its data."""
    c = Cursor(data, row["offset"])
    e = _pak_entry(c, row["version"], row["names"])
    if e["method"] == "none":
        return c.take(e["size"])
    out, base = bytearray(), row["offset"] if row["version"] >= 5 else 0
    for lo, hi in e["blocks"]:
        out += decode(e["method"], data[base + lo : base + hi], min(e["block_size"], e["size"] - len(out)))
    if len(out) != e["size"]:
        raise Broken("bad_size")
    return bytes(out)


def write_pak(members: dict[str, bytes], version: int = 5, packed: bool = False, block: int = 4096) -> bytes:
    """A pak with a classic index (versions 3 to 9)."""
    out, index = bytearray(), bytearray()
    text = lambda s: struct.pack("<i", len(s) + 1) + s.encode("latin-1") + b"\0"
    index += text("../../../") + struct.pack("<i", len(members))
    for path, body in members.items():
        parts = [zlib.compress(body[i : i + block]) for i in range(0, len(body), block)] if packed else []
        small = b"".join(parts) if packed else body
        start, size = len(out), 57 - 4 + (4 + 16 * len(parts) if packed else 0)
        at = size + (0 if version >= 5 else start)
        places = []
        for p in parts:
            places.append((at, at + len(p)))
            at += len(p)
        entry = lambda o: struct.pack("<qqqi", o, len(small), len(body), int(packed)) + bytes(20) + (struct.pack("<i", len(places)) + b"".join(struct.pack("<qq", *p) for p in places) if packed else b"") + struct.pack("<BI", 0, block if packed else 0)  # noqa: B023, E731
        out += entry(0) + small
        index += text(path) + entry(start)
    footer = (bytes(17) if version >= 7 else bytes(1) if version >= 4 else b"") + struct.pack("<Iiqq", PAK_MAGIC, version, len(out), len(index)) + bytes(20)
    if version >= 8:
        footer += (bytes(1) if version == 9 else b"") + b"Zlib".ljust(32, b"\0") + bytes(128)
    return bytes(out) + bytes(index) + footer


def kind_of(path: str, data: bytes) -> str:
    """By the bytes first; names decide nothing."""
    if data[:4] in (b"PK\x03\x04", b"PK\x05\x06"):
        return "zip"
    if len(data) >= 20 and struct.unpack_from("<I", data, len(data) - 20)[0] == MOD_MAGIC:
        return "mod"
    if any(len(data) >= n and struct.unpack_from("<I", data, len(data) - n)[0] == PAK_MAGIC for n in PAK_FOOTERS):
        return "pak"
    return "7z" if data[:6] == b"7z\xbc\xaf\x27\x1c" else "rar" if data[:4] == b"Rar!" else "unknown"


LISTERS = {"zip": list_zip, "mod": list_mod, "pak": list_pak}


def entry_bytes(kind: str, data: bytes, row: dict) -> bytes:
    if row["status"] != "ok":
        raise Broken(row["status"])
    if kind == "zip":
        return zipfile.ZipFile(io.BytesIO(data)).read(row["entry"])
    return pak_bytes(data, row) if kind == "pak" else Cursor(data, row["offset"]).take(row["size"])


def _list(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_py() or b""
            kind = kind_of(path or "", data)
            try:
                rows = LISTERS[kind](data) if kind in LISTERS else [_row("", 0, 0, 0, "", "unsupported_kind")]
            except Broken as e:
                rows = [_row("", 0, 0, 0, "", str(e))]
            lead = [[path] * len(rows), [kind] * len(rows)]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(lead + [[r[n] for r in rows] for n in _ENTRY.names[2:]], _ENTRY, strict=True)], schema=_ENTRY)


def archive_entries(files: DataFrame) -> DataFrame:
    """Entries of all archives from columns path and content; an archive that can't be read is one row with the reason."""
    return files.select("path", "content").mapInArrow(_list, ENTRY)


def _members(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("status", pa.string())])

    def one(path: str | None, body: bytes | None, status: str) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([body], pa.binary()), pa.array([status])], schema=schema)

    for batch in it:
        for path, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = data.as_py() or b""
            kind = kind_of(path or "", data)
            try:
                rows = LISTERS[kind](data) if kind in LISTERS else None
            except Broken as e:
                yield one(path, None, str(e))
                continue
            if rows is None:
                yield one(path, None, "unsupported_kind")
            for r in rows or []:  # a member at a time
                try:
                    yield one(f"{path}!{r['entry']}", entry_bytes(kind, data, r), "ok")
                except (ValueError, zipfile.BadZipFile, zlib.error) as e:
                    yield one(f"{path}!{r['entry']}", None, str(e))


def archive_members(files: DataFrame) -> DataFrame:
    """path ("archive!entry"), content and status; what doesn't unpack has null content and the reason. Rows that are ok
    are input for the readers again."""
    return files.select("path", "content").mapInArrow(_members, "path string, content binary, status string")
