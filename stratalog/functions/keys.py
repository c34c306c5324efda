"""Identity keys as column expressions: names, paths, stems, hashes. Joins are made on these, never on raw names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What trimming strips: blank, tab, line feed, carriage return, NUL, vertical tab.
TRIMMED = r"^[ \t\n\r\x00\x0B]+|[ \t\n\r\x00\x0B]+$"
ZERO_GUID = "00000000-00000000-00000000-00000000"


def trim(s: Column) -> Column:
    return F.regexp_replace(s, TRIMMED, "")


def fname_key(s: Column) -> Column:
    return F.lower(s)


def name_key(s: Column) -> Column:
    return F.lower(trim(s))


def path_key(s: Column) -> Column:
    """Dotted path: empty parts go, parts are trimmed, all lower-cased."""
    return F.lower(F.array_join(F.filter(F.transform(F.split(s, r"\."), trim), lambda p: p != ""), "."))


def stem_key(filename: Column) -> Column:
    """File name without its last extension, as a name key."""
    return name_key(F.regexp_replace(filename, r"\.[^.]*$", ""))


def package_key(name: Column, kind: int) -> Column:
    """Kind 1 hashes the trimmed name, kind 3 the exact one; kind 2 is a raw package identifier in hex."""
    return {1: F.md5(name_key(name).cast("binary")), 3: F.md5(fname_key(name).cast("binary")), 2: F.lower(name)}[kind]


def triple_hash(obj: Column, cls: Column, cls_package: Column, trimmed: bool = True) -> Column:
    key = name_key if trimmed else fname_key
    return F.md5(F.concat_ws("\u0000", key(obj), key(cls), key(cls_package)).cast("binary"))


def dictionary_key(name: Column) -> Column:
    k = name_key(name).cast("binary")
    return F.struct(F.md5(k).alias("hash"), F.octet_length(k).alias("length"), F.sha2(k, 256).alias("fingerprint"))


def natural_key(s: Column) -> Column:
    """Sort key under which a2 comes before a10: case and leading zeros are ignored, and a run of digits is led by its
    length. The length is led by its own length, so runs of any length compare right."""
    runs = F.regexp_extract_all(F.lower(s), F.lit(r"(\d+|\D+)"), F.lit(1))
    bare = lambda r: F.regexp_replace(r, r"^0+(?=\d)", "")
    size = lambda r: F.length(bare(r)).cast("string")
    led = F.transform(runs, lambda r: F.when(r.rlike(r"^\d"), F.concat(F.length(size(r)).cast("string"), size(r), bare(r))).otherwise(r))
    return F.array_join(led, "")


def is_public(flags: Column, engine: int) -> Column:
    """The public bit of an export: bit 34 in engine 3, else bit 0."""
    bit = 1 << 34 if engine == 3 else 1
    return flags.bitwiseAND(F.lit(bit)) != 0


def display_status(payload: Column, status: Column) -> Column:
    """The status that a job's payload overrides; broken JSON never fails."""
    return F.coalesce(F.get_json_object(payload, "$.display_status"), status)


def error_fingerprint(message: Column) -> Column:
    """Hash of a message in which numbers, hex runs and quoted names are placeholders."""
    m = F.regexp_replace(F.lower(message), "'[^']*'|\"[^\"]*\"", "{name}")
    m = F.regexp_replace(m, "0x[0-9a-f]+|[0-9a-f]{16,}", "{hex}")
    m = F.regexp_replace(m, "[0-9]+", "{id}")
    return F.sha2(F.trim(F.regexp_replace(m, "[ \\t\\r\\n]+", " ")), 256)


def retry_delay(attempt: Column, deterministic: Column) -> Column:
    """Seconds: none after a deterministic failure, else two to the power of attempts, 8 at most."""
    return F.when(deterministic, F.lit(0)).otherwise(F.pow(F.lit(2.0), F.least(F.lit(8), attempt)).cast("int"))


def quick_fingerprint(data: Column, window: int = 65536) -> Column:
    """SHA-256 over the size and the hex of five windows: at the start, a quarter, the middle, three quarters and the end."""
    h, n = F.hex(data), F.octet_length(data)
    at = [F.lit(0), F.floor(n / 4), F.floor(n / 2), F.floor(n * 3 / 4), F.greatest(F.lit(0), n - window)]
    parts = [F.substr(h, (2 * a + 1).cast("int"), F.lit(2 * window)) for a in at]
    return F.sha2(F.concat_ws(":", n.cast("string"), *parts).cast("binary"), 256)
