"""Elias-Fano sequences and flat files of arrays, read through memory maps and searched many values at a time."""

from __future__ import annotations

import json
import os
import uuid

import numpy as np

from .common import store


_AT_ONCE = 1 << 17


def _select_in_word(x: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The place of the k-th set bit (from 0) of each word."""
    place, k = np.zeros(len(x), np.int64), k.astype(np.int64)
    for s in (32, 16, 8, 4, 2, 1):
        low = x & np.uint64((1 << s) - 1)
        c = np.bitwise_count(low).astype(np.int64)
        go = k >= c
        k = k - c * go
        x = np.where(go, x >> np.uint64(s), low)
        place += s * go
    return place


class EliasFano:
    """A non-decreasing sequence of unsigned numbers: l low bits each, and the rest in unary, about l + 2 bits each."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str = ""):
        self.n, self.l = (int(x) for x in arrays[prefix + "meta"])
        self.low, self.high, self.ones, self.zeros = (arrays[prefix + k] for k in ("low", "high", "ones", "zeros"))
        self.mask = np.uint64((1 << self.l) - 1)

    @staticmethod
    def build(values: np.ndarray, prefix: str = "") -> dict[str, np.ndarray]:
        values = values.astype(np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        l = max(0, (top // max(n, 1)).bit_length() - 1)
        low = np.zeros(n * l // 64 + 2, np.uint64)
        for at in range(0, n if l else 0, _AT_ONCE):  # as many bits as fill whole words
            bits = np.unpackbits(values[at : at + _AT_ONCE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :l].ravel()
            packed = np.packbits(bits, bitorder="little")
            low.view(np.uint8)[at * l // 8 : at * l // 8 + len(packed)] = packed
        place = (values >> np.uint64(l)).astype(np.int64) + np.arange(n)
        flags = np.zeros(((int(place[-1]) if n else 0) // 64 + 2) * 64, np.uint8)
        flags[place] = 1
        high = np.packbits(flags, bitorder="little").view(np.uint64)
        ones = np.cumsum(np.bitwise_count(high), dtype=np.int64)
        zeros = np.arange(1, len(high) + 1, dtype=np.int64) * 64 - ones
        kind = np.uint32 if 64 * len(high) < 1 << 32 else np.int64
        return {prefix + "meta": np.array([n, l], np.int64), prefix + "low": low, prefix + "high": high, prefix + "ones": ones.astype(kind), prefix + "zeros": zeros.astype(kind)}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.l:
            return np.zeros(len(i), np.uint64)
        at = i * self.l
        word, off = at >> 6, (at & 63).astype(np.uint64)
        spill = np.where(off > 0, self.low[word + 1] << ((np.uint64(64) - off) & np.uint64(63)), np.uint64(0))
        return (self.low[word] >> off | spill) & self.mask

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        upto = self.ones if ones else self.zeros
        word = np.searchsorted(upto, k.astype(upto.dtype), side="right")
        before = np.where(word > 0, upto[np.maximum(word - 1, 0)].astype(np.int64), 0)
        bits = self.high[word]
        return word * 64 + _select_in_word(bits if ones else ~bits, k - before)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        high = (self._select(i, True) - i).astype(np.uint64)
        return high << np.uint64(self.l) | self._low(i)

    def find(self, values: np.ndarray, first: np.ndarray | int = 0, stop: np.ndarray | None = None) -> np.ndarray:
        """Where each value stands among the places from first to below stop, or -1: its bucket by the unary part, cut to
        these places, then halving."""
        out = np.full(len(values), -1, np.int64)
        if not self.n or not len(values):
            return out
        h = values >> np.uint64(self.l)
        ok = np.flatnonzero(h < np.uint64(int(self.zeros[-1])))
        h, want = h[ok].astype(np.int64), values[ok] & self.mask
        low, later = np.zeros(len(h), np.int64), h > 0
        low[later] = self._select(h[later] - 1, False) - (h[later] - 1)
        high = np.minimum(self._select(h, False) - h, self.n)
        if stop is not None:
            low, high = np.maximum(low, first[ok]), np.minimum(high, stop[ok])
        some = high > low
        ok, want, low, high = ok[some], want[some], low[some], high[some]
        while len(ok):
            mid = (low + high) >> 1
            got = self._low(mid)
            hit = got == want
            out[ok[hit]] = mid[hit]
            up = got < want
            low, high = np.where(up, mid + 1, low), np.where(up, high, mid)
            more = ~hit & (low < high)
            ok, want, low, high = ok[more], want[more], low[more], high[more]
        return out


def local_path(uri: str) -> str | None:
    """The path of a mounted shared folder, or None where only file-system clients reach it."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def write_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Writes arrays to one file under a name of this attempt, then renames it: retried tasks leave whole files only."""
    at, head = 0, {}
    for k, v in arrays.items():
        head[k] = [v.dtype.str, at, len(v)]
        at += v.nbytes + -v.nbytes % 8
    lead = json.dumps(head).encode()
    lead = len(lead).to_bytes(8, "little") + lead
    lead += bytes(-len(lead) % 8)
    parts = [lead] + [x for v in arrays.values() for x in (np.ascontiguousarray(v).tobytes(), bytes(-v.nbytes % 8))]
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        trial = f"{path}.{uuid.uuid4().hex}"
        with open(trial, "wb") as f:
            f.writelines(parts)
        os.replace(trial, path)
        return
    files, name = store(uri)
    trial = f"{name}.{uuid.uuid4().hex}"
    with files.open_output_stream(trial) as f:
        for x in parts:
            f.write(x)
    files.move(trial, name)


def read_arrays(uri: str) -> dict[str, np.ndarray]:
    """Arrays of a file, as views of a memory map (of its bytes, where the folder isn't mounted)."""
    path = local_path(uri)
    if path is not None:
        raw = np.memmap(path, np.uint8, "r").view(np.ndarray)
    else:
        files, name = store(uri)
        with files.open_input_stream(name) as f:
            raw = np.frombuffer(f.read(), np.uint8)
    n = int.from_bytes(raw[:8].tobytes(), "little")
    head, base = json.loads(raw[8 : 8 + n].tobytes()), 8 + n + -(8 + n) % 8
    return {k: raw[base + at : base + at + size * np.dtype(t).itemsize].view(t) for k, (t, at, size) in head.items()}
