"""BPE encoding and decoding with forced-boundary splitting.

A byte pair that occurs inside no vocabulary token can never be merged over, so it marks a cut: what lies on its two
sides can be encoded on its own and the identifiers set end to end. Two kinds of pair are cut at. A pair with a blank, or
of characters that the file's own pattern parts, occurs in no token, so a text falls apart into pre-tokens; and inside
these, in the byte alphabet of the vocabulary, each pair outside the set of pairs seen in tokens is a cut. Fragments are
encoded by the merges of the public vocabulary file (the word-end mark goes to the last fragment of a pre-token alone).
They are kept in tables of bounded size, as are the results of whole pre-tokens, which repeat often.

The result equals that of the tokenizers library for the vocabulary file given, special tokens written in the text
included; their strings are cut out of the text before anything else, as the library does. Decoding joins the tokens of
the identifiers in the way of the file, which has no decoder: with single blanks between them.

Defined cases: null and empty texts have no identifiers and decode to the empty text; characters without a token (there
are none in a byte-level file) would be dropped, as without an unknown token the library does; rows are encoded on their
own, so repeats and ties are equal; no rows give no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import sys
from array import array
from collections.abc import Iterator
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4
#: Entries of a worker's table of pre-tokens before it becomes the older generation, which is looked at on a miss and
#: dropped when the next one is full: so words in use stay, in bounded memory.
PIECES = 500_000
#: Entries of the tables of fragments and of pre-tokens outside Latin-1 before they are emptied.
FRAGMENTS = 100_000
#: Pre-tokens that are looked up in one go.
PARTS = 4096
#: Blanks of the library's \s beyond the six common ones, within Latin-1, and controls that it may judge differently.
_ODD = re.compile("[\x1c-\x1f\x80-\xa0]")
#: The pre-tokens of a text in Latin-1, for files that split by _PATTERN. Letters and numbers of Latin-1 and the endings
#: after an apostrophe are fixed values.
_LETTERS, _DIGITS = "a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_LATIN = re.compile(f"'(?:s|t|re|ve|m|ll|d)|[{_LETTERS}]+|[{_DIGITS}]|[^ \t-\r{_LETTERS}{_DIGITS}]+")
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class Codec:
    """Encodes and decodes by one vocabulary file."""

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer, models

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, merges, end = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or ""
        self.last = models.BPE(vocab, merges, end_of_word_suffix=end or None)
        self.inner = models.BPE(vocab, merges)
        self.end = end
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {i: t for t, i in (vocab | self.special).items()}
        bare = [t[: -len(end)] if end and t.endswith(end) else t for t in vocab]
        self.inside = {t[i : i + 2] for t in bare for i in range(len(t) - 1)}
        self.cut_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_start = os.path.commonprefix(list(self.special))  # what a text must hold for a special token to be in it
        self.names = [self.tokens.get(i, "") for i in range(max(self.tokens) + 1)]
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that the byte alphabet writes as themselves
        hidden = [b for b in range(256) if b not in visible]
        self.alphabet = {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.spelled: dict[str, bytes] = {}
        self.fragments: dict[str, list[int]] = {}
        split = json.dumps(spec["pre_tokenizer"])
        self.latin = json.dumps(_PATTERN) in split and [n["type"] for n in spec["normalizer"]["normalizers"]] == ["NFC", "Replace", "Lowercase"]

    def _tokenize(self, text: str, table: dict, model) -> list[int]:
        if len(table) >= FRAGMENTS:
            table.clear()
        got = table[text] = [t.id for t in model.tokenize(text)]
        return got

    def word(self, piece: str) -> list[int]:
        """Identifiers of one pre-token in the byte alphabet."""
        inside = self.inside
        if inside.issuperset(map(add, piece, piece[1:])):  # no cut: most words
            return [t.id for t in self.last.tokenize(piece)]
        start, ids = 0, []
        for i, pair in enumerate(map(add, piece, piece[1:]), 1):
            if pair not in inside:
                cut = piece[start:i]
                ids += self.fragments.get(cut) or self._tokenize(cut, self.fragments, self.inner)
                start = i
        cut = piece[start:] if start else piece
        return ids + [t.id for t in self.last.tokenize(cut)]

    def _new(self, piece: str) -> bytes:
        """A pre-token that isn't in the newer table."""
        if len(self.pieces) >= PIECES:
            self.pieces, self.older = {}, self.pieces
        got = self.older.get(piece)
        if got is None:
            ids = self.word(piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.alphabet))
            got = array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()
        self.pieces[piece] = got
        return got

    def _plain(self, text: str) -> list[bytes]:
        new, found = self._new, []
        if self.latin and _latin(text) and not _ODD.search(text):  # composed already, and lower() works by single characters
            parts = _LATIN.findall(text.lower())
        else:
            normal = self.library.normalizer.normalize_str(text)
            return [self._spelled(p) for chunk in normal.split(" ") if chunk for p, _ in self.library.pre_tokenizer.pre_tokenize_str(chunk)]
        for i in range(0, len(parts), PARTS):
            get = self.pieces.get  # the table may have been changed for a new one
            found += [get(p) or new(p) for p in parts[i : i + PARTS]]
        return found

    def _spelled(self, piece: str) -> bytes:
        """A pre-token in the byte alphabet."""
        got = self.spelled.get(piece)
        if got is None:
            if len(self.spelled) >= FRAGMENTS:
                self.spelled.clear()
            got = self.spelled[piece] = np.array(self.word(piece), "<u4").tobytes()
        return got

    def encode(self, text: str) -> bytes:
        """Identifiers as little-endian unsigned 32-bit integers."""
        if self.cut_special and self.special_start in text and self.cut_special.search(text):
            found = []
            for part in self.cut_special.split(text):
                if part in self.special:
                    found.append(self.special[part].to_bytes(4, "little"))
                elif part:
                    found += self._plain(part)
        else:
            found = self._plain(text)
        return b"".join(found)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    """One codec a Python worker and file."""
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


_OUT = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])
_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


def encode(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit integers) and the decoded text of every row."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(vocabulary_path(vocabulary))
        for batch in it:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield batches(_OUT, [batch.column(0), ids, [c.decode(x) for x in ids]])

    return docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, ids binary, decoded string")


def digest(docs: DataFrame, ident: str = "doc_id", text: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """doc_id, n_tokens and the hashes of identifiers and of the text that they decode to; made where the rows are read."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, sha = codec(vocabulary_path(vocabulary)), hashlib.sha256
        for batch in it:
            ids = [c.encode(t or "") for t in batch.column(1).to_pylist()]
            yield batches(_DIGEST, [batch.column(0), [len(x) // 4 for x in ids], [sha(x).hexdigest() for x in ids], [sha(c.decode(x).encode()).hexdigest() for x in ids]])

    return docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
