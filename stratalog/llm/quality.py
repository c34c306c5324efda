"""Quality rules, lines first.

Each line with a word is judged by rules for
    punctuation   symbols or exclamation marks against words; eight words or more without a mark at the end
    capitals      more than 70 % of the letters A-Z and a-z
    navigation    separators between words, links, and runs of three or more short lines without a mark at the end
    boilerplate   lines seen before in the text, stock phrases, words said again and again
Failing lines go; a document that loses more than ``max_lost`` of the code points in its words is rejected, as is one that
fails the two base rules: fewer than 10 words, or over 20 % of the words in 5-word windows that occur more than once.
``keep_good`` (the pipeline's stage) rejects documents and hands the others on as they are; ``cleaned`` gives the texts
without their failing lines.

Defined cases: a null text has no words and fails; an empty or blank one too; equal lines count as boilerplate from the
second on; rows are judged on their own, so repeated rows get equal results; no rows give no rows; further columns are
ignored by ``judge`` and kept by ``keep_good``. A text is held whole by one task, with its words, its different lines and,
over MANY words, eight arrays of a number a word.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, byte_lists

SYMBOLS = b"#*$%&|<>"
#: Stock phrases of boilerplate lines, in lower case. Fixed values.
PHRASES = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of service", "terms of use", "subscribe to our", "click here", "sign in to", "licensed under", "copyright (c)",
    "alle rechte vorbehalten", "datenschutzerklärung", "allgemeine geschäftsbedingungen",
    "tous droits réservés", "politique de confidentialité", "mentions légales",
    "todos los derechos reservados", "política de privacidad", "aviso legal",
)
#: What a sentence may end with, and words that part entries of a menu. Fixed values.
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "…", "»", "”", "。", "！", "？")
SEPARATORS = ("|", "/", ">", "»", "·", "•", "-", "–", "—")
#: Words of a line that must end with a mark, and most of one that counts as short; lines of a run of these.
MUST_END, SHORT, RUN = 8, 3, 3
MANY = 2000
MAX_LOST = 0.5
_PHRASE = re.compile(b"|".join(re.escape(p.encode()) for p in PHRASES))
_ENDS, _SEPARATORS = tuple(x.encode() for x in ENDS), frozenset(x.encode() for x in SEPARATORS)
_UPPER, _LOWER = bytes(range(65, 91)), bytes(range(97, 123))
_OUT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("lost_chars", pa.int64())])
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, lost_chars long"


def _points(data: bytes) -> int:
    return len(data) if data.isascii() else len(data.decode("utf-8", "replace"))


def _count(data: bytes, what: bytes) -> int:
    return len(data) - len(data.translate(None, what))


def line_fails(line: bytes, words: list[bytes], ended: bool) -> bool:
    """If a line (with words) fails a rule that looks at it alone."""
    n = len(words)
    if 10 * _count(line, SYMBOLS) > 3 * n or 2 * line.count(b"!") > n or n >= MUST_END and not ended:
        return True
    upper = _count(line, _UPPER)
    if n >= 3 and 10 * upper > 7 * (upper + _count(line, _LOWER)):
        return True
    parted = sum(w in _SEPARATORS for w in words)
    if parted >= 2 and 3 * parted >= n:
        return True
    if (b"://" in line or b"www." in line) and 2 * sum(b"://" in w or w.startswith(b"www.") for w in words) >= n:
        return True
    if n >= 4 and 3 * sum(map(eq, words, words[1:])) >= n:
        return True
    return _PHRASE.search(line.lower()) is not None


def repeated(words: list[bytes], size: int = 5) -> int:
    """How many words lie in windows of ``size`` words that occur twice or more."""
    if len(words) > MANY:
        return _repeated_many(words, size)
    windows = list(zip(*(words[i:] for i in range(size)), strict=False))
    if len(set(windows)) == len(windows):
        return 0
    times, total, end = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if times[w] > 1:
            total += i + size - max(i, end)
            end = i + size
    return total


def _repeated_many(words: list[bytes], size: int) -> int:
    """The same over numbers: windows are ranked one word longer at a time."""
    number: dict[bytes, int] = {}
    one = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    rank = one
    for k in range(1, size):
        _, rank = np.unique(rank[:-1] * len(number) + one[k:], return_inverse=True)
    again = np.bincount(rank)[rank] > 1
    inside = np.zeros(len(words) + 1, np.int64)
    np.add.at(inside, np.flatnonzero(again), 1)
    np.add.at(inside, np.flatnonzero(again) + size, -1)
    return int((np.cumsum(inside) > 0).sum())


def clean_lines(data: bytes) -> tuple[list[bytes], int, int]:
    """The lines that stay, how many repeat an earlier one, and code points of the words in lines that go."""
    seen: set[bytes] = set()
    lines = [(line, line.split()) for line in data.split(b"\n")]
    full = [k for k, (_, words) in enumerate(lines) if words]
    ended = [lines[k][0].rstrip().endswith(_ENDS) for k in full]
    short = [len(lines[k][1]) <= SHORT and not e for k, e in zip(full, ended, strict=True)]
    fails, dup, lost, begin = set(), 0, 0, 0
    for i, s in enumerate([*short, False]):  # runs of short lines
        if not s:
            if i - begin >= RUN:
                fails.update(full[begin:i])
            begin = i + 1
    for k, e in zip(full, ended, strict=True):
        line, words = lines[k]
        again = line in seen
        dup += again
        seen.add(line)
        if again or k in fails or line_fails(line, words, e):
            fails.add(k)
            lost += _points(b"".join(words))
    return [line for k, (line, _) in enumerate(lines) if k not in fails], dup, lost


def measure(data: bytes, max_lost: float = MAX_LOST) -> tuple:
    words = data.split()
    n, chars = len(words), _points(b"".join(words))
    _, dup, lost = clean_lines(data)
    rep = repeated(words)
    failed = n < 10 or 100 * rep > 20 * n
    return n, chars, _count(data, SYMBOLS), dup, rep, failed, not failed and lost <= max_lost * chars, lost


def _judge(max_lost: float):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            found = [measure(x, max_lost) for x in byte_lists(batch, 1)]
            if found:
                yield batches(_OUT, [batch.column(0), *(list(c) for c in zip(*found, strict=True))])

    return run


def judge(docs: DataFrame, ident: str = "doc_id", text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    return docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(_judge(max_lost), _SCHEMA)


def keep_good(docs: DataFrame, text: str = "text", max_lost: float = MAX_LOST) -> DataFrame:
    """The rows of docs that are kept, with their columns, in one pass and without a shuffle."""
    at = docs.columns.index(text)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batch.filter(pa.array([measure(x, max_lost)[6] for x in byte_lists(batch, at)], type=pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def cleaned(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and clean_text: each text without the lines that fail."""
    out = pa.schema([("doc_id", pa.int64()), ("clean_text", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            yield batches(out, [batch.column(0), [b"\n".join(clean_lines(x)[0]).decode("utf-8", "replace") for x in byte_lists(batch, 1)]])

    return docs.select(F.col(ident).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, clean_text string")
