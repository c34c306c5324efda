"""Keyset paging: predicates over mixed orders, pages in four directions, signed cursors."""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

Sort = list[tuple[str, bool]]  # (column, ascending), made total by a unique last column


@dataclass(frozen=True)
class Page:
    """Rows in display order, whether more lie on either side, and the cursors of the first and last row (None: no rows)."""

    rows: list[Row]
    has_previous: bool
    has_next: bool
    first: list | None
    last: list | None


def order(sort: Sort, reverse: bool = False) -> list[Column]:
    """Nulls are the smallest values of a column."""
    return [F.col(c).asc_nulls_first() if up != reverse else F.col(c).desc_nulls_last() for c, up in sort]


def beyond(sort: Sort, cursor: list, after: bool = True) -> Column:
    """Rows after (before) the cursor in the order of mixed directions, with nulls as the smallest values.

    From the last column to the first: a row is beyond if its column is, or if it is equal and the rest is beyond."""
    found = F.lit(False)
    for (c, up), v in reversed(list(zip(sort, cursor, strict=True))):
        col = F.col(c)
        if up == after:
            step = col.isNotNull() if v is None else col > F.lit(v)
        else:
            step = F.lit(False) if v is None else (col < F.lit(v)) | col.isNull()
        found = F.coalesce(step, F.lit(False)) | (col.eqNullSafe(F.lit(v)) & found)
    return found


def page(rows: DataFrame, sort: Sort, size: int, cursor: list | None = None, direction: str = "next") -> DataFrame:
    """One page in display order: first, next, prev or last."""
    back = direction in ("prev", "last")
    if cursor is not None and direction in ("next", "prev"):
        rows = rows.where(beyond(sort, cursor, not back))
    top = rows.orderBy(*order(sort, back)).limit(size)
    return top.orderBy(*order(sort)) if back else top


def last_size(total: int, size: int) -> int:
    """Rows of the last page of an offset list."""
    return total % size or min(size, total)


def fetch(rows: DataFrame, sort: Sort, size: int, cursor: list | None = None, direction: str = "first") -> Page:
    """A page with what the reader needs to go on: one row more than shown is taken, and tells if there are others.

    A list has rows before a page that was reached forwards from a cursor, and behind one that was reached backwards."""
    back = direction in ("prev", "last")
    got = page(rows, sort, size + 1, cursor, direction).collect()  # a page and a row
    more = len(got) > size
    got = got[-size:] if back else got[:size]
    names = [c for c, _ in sort]
    ends = [[r[c] for c in names] for r in (got[:1] + got[-1:])]
    came = cursor is not None and direction in ("next", "prev")
    return Page(got, more if back else came, came if back else more, *(ends or (None, None)))


def sign(cursor: list, context: str, key: bytes) -> str:
    body = json.dumps([context, cursor], default=str, separators=(",", ":")).encode()
    return base64.urlsafe_b64encode(hmac.new(key, body, hashlib.sha256).digest() + body).rstrip(b"=").decode()


def verify(token: str, context: str, key: bytes) -> list:
    raw = base64.urlsafe_b64decode(token + "=" * (-len(token) % 4))
    if not hmac.compare_digest(raw[:32], hmac.new(key, raw[32:], hashlib.sha256).digest()):
        raise ValueError("the cursor isn't signed by this key")
    bound, cursor = json.loads(raw[32:])
    if bound != context:
        raise ValueError("the cursor belongs to another list")
    return cursor
