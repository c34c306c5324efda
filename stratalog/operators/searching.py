"""Staged search."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{8}){3}")
HEX = re.compile(r"[0-9a-fA-F]+")


def identity_column(text: str) -> str | None:
    """Which identity a query names by its shape: sha1, guid or md5."""
    if GUID.fullmatch(text):
        return "guid"
    if HEX.fullmatch(text):
        return {40: "sha1", 32: "md5"}.get(len(text))
    return None


def staged(rows: DataFrame, row_id: str, stages: list[tuple[str, Column]]) -> DataFrame:
    """row_id, stage (the first that fits, from 1) and all matched fields, in one scan; each condition is computed once."""
    hits = [F.when(c, F.struct(F.lit(i).alias("stage"), F.lit(name).alias("field"))) for i, (name, c) in enumerate(stages, 1)]
    found = rows.select(row_id, F.array_compact(F.array(*hits)).alias("__hits")).where(F.size("__hits") > 0)
    return found.select(row_id, F.get("__hits", F.lit(0))["stage"].alias("stage"), F.array_join(F.transform("__hits", lambda h: h["field"]), ",").alias("fields"))


def _starts(term: str):
    return lambda token: token.startswith(term)


def token_prefix(text: Column, terms: list[str], most: int = 8) -> Column:
    """If each term (of four letters or more, at most eight of them) begins some token of the text; no term, no hit."""
    terms = [t.lower() for t in terms if len(t) >= 4][:most]
    if not terms:
        return F.lit(False)
    tokens = F.split(F.lower(text), r"[^\p{L}\p{N}_]+")
    return reduce(lambda a, b: a & b, (F.exists(tokens, _starts(term)) for term in terms))
