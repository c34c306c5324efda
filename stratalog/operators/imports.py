"""Outer chains of imports, local to a file."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame

MAX_HOPS = 128


def chain(names: dict[int, str], outers: dict[int, int], index: int) -> str | None:
    """Dotted path from the root; None for cycles, lost parents and chains over MAX_HOPS."""
    parts, seen = [], set()
    while index:
        if index in seen or index not in names or len(parts) >= MAX_HOPS:
            return None
        seen.add(index)
        parts.append(names[index])
        index = outers[index]
    return ".".join(reversed(parts))


def outer_paths(imports: DataFrame) -> DataFrame:
    """file_id, index, path of every import; a task holds one file's table."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, outers = dict(zip(pdf["index"], pdf["object_name"], strict=True)), dict(zip(pdf["index"], pdf["outer_index"], strict=True))
        return pd.DataFrame({"file_id": pdf["file_id"], "index": pdf["index"], "path": [chain(names, outers, i) for i in pdf["index"]]})

    return imports.groupBy("file_id").applyInPandas(run, "file_id long, index int, path string")
