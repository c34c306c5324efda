"""Pages of the file list."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.paging import order, page
from ..operators.rollup import n_if
from ..registry import query
from ..tables import EDGES_SQL, edges, table

SORT = [("priority", True), ("size", False), ("file_id", True)]
SIZE = 50
CURSOR = ["3-MEDIUM", 250000.0, 0]
_F = "f AS (SELECT o_orderkey AS file_id, o_orderpriority AS priority, o_totalprice AS size, o_orderdate AS uploaded_at FROM orders)"
_ASC, _DESC = "priority, size DESC, file_id", "priority DESC, size, file_id DESC"


def listing(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("priority"), F.col("o_totalprice").alias("size"), F.col("o_orderdate").alias("uploaded_at"))


@query(f"WITH {_F} SELECT * FROM f ORDER BY {_ASC} LIMIT {SIZE}")
def file_page_first(spark, sf):
    return page(listing(spark, sf), SORT, SIZE, None, "first")


@query(f"WITH {_F} SELECT * FROM f WHERE priority > '3-MEDIUM' OR (priority = '3-MEDIUM' AND (size < 250000 OR (size = 250000 AND file_id > 0))) ORDER BY {_ASC} LIMIT {SIZE}")
def file_page_next(spark, sf):
    return page(listing(spark, sf), SORT, SIZE, CURSOR, "next")


@query(f"WITH {_F} SELECT * FROM f WHERE priority < '3-MEDIUM' OR (priority = '3-MEDIUM' AND (size > 250000 OR (size = 250000 AND file_id < 0))) ORDER BY {_DESC} LIMIT {SIZE}")
def file_page_prev(spark, sf):
    return page(listing(spark, sf), SORT, SIZE, CURSOR, "prev")


@query(f"WITH {_F} SELECT * FROM f ORDER BY {_DESC} LIMIT {SIZE}")
def file_page_last(spark, sf):
    return page(listing(spark, sf), SORT, SIZE, None, "last")


@query(f"WITH {_F} SELECT * FROM f ORDER BY {_ASC} LIMIT {SIZE} OFFSET 200")
def file_page_offset(spark, sf):
    return listing(spark, sf).orderBy(*order(SORT)).offset(200).limit(SIZE)


@query(f"WITH {_F}, {EDGES_SQL}, p AS (SELECT * FROM f ORDER BY {_ASC} LIMIT {SIZE}) SELECT p.*, count(e.file_id) AS dependencies, CAST(count(*) FILTER (WHERE e.outcome = 0) AS BIGINT) AS missing FROM p LEFT JOIN edges e USING (file_id) GROUP BY ALL")
def file_page_deps(spark, sf):
    top = page(listing(spark, sf), SORT, SIZE, None, "first")  # ids first, counts for one page only
    e = edges(spark, sf).select("file_id", "outcome")
    return top.join(e, "file_id", "left").groupBy("file_id", "priority", "size", "uploaded_at").agg(F.count("outcome").alias("dependencies"), n_if(F.col("outcome") == 0).alias("missing"))


@query(f"WITH {EDGES_SQL}, g AS (SELECT file_id, count(*) AS missing FROM edges WHERE outcome = 0 GROUP BY file_id) SELECT * FROM g WHERE missing < 3 OR (missing = 3 AND file_id > 5000) ORDER BY missing DESC, file_id LIMIT {SIZE}")
def missing_page_by_aggregate(spark, sf):
    g = edges(spark, sf).where("outcome = 0").groupBy("file_id").agg(F.count("*").alias("missing"))
    return page(g, [("missing", False), ("file_id", True)], SIZE, [3, 5000], "next")
