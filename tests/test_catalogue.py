import os
import re
import sys

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratalog import catalogue
from stratalog.functions import keys
from stratalog.operators import graph, joins, paging, searching
from stratalog.sources import binary

DATA = "/root/testdata/sf0.001"
SAMPLE = ["dependency_package_summary", "missing_by_file", "current_edges", "geoip_lookup", "event_promotion_15s", "file_page_next", "provider_selection", "duplicate_keepers", "game_match_rank", "job_subtree", "statistics_freshness", "missing_totals_when_current", "game_pass", "unresolved_by_file", "search_core_files", "search_broad", "file_list_sorts", "profile_admission", "container_blocks", "section_export_csv", "effective_names", "inventory_by_either_key", "outer_chain_paths"]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    df = catalogue.QUERIES[name](spark, DATA)
    want = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    key = lambda cols, row: repr([None if row[cols.index(c)] is None else str(round(row[cols.index(c)], 4)) if isinstance(row[cols.index(c)], float) else str(row[cols.index(c)]) for c in sorted(cols)])
    assert sorted(key(df.columns, r) for r in df.collect()) == sorted(key(want.columns, r) for r in want.fetchall())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
@pytest.mark.parametrize("name", ["rebuilt_consumers", "consumer_completeness", "reference_matches"])
def test_tasks_hold_a_bounded_number_of_rows(spark, name, monkeypatch):
    monkeypatch.setattr("stratalog.tables.TASK_ROWS", 100)
    lines = spark.read.parquet(f"{DATA}/lineitem.parquet").count()
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert re.search(rf"hashpartitioning\(file_id#\d+L?, {-(-lines // 100)}\)", plan)
    test_query_equals_sql(spark, name)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_pairs_of_all_engines_are_read_once(spark, tmp_path, monkeypatch):
    part = pd.read_parquet(f"{DATA}/part.parquet")
    pd.concat([part.assign(p_partkey=part["p_partkey"] + 1000 * k) for k in range(100)]).to_parquet(tmp_path / "part.parquet")
    monkeypatch.setattr(sys.modules[__name__], "DATA", str(tmp_path))
    few = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")  # sides dealt alike, which adaptive execution joins apart
    try:
        plan = catalogue.QUERIES["import_outcomes_by_engine"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("MapInArrow") == 1 and "REPARTITION_BY_COL" in plan and "CoGroups" not in plan
        test_query_equals_sql(spark, "import_outcomes_by_engine")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", few)


def test_pages_concatenate(spark):
    rows = spark.createDataFrame([(i, i % 3, i % 5) for i in range(40)], "id long, a long, b long")
    sort = [("a", True), ("b", False), ("id", True)]
    whole = [tuple(r) for r in rows.orderBy(*paging.order(sort)).collect()]
    for direction, got in (("next", []), ("prev", [])):
        part = paging.page(rows, sort, 7, None, "first" if direction == "next" else "last").collect()
        while part:
            got[len(got) if direction == "next" else 0 : len(got) if direction == "next" else 0] = [tuple(r) for r in part]
            r = part[-1 if direction == "next" else 0]
            part = paging.page(rows, sort, 7, [r["a"], r["b"], r["id"]], direction).collect()
        assert got == whole


def test_pages_with_nulls_lose_no_rows(spark):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else i % 3, None if i % 5 == 0 else i % 7) for i in range(60)], "id long, a long, b long")
    for sort in ([("a", True), ("b", False), ("id", True)], [("a", False), ("b", True), ("id", False)]):
        whole = [tuple(r) for r in rows.orderBy(*paging.order(sort)).collect()]
        got, part = [], paging.fetch(rows, sort, 7)
        assert not part.has_previous
        while True:
            got += [tuple(r) for r in part.rows]
            if not part.has_next:
                break
            part = paging.fetch(rows, sort, 7, part.last, "next")
        assert got == whole and part.has_previous
        got, part = [], paging.fetch(rows, sort, 7, direction="last")
        assert not part.has_next
        while True:
            got = [tuple(r) for r in part.rows] + got
            if not part.has_previous:
                break
            part = paging.fetch(rows, sort, 7, part.first, "prev")
        assert got == whole
    assert paging.fetch(rows.limit(0), sort, 7) == paging.Page([], False, False, None, None)
    assert [paging.last_size(n, 50) for n in (0, 7, 50, 120)] == [0, 7, 50, 20]


def test_natural_keys_of_any_length(spark):
    names = ["a2", "A10", "a010b", "v1000000000000000000001", "v10000000000000000000019", "v9", "a", "", "007", "7x"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names], "n string").orderBy(keys.natural_key(F.col("n")), "n").collect()]
    split = lambda n: [(0, int(p)) if p.isdigit() else (1, p) for p in re.findall(r"\d+|\D+", n.lower())]
    assert got == sorted(names, key=lambda n: (split(n), n))


def test_terms_that_are_all_short_find_nothing(spark):
    rows = spark.createDataFrame([("some words here",)], "t string")
    assert rows.where(searching.token_prefix(F.col("t"), ["of", "a"])).count() == 0 and rows.where(searching.token_prefix(F.col("t"), ["word", "of"])).count() == 1


def test_closure_says_when_it_is_cut(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "src long, dst long")
    assert {(r.node, r.depth) for r in graph.closure(edges, [3]).collect()} == {(i, i - 3) for i in range(3, 13)}
    with pytest.raises(ValueError):
        graph.closure(edges, [0], max_depth=5)


def test_job_trees_deeper_than_a_hundred(spark, tmp_path):
    spark.createDataFrame([(1, t) for t in range(150)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    got = catalogue.QUERIES["job_subtree"](spark, str(tmp_path)).agg({"depth": "max"}).first()
    assert got[0] == 149


def test_ranges_of_any_length(spark):
    ranges = [(0, 0, "a"), (1, 6, "b"), (7, 8, "c"), (100, 16_777_315, "d"), (16_777_316, (1 << 32) - 1, "e"), (60, 50, "none")]
    values = [None, 0, 1, 3, 6, 7, 8, 9, 55, 99, 100, 5_000_000, 16_777_315, 16_777_316, (1 << 32) - 1, 1 << 32, 3, 3]
    rows = spark.createDataFrame(list(enumerate(values)), "id long, ip long")
    got = joins.range_lookup(rows, spark.createDataFrame(ranges, "lo long, hi long, country string"), "ip", "lo", "hi", "country").collect()
    want = {i: next((c for lo, hi, c in ranges if v is not None and lo <= v <= hi), None) for i, v in enumerate(values)}
    assert {r.id: r.country for r in got} == want and len(got) == len(values)
    empty = joins.range_lookup(rows, spark.createDataFrame([], "lo long, hi long, country string"), "ip", "lo", "hi", "country")
    assert empty.count() == len(values) and empty.where("country IS NOT NULL").count() == 0


def test_cursor_is_bound():
    token = paging.sign([1, "x"], "list", b"key")
    assert paging.verify(token, "list", b"key") == [1, "x"]
    with pytest.raises(ValueError):
        paging.verify(token, "other", b"key")
    with pytest.raises(ValueError):
        paging.verify(token, "list", b"another")


def test_binary_round_trips():
    for v in [0, 1, -1, 63, 64, -64, 8191, 8192, 1 << 20, -(1 << 27), (1 << 30) - 1]:
        assert binary.read_compact_index(binary.write_compact_index(v))[0] == v
    for data in [b"", b"a", b"aaaaaaaaaaaaaaaaaaaaaaaa", b"banana" * 50, bytes(range(256)) * 3, b"\x00" * 700]:
        assert binary.decompress(binary.compress(data)) == data
    assert binary.parse_header(b"\x01")["status"] == "truncated"
    for bad in (b"\x7f\xff\xff\xff\xff", b"\x7f\xff\xff\xff\x7f"):
        with pytest.raises(ValueError):
            binary.read_compact_index(bad)


def test_binary_columns_equal_the_readers(spark):
    numbers = [0, 1, -1, 63, 64, -64, 8191, 8192, 1 << 20, -(1 << 27), (1 << 31) - 1]
    rows = spark.createDataFrame([(v, bytearray(binary.write_compact_index(v))) for v in numbers], "v int, b binary")
    for r in rows.select("v", "b", binary.encode_compact_index(F.col("v")).alias("e"), binary.compact_index_column(F.col("b")).alias("d")).collect():
        assert bytes(r.e) == bytes(r.b) and r.d == r.v
    bad = spark.createDataFrame([(bytearray(b"\x7f\xff\xff\xff\xff"),), (bytearray(b"\x40"),)], "b binary")
    assert [r.d for r in bad.select(binary.compact_index_column(F.col("b")).alias("d")).collect()] == [None, None]
    head = binary.probe_headers(spark.range(300).select("id", binary.legacy_header(F.col("id") * 3 - 5, F.col("id")).alias("data")), "data").collect()
    for r in head:
        want = binary.parse_header(bytes(r.data))
        assert {k: r[k] for k in want} == want, r


def test_compact_index_takes_large_keys(spark, tmp_path):
    spark.createDataFrame([(0,), (19_999,), (1_199_999,), (None,)], "l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = [tuple(r) for r in catalogue.QUERIES["compact_index"](spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted([(-800_000,) * 2, (157_572_081,) * 2, (None, None), (None, None)], key=str)
    long = spark.createDataFrame([(1 << 31,), (-(1 << 31) - 1,), (1 << 40,)], "v long").select(binary.encode_compact_index(F.col("v")).alias("e"))
    assert [r.e for r in long.collect()] == [None] * 3


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_package_closure_against_brute_force(spark):
    read = lambda t, *cols: spark.read.parquet(f"{DATA}/{t}.parquet").select(*cols).collect()
    nation = dict(map(tuple, read("customer", "c_custkey", "c_nationkey")))
    game = {o: nation[c] for o, c in map(tuple, read("orders", "o_orderkey", "o_custkey")) if c in nation}
    lines = sorted((o, n, p) for o, n, p in map(tuple, read("lineitem", "l_orderkey", "l_linenumber", "l_partkey")) if o in game)
    after, depth = {}, {}
    for (o, _, p), (o2, _, p2) in zip(lines, lines[1:], strict=False):
        if o == o2:
            after.setdefault((game[o], p), set()).add((game[o], p2))
    for o, _, p in lines:
        if game[o] not in {g for g, _ in depth}:
            depth[game[o], p] = 0
    front = list(depth)
    while front:
        front = [y for x in front for y in after.get(x, ()) if depth.setdefault(y, depth[x] + 1) == depth[x] + 1]
        front = list(dict.fromkeys(front))
    got = {(r.game_id, r.part): r.depth for r in catalogue.QUERIES["package_closure"](spark, DATA).collect()}
    assert got == depth and len(got) > 1000


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_package_closure_moves_lines_once(spark, monkeypatch):
    taken = {}
    whole = graph.closure
    monkeypatch.setattr(graph, "closure", lambda edges, roots: taken.update(edges=edges, roots=roots) or whole(edges, roots.where("false")))
    assert catalogue.QUERIES["package_closure"](spark, DATA).count() == 0
    plan = {k: df._jdf.queryExecution().executedPlan().toString() for k, df in taken.items()}
    assert "Aggregate" not in plan["edges"] and "LeftSemi" in plan["roots"]
