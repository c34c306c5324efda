"""Dependency roll-ups, freshness, missing reports, graph closures."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import graph
from ..operators.rollup import current, n_if, package_summary
from ..registry import query
from ..tables import EDGES_SQL, FILES_SQL, edges, files, table

_N = "CAST(count(*) FILTER (WHERE {}) AS BIGINT)"
_SUMMARY = ", ".join(f"{_N.format(c)} AS {a}" for a, c in (("resolved_count", "outcome = 1"), ("missing_count", "outcome = 0"), ("package_only_count", "outcome = 2"), ("common_count", "outcome = 3"), ("unresolved_count", "outcome = 4"), ("hard_missing_count", "outcome = 0 AND hard"), ("nonhard_missing_count", "outcome = 0 AND NOT hard")))
SUMMARY_SQL = f"""SELECT file_id, package, count(*) AS dependency_count, {_SUMMARY},
  CASE WHEN count(*) FILTER (WHERE outcome = 0) > 0 THEN 0 WHEN count(*) FILTER (WHERE outcome IN (3, 4)) > 0 THEN 4 WHEN count(*) FILTER (WHERE outcome = 2) > 0 THEN 2 ELSE 1 END AS summary_outcome,
  CASE WHEN min(provider) = max(provider) THEN min(provider) END AS provider_file_id FROM edges GROUP BY file_id, package"""


@query(f"WITH {EDGES_SQL} {SUMMARY_SQL}")
def dependency_package_summary(spark, sf):
    return package_summary(edges(spark, sf), ["file_id", "package"])


@query(f"""WITH {EDGES_SQL}, {FILES_SQL}, f AS (SELECT game_id, count(*) AS file_count, {_N.format("status = 'F'")} AS verified_count, {_N.format("status = 'O'")} AS pending_count, {_N.format("status = 'P'")} AS failed_count,
  CAST(round(sum(size), 2) AS DOUBLE) AS total_bytes, min(uploaded_at) AS first_upload, max(uploaded_at) AS last_upload FROM files GROUP BY game_id),
d AS (SELECT game_id, count(*) AS dependency_count, {_N.format("outcome = 0")} AS missing_count, {_N.format("outcome = 1")} AS resolved_count, {_N.format("outcome = 2")} AS package_only_count, count(DISTINCT package) AS package_count
  FROM edges JOIN files USING (file_id) WHERE status = 'F' GROUP BY game_id)
SELECT n_nationkey AS game_id, n_name AS game, coalesce(file_count, 0) AS file_count, coalesce(verified_count, 0) AS verified_count, coalesce(pending_count, 0) AS pending_count, coalesce(failed_count, 0) AS failed_count, total_bytes, first_upload, last_upload,
  coalesce(dependency_count, 0) AS dependency_count, coalesce(missing_count, 0) AS missing_count, coalesce(resolved_count, 0) AS resolved_count, coalesce(package_only_count, 0) AS package_only_count, coalesce(package_count, 0) AS package_count,
  greatest(0, coalesce(dependency_count - missing_count - resolved_count - package_only_count, 0)) AS unresolved_count
FROM nation LEFT JOIN f ON n_nationkey = f.game_id LEFT JOIN d ON n_nationkey = d.game_id""")
def game_catalog_stats(spark, sf):
    fs = files(spark, sf)
    f = fs.groupBy("game_id").agg(F.count("*").alias("file_count"), n_if(F.col("status") == "F").alias("verified_count"), n_if(F.col("status") == "O").alias("pending_count"), n_if(F.col("status") == "P").alias("failed_count"), F.round(F.sum("size"), 2).alias("total_bytes"), F.min("uploaded_at").alias("first_upload"), F.max("uploaded_at").alias("last_upload"))
    owned = edges(spark, sf).join(fs.where("status = 'F'").select("file_id", "game_id"), "file_id")
    # by package first, so the number of different packages is a count of rows
    by_package = owned.groupBy("game_id", "package").agg(F.count("*").alias("dependency_count"), n_if(F.col("outcome") == 0).alias("missing_count"), n_if(F.col("outcome") == 1).alias("resolved_count"), n_if(F.col("outcome") == 2).alias("package_only_count"))
    d = by_package.groupBy("game_id").agg(*(F.sum(c).alias(c) for c in ("dependency_count", "missing_count", "resolved_count", "package_only_count")), F.count("package").alias("package_count"))
    out = table(spark, sf, "nation").select(F.col("n_nationkey").alias("game_id"), F.col("n_name").alias("game")).join(f, "game_id", "left").join(d, "game_id", "left")
    zero = [c for c in out.columns if c.endswith("_count")]
    out = out.fillna(0, zero)
    return out.withColumn("unresolved_count", F.greatest(F.lit(0), F.col("dependency_count") - F.col("missing_count") - F.col("resolved_count") - F.col("package_only_count")))


@query(f"""WITH {EDGES_SQL}, k AS (SELECT lower(trim(p_brand)) AS key FROM part WHERE p_size <= 10 UNION SELECT lower(trim(p_brand)) FROM part WHERE p_retailprice < 950
  UNION SELECT lower(trim(p_brand)) FROM part WHERE p_type LIKE 'STANDARD%' UNION SELECT lower(trim(package)) FROM edges WHERE outcome = 2)
SELECT count(DISTINCT package) AS base_packages, CAST(count(*) FILTER (WHERE outcome = 0) AS BIGINT) AS base_missing FROM edges JOIN k ON lower(trim(package)) = key""")
def base_key_missing_total(spark, sf):
    part, e = table(spark, sf, "part"), edges(spark, sf)
    key = F.lower(F.trim("p_brand")).alias("key")
    keys = part.where("p_size <= 10").select(key).union(part.where("p_retailprice < 950").select(key)).union(part.where(F.col("p_type").startswith("STANDARD")).select(key)).union(e.where("outcome = 2").select(F.lower(F.trim("package")).alias("key"))).distinct()
    return e.withColumn("key", F.lower(F.trim("package"))).join(keys, "key").agg(F.countDistinct("package").alias("base_packages"), n_if(F.col("outcome") == 0).alias("base_missing"))


@query(f"WITH {EDGES_SQL} SELECT count(*) AS missing, count(DISTINCT package) AS packages, count(DISTINCT file_id) AS files FROM edges WHERE outcome = 0")
def missing_totals(spark, sf):
    return edges(spark, sf).where("outcome = 0").agg(F.count("*").alias("missing"), F.countDistinct("package").alias("packages"), F.countDistinct("file_id").alias("files"))


@query(f"""WITH {EDGES_SQL}, g AS (SELECT file_id, package, count(*) AS n FROM edges WHERE outcome = 0 GROUP BY ALL)
SELECT file_id, CAST(sum(n) AS BIGINT) AS missing, count(*) AS packages, string_agg(package, ', ' ORDER BY package) AS package_list FROM g GROUP BY file_id""")
def missing_by_file(spark, sf):
    g = edges(spark, sf).where("outcome = 0").groupBy("file_id", "package").agg(F.count("*").alias("n"))
    return g.groupBy("file_id").agg(F.sum("n").alias("missing"), F.count("*").alias("packages"), F.array_join(F.array_sort(F.collect_list("package")), ", ").alias("package_list"))  # one entry a package: bounded by packages


@query(f"WITH {EDGES_SQL} SELECT package, count(*) AS missing, count(DISTINCT file_id) AS files FROM edges WHERE outcome = 0 AND contains(lower(package), 'brand#1') GROUP BY package")
def missing_by_package(spark, sf):
    return edges(spark, sf).where("outcome = 0").where(F.lower("package").contains("brand#1")).groupBy("package").agg(F.count("*").alias("missing"), F.countDistinct("file_id").alias("files"))


@query(f"WITH {EDGES_SQL} SELECT lower(object_name) AS object_key, arg_min(object_name, (file_id, source_index, object_id, object_name)) AS spelling, count(*) AS missing, count(DISTINCT file_id) AS files FROM edges WHERE outcome = 0 GROUP BY 1")
def missing_by_object(spark, sf):
    return edges(spark, sf).where("outcome = 0").groupBy(F.lower("object_name").alias("object_key")).agg(F.min_by("object_name", F.struct("file_id", "source_index", "object_id", "object_name")).alias("spelling"), F.count("*").alias("missing"), F.countDistinct("file_id").alias("files"))


_CUR = "status = 'F' AND policy_current AND payload_current"


@query(f"WITH {FILES_SQL} SELECT game_id, {_N.format(chr(115) + 'tatus = ' + chr(39) + 'F' + chr(39))} AS verified, {_N.format(_CUR)} AS is_current, {_N.format('status = ' + chr(39) + 'F' + chr(39) + ' AND NOT (policy_current AND payload_current)')} AS stale, bool_and(CASE WHEN status = 'F' THEN policy_current AND payload_current ELSE true END) AS game_current FROM files GROUP BY game_id")
def publication_freshness(spark, sf):
    ok = F.col("policy_current") & F.col("payload_current")
    v = F.col("status") == "F"
    return files(spark, sf).groupBy("game_id").agg(n_if(v).alias("verified"), n_if(v & ok).alias("is_current"), n_if(v & ~ok).alias("stale"), F.bool_and(F.when(v, ok).otherwise(True)).alias("game_current"))


@query(f"WITH {EDGES_SQL}, {FILES_SQL} SELECT file_id, source_index, object_id, package, outcome, hard, provider FROM edges SEMI JOIN (SELECT * FROM files WHERE {_CUR}) AS f USING (file_id)")
def current_edges(spark, sf):
    return edges(spark, sf).join(current(files(spark, sf)), "file_id", "left_semi").select("file_id", "source_index", "object_id", "package", "outcome", "hard", "provider")


@query(f"WITH {EDGES_SQL}, {FILES_SQL}, s AS (SELECT file_id, package FROM edges GROUP BY ALL) SELECT package, count(*) AS summaries, {_N.format('status IS NULL')} AS ownerless, {_N.format('status <> ' + chr(39) + 'F' + chr(39))} AS unverified FROM s LEFT JOIN files USING (file_id) GROUP BY package")
def projection_health(spark, sf):
    s = edges(spark, sf).select("file_id", "package").distinct()
    return s.join(files(spark, sf).select("file_id", "status"), "file_id", "left").groupBy("package").agg(F.count("*").alias("summaries"), n_if(F.col("status").isNull()).alias("ownerless"), n_if(F.col("status") != "F").alias("unverified"))


@query(f"WITH {EDGES_SQL}, u AS (SELECT file_id, {_N.format('outcome IN (0, 4)')} AS bad, {_N.format('outcome = 1')} AS good FROM edges GROUP BY file_id) SELECT {_N.format('bad > 0')} AS unresolved_files, {_N.format('bad = 0')} AS resolved_files, {_N.format('good = 0')} AS without_resolved, CAST(sum(bad) AS BIGINT) AS unresolved_edges FROM u")
def unresolved_file_counts(spark, sf):
    u = edges(spark, sf).groupBy("file_id").agg(n_if(F.col("outcome").isin(0, 4)).alias("bad"), n_if(F.col("outcome") == 1).alias("good"))
    return u.agg(n_if(F.col("bad") > 0).alias("unresolved_files"), n_if(F.col("bad") == 0).alias("resolved_files"), n_if(F.col("good") == 0).alias("without_resolved"), F.sum("bad").alias("unresolved_edges"))


for _name, _sql in (
    ("dependency_filter_resolved", "bool_or(outcome = 1)"),
    ("dependency_filter_fully_resolved", "bool_and(outcome = 1)"),
    ("dependency_filter_unresolved", "bool_or(outcome = 4)"),
    ("dependency_filter_missing", "bool_or(outcome = 0)"),
    ("dependency_filter_package_only", "bool_and(outcome = 2)"),
):
    query(f"WITH {EDGES_SQL}, s AS (SELECT file_id FROM edges GROUP BY file_id HAVING {_sql}) SELECT o_orderkey AS file_id, o_orderstatus AS status FROM orders WHERE o_orderkey IN (SELECT file_id FROM s)", _name)(
        lambda spark, sf, keep=_sql: table(spark, sf, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderstatus").alias("status")).join(edges(spark, sf).groupBy("file_id").agg(F.expr(keep).alias("keep")).where("keep"), "file_id", "left_semi")
    )


@query(f"WITH {EDGES_SQL} SELECT supplier AS provider, count(DISTINCT file_id) AS used_by_files, count(*) AS used_by_edges, count(DISTINCT package) AS packages FROM edges WHERE outcome = 1 GROUP BY supplier")
def used_by(spark, sf):
    return edges(spark, sf).where("outcome = 1").groupBy(F.col("supplier").alias("provider")).agg(F.countDistinct("file_id").alias("used_by_files"), F.count("*").alias("used_by_edges"), F.countDistinct("package").alias("packages"))


@query(f"WITH {EDGES_SQL} SELECT DISTINCT file_id, package, provider FROM edges WHERE outcome = 1")
def uses(spark, sf):
    return edges(spark, sf).where("outcome = 1").select("file_id", "package", "provider").distinct()


@query(f"""WITH {EDGES_SQL}, c AS (SELECT DISTINCT p_brand AS package FROM part WHERE p_retailprice > 1900)
SELECT file_id FROM edges WHERE package IN (SELECT package FROM c) UNION SELECT file_id FROM edges WHERE outcome = 1 AND provider IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)""")
def affected_consumers(spark, sf):
    e = edges(spark, sf)
    changed = table(spark, sf, "part").where("p_retailprice > 1900").select(F.col("p_brand").alias("package")).distinct()
    gone = table(spark, sf, "supplier").where("s_acctbal < 0").select(F.col("s_suppkey").alias("provider"))
    return e.join(changed, "package", "left_semi").select("file_id").union(e.where("outcome = 1").join(gone, "provider", "left_semi").select("file_id")).distinct()


@query("""WITH RECURSIVE j AS (SELECT conv_id, turn, 0 AS depth, CAST(turn AS VARCHAR) AS path FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
UNION ALL SELECT c.conv_id, c.turn, depth + 1, path || '/' || c.turn FROM j JOIN conversations c ON c.conv_id = j.conv_id AND c.turn = j.turn + 1) SELECT conv_id, turn, depth, path FROM j""")
def job_subtree(spark, sf):
    """Job trees downwards, to any depth that trees have: 100,000 levels."""
    return spark.sql("""WITH RECURSIVE j(conv_id, turn, depth, path) MAX RECURSION LEVEL 100000 AS (
    SELECT conv_id, turn, 0, CAST(turn AS STRING) FROM {jobs} c WHERE NOT EXISTS (SELECT 1 FROM {jobs} p WHERE p.conv_id = c.conv_id AND p.turn = c.turn - 1)
    UNION ALL SELECT c.conv_id, c.turn, j.depth + 1, concat(j.path, '/', c.turn) FROM j JOIN {jobs} c ON c.conv_id = j.conv_id AND c.turn = j.turn + 1) SELECT conv_id, turn, depth, path FROM j LIMIT ALL""", jobs=table(spark, sf, "conversations").select("conv_id", "turn"))


_GRAPH = "g AS (SELECT DISTINCT s_nationkey AS src, c_nationkey AS dst FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE s_nationkey <> c_nationkey)"


@query(f"WITH RECURSIVE {_GRAPH}, r AS (SELECT 0 AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN g ON src = node WHERE depth < 25) SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node")
def dependency_closure(spark, sf):
    """What games a game reaches by the dependencies of all files: all lines of all orders are edges."""
    line = table(spark, sf, "lineitem").select("l_suppkey", "l_orderkey")
    g = line.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    g = g.where("s_nationkey <> c_nationkey")
    return graph.closure(g.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst")).distinct(), [0])


@query()
def package_closure(spark, sf):
    """game_id, part, depth: what a game's first package reaches within the game. A part leads to that of the order's next
    line, over all lines of all orders; the first package is the first line's part of the game's first order."""
    line = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("n"), F.col("l_partkey").cast("long").alias("part"))
    owner = files(spark, sf).select("file_id", F.col("game_id").cast("long").alias("game_id"))
    node = (F.shiftleft("game_id", 40) + F.col("part")).alias("node")
    # edges that repeat do no harm to a closure, so they are not shuffled again
    own = line.join(owner, "file_id").select("file_id", "n", "part", node)
    edges_ = own.select(F.col("node").alias("src"), F.lead("node").over(W.partitionBy("file_id").orderBy("n", "part")).alias("dst")).where("dst IS NOT NULL")
    # the first file of each game that has lines, by numbers alone, then its lines
    first = owner.join(line.select("file_id"), "file_id", "left_semi").groupBy("game_id").agg(F.min("file_id").alias("file_id"))
    roots = line.join(F.broadcast(first), "file_id").groupBy("game_id").agg(F.min_by(node, F.struct("n", "part")).alias("node")).select("node")
    return graph.closure(edges_, roots).select(F.shiftright("node", 40).alias("game_id"), F.col("node").bitwiseAND((1 << 40) - 1).alias("part"), "depth")
