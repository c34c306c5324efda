"""Coverage of required packages, supersets, matches between collections."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.rollup import n_if
from ..registry import query
from ..tables import EDGES_SQL, FILES_SQL, edges, files, owned_edges, table

NATIVE = ("Brand#11", "Brand#12", "Brand#13")
_NAT = "('Brand#11', 'Brand#12', 'Brand#13')"
_PERFILE = f"pf AS (SELECT file_id, count(*) AS required, CAST(count(*) FILTER (WHERE package IN {_NAT}) AS BIGINT) AS native, CAST(count(*) FILTER (WHERE outcome IN (1, 2)) AS BIGINT) AS matched, CAST(count(*) FILTER (WHERE outcome = 0) AS BIGINT) AS missing FROM edges GROUP BY file_id)"


def per_file(spark, sf):
    out = F.col("outcome")
    return edges(spark, sf).groupBy("file_id").agg(F.count("*").alias("required"), n_if(F.col("package").isin(*NATIVE)).alias("native"), n_if(out.isin(1, 2)).alias("matched"), n_if(out == 0).alias("missing"))


@query(f"WITH {EDGES_SQL}, {_PERFILE} SELECT * FROM pf")
def indexed_coverage_file(spark, sf):
    return per_file(spark, sf)


@query(f"""WITH {EDGES_SQL}, {FILES_SQL}, {_PERFILE} SELECT game_id, count(*) AS files, CAST(sum(required) AS BIGINT) AS required, CAST(sum(native) AS BIGINT) AS native, CAST(sum(matched) AS BIGINT) AS matched, CAST(sum(missing) AS BIGINT) AS missing,
CAST(count(*) FILTER (WHERE missing = 0) AS BIGINT) AS complete_files, CAST(count(*) FILTER (WHERE missing > 0) AS BIGINT) AS gap_files, sum(matched + missing) <= sum(required) AS consistent, floor(1000 * sum(matched) / sum(required)) / 10 AS percent FROM pf JOIN files USING (file_id) GROUP BY game_id""")
def indexed_coverage_game(spark, sf):
    pf = per_file(spark, sf).join(files(spark, sf).select("file_id", "game_id"), "file_id")
    sums = [F.sum(c).alias(c) for c in ("required", "native", "matched", "missing")]
    g = pf.groupBy("game_id").agg(F.count("*").alias("files"), *sums, n_if(F.col("missing") == 0).alias("complete_files"), n_if(F.col("missing") > 0).alias("gap_files"))
    return g.withColumn("consistent", F.col("matched") + F.col("missing") <= F.col("required")).withColumn("percent", F.floor(1000 * F.col("matched") / F.col("required")) / 10)


for _name, _cond in (("coverage_filter_missing", "missing > 0"), ("coverage_filter_no_gaps", "missing = 0"), ("coverage_filter_native", "native > 0"), ("coverage_filter_indexed", "matched > 0")):
    query(f"WITH {EDGES_SQL}, {_PERFILE} SELECT file_id FROM pf WHERE {_cond}", _name)(lambda spark, sf, cond=_cond: per_file(spark, sf).where(cond).select("file_id"))


_REQ = "req AS (SELECT DISTINCT package, object_id FROM edges WHERE outcome IN (0, 1)), have AS (SELECT DISTINCT package, supplier, object_id FROM edges WHERE outcome = 1)"


@query(f"""WITH {EDGES_SQL}, {_REQ}, n AS (SELECT package, count(*) AS required FROM req GROUP BY package), m AS (SELECT package, supplier, count(*) AS matched FROM have GROUP BY ALL)
SELECT package, supplier AS provider, required, matched, required - matched AS missing, CASE WHEN matched = required THEN 'fully' WHEN matched > 0 THEN 'partially' ELSE 'does_not' END AS coverage FROM m JOIN n USING (package)""")
def provider_coverage(spark, sf):
    e = edges(spark, sf)
    required = e.where("outcome IN (0, 1)").select("package", "object_id").distinct().groupBy("package").agg(F.count("*").alias("required"))
    m = e.where("outcome = 1").select("package", F.col("supplier").alias("provider"), "object_id").distinct().groupBy("package", "provider").agg(F.count("*").alias("matched"))
    level = F.when(F.col("matched") == F.col("required"), "fully").when(F.col("matched") > 0, "partially").otherwise("does_not")
    return m.join(required, "package").select("package", "provider", "required", "matched", (F.col("required") - F.col("matched")).alias("missing"), level.alias("coverage"))


@query(f"WITH {EDGES_SQL}, need AS (SELECT DISTINCT package FROM edges WHERE outcome = 0), offer AS (SELECT DISTINCT supplier, package FROM edges WHERE outcome = 1) SELECT supplier AS provider, count(*) AS matched, count(*) = (SELECT count(*) FROM need) AS superset FROM offer SEMI JOIN need USING (package) GROUP BY supplier")
def package_superset(spark, sf):
    e = edges(spark, sf)
    need = e.where("outcome = 0").select("package").distinct()
    got = e.where("outcome = 1").select(F.col("supplier").alias("provider"), "package").distinct().join(need, "package", "left_semi").groupBy("provider").agg(F.count("*").alias("matched"))
    return got.select("provider", "matched", (F.col("matched") == need.agg(F.count("*")).scalar()).alias("superset"))


@query(f"""WITH {EDGES_SQL}, {FILES_SQL}, g AS (SELECT DISTINCT game_id, package FROM edges JOIN files USING (file_id) WHERE outcome = 1), u AS (SELECT DISTINCT file_id, package FROM edges WHERE outcome = 0),
n AS (SELECT file_id, count(*) AS imports FROM u GROUP BY file_id), m AS (SELECT file_id, game_id, count(*) AS matches FROM u JOIN g USING (package) GROUP BY ALL),
r AS (SELECT file_id, game_id, imports, matches, floor(matches * 1000 / imports) / 10 AS percent, row_number() OVER (PARTITION BY file_id ORDER BY matches DESC, game_id) AS rank FROM m JOIN n USING (file_id))
SELECT *, CASE WHEN percent >= 75 THEN 'likely' WHEN percent > 0 THEN 'possible' ELSE 'none' END AS assessment FROM r WHERE rank <= 5""")
def game_match_rank(spark, sf):
    """The five best games a file. Files that miss the same packages share one ranking: games are counted a set of packages,
    not a file, and a package goes to its games as one row with an array."""
    e, f = edges(spark, sf), files(spark, sf)
    owned = e.where("outcome = 1").select("file_id", "package").distinct()
    g = owned.join(f.select("file_id", "game_id"), "file_id").groupBy("package").agg(F.collect_set("game_id").alias("games"))
    u = e.where("outcome = 0").groupBy("file_id").agg(F.array_sort(F.collect_set("package")).alias("packages"))
    sets = u.select("packages").distinct().withColumn("k", F.xxhash64("packages"))
    m = sets.select("packages", "k", F.explode("packages").alias("package")).join(g, "package").select("packages", "k", F.explode("games").alias("game_id"))
    m = m.groupBy("packages", "game_id").agg(F.count("*").alias("matches"))
    best = m.groupBy("packages").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("matches")).alias("m"), "game_id"))), 1, 5).alias("best"))  # an entry a game
    r = u.join(best, "packages").select("file_id", F.size("packages").cast("long").alias("imports"), F.posexplode("best").alias("at", "b"))
    r = r.select("file_id", "b.game_id", "imports", (-F.col("b.m")).alias("matches"), (F.col("at") + 1).alias("rank")).withColumn("percent", F.floor(F.col("matches") * 1000 / F.col("imports")) / 10)
    return r.withColumn("assessment", F.when(F.col("percent") >= 75, "likely").when(F.col("percent") > 0, "possible").otherwise("none"))


@query(f"""WITH {EDGES_SQL}, {FILES_SQL}, e AS (SELECT game_id, package, object_id, outcome FROM edges JOIN files USING (file_id)), miss AS (SELECT DISTINCT game_id, object_id FROM e WHERE outcome = 0), own AS (SELECT DISTINCT game_id, object_id FROM e WHERE outcome = 1)
SELECT m.game_id AS target_game, o.game_id AS source_game, count(*) AS objects FROM miss m JOIN own o ON m.object_id = o.object_id AND m.game_id <> o.game_id JOIN nation a ON a.n_nationkey = m.game_id JOIN nation b ON b.n_nationkey = o.game_id WHERE a.n_regionkey = b.n_regionkey GROUP BY ALL""")
def cross_examine(spark, sf):
    e = owned_edges(spark, sf)
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("game_id"), F.col("n_regionkey").alias("family"))
    e = e.join(nation, "game_id")
    miss = e.where("outcome = 0").select(F.col("game_id").alias("target_game"), "family", "object_id").distinct()
    own = e.where("outcome = 1").select(F.col("game_id").alias("source_game"), "family", "object_id").distinct()
    return miss.join(own, ["object_id", "family"]).where("target_game <> source_game").groupBy("target_game", "source_game").agg(F.count("*").alias("objects"))
