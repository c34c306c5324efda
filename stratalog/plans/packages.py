"""Name dictionaries, provider keys and selection, import paths and binary sources over generated packages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..operators import verification
from ..operators.imports import outer_paths
from ..registry import query
from ..sources.binary import compact_index_column, encode_compact_index, legacy_header, probe_headers, redirect_round_trip
from ..tables import EDGES_SQL, edges, table


@query("SELECT DISTINCT md5(lower(trim(p_name))) AS hash, CAST(strlen(lower(trim(p_name))) AS BIGINT) AS length, sha256(lower(trim(p_name))) AS fingerprint, lower(trim(p_name)) AS name FROM part")
def name_dictionary(spark, sf):
    k = table(spark, sf, "part").select(name_key(F.col("p_name")).alias("name")).distinct()
    b = F.col("name").cast("binary")
    return k.select(F.md5(b).alias("hash"), F.octet_length("name").cast("long").alias("length"), F.sha2(b, 256).alias("fingerprint"), "name")


@query(f"WITH {EDGES_SQL} SELECT file_id, lower(trim(object_name)) AS name, min(source_index) AS first_index FROM edges GROUP BY ALL")
def name_candidates(spark, sf):
    return edges(spark, sf).groupBy("file_id", name_key(F.col("object_name")).alias("name")).agg(F.min("source_index").alias("first_index"))


@query("SELECT p_partkey AS object_id, md5(concat_ws(chr(0), lower(trim(p_name)), lower(trim(p_type)), lower(trim(p_brand)))) AS object_hash FROM part")
def object_candidates(spark, sf):
    from ..functions.keys import triple_hash

    return table(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), triple_hash(F.col("p_name"), F.col("p_type"), F.col("p_brand")).alias("object_hash"))


_KEYS = "keys AS (SELECT p_partkey AS source_id, 1 AS source_kind, md5(lower(trim(p_name))) AS package_key FROM part UNION ALL SELECT p_partkey, 2, md5(lower(trim(p_brand))) FROM part WHERE lower(p_brand) <> lower(p_name))"


def keys(spark, sf):
    p = table(spark, sf, "part")
    k = lambda c: F.md5(name_key(F.col(c)).cast("binary")).alias("package_key")
    return p.select(F.col("p_partkey").alias("source_id"), F.lit(1).alias("source_kind"), k("p_name")).unionByName(p.where("lower(p_brand) <> lower(p_name)").select(F.col("p_partkey").alias("source_id"), F.lit(2).alias("source_kind"), k("p_brand")))


@query(f"WITH {_KEYS} SELECT * FROM keys")
def provider_keys(spark, sf):
    return keys(spark, sf)


_CAND = f"{_KEYS}, cand AS (SELECT package_key, source_id, source_kind, s_suppkey AS provider, row_number() OVER (PARTITION BY package_key, s_suppkey ORDER BY source_kind, source_id) AS n FROM keys JOIN supplier ON source_id % 100 + 1 = s_suppkey WHERE s_acctbal >= 0)"


def candidates(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("provider"))
    c = keys(spark, sf).withColumn("provider", F.col("source_id") % 100 + 1).join(s, "provider")
    return c.withColumn("n", F.row_number().over(W.partitionBy("package_key", "provider").orderBy("source_kind", "source_id"))).where("n = 1").drop("n")


@query(f"WITH {_CAND} SELECT package_key, source_id, source_kind, provider FROM cand WHERE n = 1")
def provider_candidates(spark, sf):
    return candidates(spark, sf)


@query(f"WITH {_CAND} SELECT package_key, count(*) AS candidates, CASE WHEN count(*) FILTER (WHERE provider % 10 = 0) > 0 THEN 'mounted' WHEN count(*) > 1 THEN 'ambiguous' ELSE 'single' END AS status, CASE WHEN count(*) FILTER (WHERE provider % 10 = 0) > 0 THEN min(provider) FILTER (WHERE provider % 10 = 0) WHEN count(*) = 1 THEN min(provider) END AS selected FROM cand WHERE n = 1 GROUP BY package_key")
def provider_selection(spark, sf):
    mounted = F.min(F.when(F.col("provider") % 10 == 0, F.col("provider")))
    c = candidates(spark, sf).groupBy("package_key").agg(F.count("*").alias("candidates"), mounted.alias("m"), F.min("provider").alias("only"))
    status = F.when(F.col("m").isNotNull(), "mounted").when(F.col("candidates") > 1, "ambiguous").otherwise("single")
    return c.select("package_key", "candidates", status.alias("status"), F.coalesce("m", F.when(F.col("candidates") == 1, F.col("only"))).alias("selected"))


def _imports(spark, sf):
    """Generated imports and exports of packages: outers chain downwards, a few point at themselves."""
    p = table(spark, sf, "part").select((F.col("p_partkey") % 50).alias("file_id"), (F.floor(F.col("p_partkey") / 50) + 1).cast("int").alias("index"), F.col("p_name").alias("object_name"), F.col("p_type").alias("class_name"), F.col("p_size").alias("size"))
    up = F.when(F.col("size") % 7 == 0, 0).when(F.col("size") % 11 == 0, F.col("index")).otherwise(F.col("index") - 1)
    return p.withColumn("outer_index", up.cast("int")).drop("size")


@query("""WITH RECURSIVE b AS (SELECT (p_partkey % 50)::BIGINT AS file_id, (p_partkey // 50 + 1)::INT AS index, p_name AS object_name, CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 11 = 0 THEN p_partkey // 50 + 1 ELSE p_partkey // 50 END::INT AS outer_index FROM part),
c AS (SELECT file_id, index, outer_index AS at, object_name AS path, 1 AS hops FROM b UNION ALL SELECT c.file_id, c.index, b.outer_index, b.object_name || '.' || c.path, hops + 1 FROM c JOIN b ON b.file_id = c.file_id AND b.index = c.at WHERE c.at <> 0 AND hops < 128)
SELECT b.file_id, b.index, c.path FROM b LEFT JOIN c ON c.file_id = b.file_id AND c.index = b.index AND c.at = 0""")
def outer_chain_paths(spark, sf):
    return outer_paths(_imports(spark, sf))


@query("""WITH RECURSIVE b AS (SELECT (p_partkey % 50)::BIGINT AS pair_id, (p_partkey // 50 + 1)::INT AS index, lower(p_name) AS n, lower(p_type) AS t, CASE WHEN p_size % 7 = 0 THEN 0 WHEN p_size % 11 = 0 THEN p_partkey // 50 + 1 ELSE p_partkey // 50 END::INT AS up FROM part),
x AS (SELECT b.pair_id, b.n, b.t, CASE WHEN r.pair_id IS NOT NULL THEN 0 ELSE b.up + 1 END AS at, min(b.index) FILTER (WHERE b.index % 5 <> 0) AS pub, min(b.index) AS any FROM b LEFT JOIN b r ON r.pair_id = b.pair_id AND r.index = b.up AND r.up = 0 WHERE b.up <> 0 AND b.index % 3 <> 0 GROUP BY ALL),
v AS (SELECT b.pair_id, b.index, CASE WHEN b.up = 0 THEN 'package' ELSE 'unresolved' END AS status, CASE WHEN b.up = b.index THEN 'cycle' WHEN b.up <> 0 THEN 'lost_parent' END AS reason, NULL::INT AS export_index FROM b LEFT JOIN b p ON p.pair_id = b.pair_id AND p.index = b.up WHERE b.up = 0 OR b.up = b.index OR p.pair_id IS NULL
UNION ALL SELECT b.pair_id, b.index, CASE WHEN v.status NOT IN ('package', 'resolved') THEN 'unresolved' WHEN x.any IS NULL THEN 'missing' WHEN x.pub IS NULL THEN 'private_export' ELSE 'resolved' END,
  CASE WHEN v.status NOT IN ('package', 'resolved') THEN 'parent' WHEN x.any IS NULL THEN 'no_match' WHEN x.pub IS NULL THEN 'private' END, CASE WHEN v.status IN ('package', 'resolved') THEN x.pub END
  FROM v JOIN b ON b.pair_id = v.pair_id AND b.up = v.index AND b.up <> b.index LEFT JOIN x ON x.pair_id = b.pair_id AND x.n = b.n AND x.t = b.t AND x.at = CASE WHEN v.status = 'package' THEN 0 ELSE v.export_index + 1 END)
SELECT * FROM v""")
def verify_import_outcomes(spark, sf):
    """Chains of parents, with cycles, by the rules of engine 4; two thirds of the objects are exported, a fifth of them privately."""
    rows = _imports(spark, sf).withColumnRenamed("file_id", "pair_id").withColumn("root", F.col("outer_index") == 0)
    names = rows.select("pair_id", "index", "object_name", F.when(F.col("root"), "Package").otherwise(F.col("class_name")).alias("class_name"), F.lit("Core").alias("class_package"), "outer_index", "root")
    imports = names.select("pair_id", "index", "object_name", "class_name", "class_package", F.when(F.col("root"), 0).otherwise(-F.col("outer_index") - 1).cast("int").alias("outer_index"), F.lit(True).alias("referenced"))
    roots = names.where("root").select(F.col("pair_id").alias("p"), F.col("index").alias("i"))
    below = names.where("NOT root AND index % 3 <> 0")
    exports = below.join(roots, (F.col("pair_id") == F.col("p")) & (F.col("outer_index") == F.col("i")), "left").select(
        "pair_id", "index", "object_name", "class_name", "class_package", F.when(F.col("p").isNotNull(), 0).otherwise(F.col("outer_index") + 1).cast("int").alias("outer_index"), F.when(F.col("index") % 5 == 0, 0).otherwise(1).cast("long").alias("flags"),
    )
    return verification.verify_imports(imports, exports, engine=4)


@query("SELECT (l_partkey * 7919 - 800000)::INT AS expected, (l_partkey * 7919 - 800000)::INT AS decoded FROM lineitem")
def compact_index(spark, sf):
    """A round trip a line. Numbers of more than 31 bits have no compact index: their rows are null in both columns."""
    p = table(spark, sf, "lineitem").select((F.col("l_partkey") * 7919 - 800000).try_cast("int").alias("expected"))
    return p.select("expected", encode_compact_index(F.col("expected")).alias("data")).select("expected", compact_index_column(F.col("data")).alias("decoded"))


@query("""WITH h AS (SELECT p_partkey, p_size, p_partkey % 17 = 0 AS short, p_partkey % 13 <> 0 AS good, [33, 60, 69, 118, 128, 400, 864, -4, -7, -8][p_partkey % 10 + 1] AS v FROM part),
s AS (SELECT *, CASE WHEN v <= -8 THEN 'UE5' WHEN v < 0 THEN 'UE4' WHEN v BETWEEN 334 AND 867 THEN 'UE3' WHEN v BETWEEN 100 AND 199 THEN 'UE2' WHEN v BETWEEN 34 AND 99 THEN 'UE1' END AS e,
      CASE WHEN short THEN 'truncated' WHEN NOT good THEN 'bad_tag' ELSE 'ok' END AS state FROM h)
SELECT p_partkey, CASE WHEN state = 'ok' AND e IS NULL THEN 'unknown_version' ELSE state END AS status, CASE WHEN state = 'ok' THEN e END AS engine,
       CASE WHEN state = 'ok' THEN v END::INT AS version, CASE WHEN state = 'ok' AND v >= 0 THEN 0 END::INT AS licensee, CASE WHEN state = 'ok' AND v >= 0 THEN p_size END::INT AS names FROM s""")
def header_probe(spark, sf):
    return probe_headers(table(spark, sf, "part").select("p_partkey", legacy_header(F.col("p_size"), F.col("p_partkey")).alias("data")), "data").drop("data")


@query()
def redirect_codec(spark, sf):
    return table(spark, sf, "pages").select("page_id", redirect_round_trip(F.col("html")).alias("r")).select("page_id", "r.*")


_FLAT = "part_rows AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS pair_id, row_number() OVER (PARTITION BY floor(p_partkey / 40) ORDER BY p_partkey) AS i, p_name, p_type, p_brand, p_size FROM part)"


def _flat_pairs(spark, sf):
    """Forty parts a pair: imports below one root package, exports of two thirds of them, private by their name's length."""
    p = table(spark, sf, "part").withColumn("pair_id", F.floor(F.col("p_partkey") / 40))
    p = p.withColumn("i", F.row_number().over(W.partitionBy("pair_id").orderBy("p_partkey")).cast("int"))
    row = lambda df, i, name, cls, package, outer, *more: df.select("pair_id", i.alias("index"), name.alias("object_name"), cls.alias("class_name"), package.alias("class_package"), outer.alias("outer_index"), *more)
    own = (F.col("p_name"), F.col("p_type"), F.col("p_brand"))
    used = F.lit(True).alias("referenced")
    roots = row(p.where("i = 1"), F.lit(0), F.lit("Provider"), F.lit("Package"), F.lit("Core"), F.lit(0), used)
    imports = roots.unionByName(row(p, F.col("i"), *own, F.lit(-1), used))
    bits = F.when(F.length("p_name") % 2 == 0, F.lit((1 << 34) + 1)).otherwise(0).cast("long").alias("flags")
    return imports, row(p.where("p_size % 3 <> 0"), F.col("i"), *own, F.lit(0), bits)


@query(f"""WITH {_FLAT}, e AS (SELECT DISTINCT pair_id, lower(p_name) AS n, lower(p_type) AS t, lower(p_brand) AS b FROM part_rows WHERE p_size % 3 <> 0),
short AS (SELECT DISTINCT pair_id, n, t FROM e),
m AS (SELECT r.*, engine, CASE WHEN engine = 4 THEN short.n IS NOT NULL ELSE e.n IS NOT NULL END AS found, length(p_name) % 2 = 0 AS public
      FROM part_rows r JOIN (SELECT unnest([1, 2, 3, 4, 5]) AS engine) ON true LEFT JOIN e ON r.pair_id = e.pair_id AND lower(p_name) = e.n AND lower(p_type) = t AND lower(p_brand) = b LEFT JOIN short ON r.pair_id = short.pair_id AND lower(p_name) = short.n AND lower(p_type) = short.t)
SELECT engine, pair_id, i AS index, CASE WHEN found AND public THEN 'resolved' WHEN found THEN 'private_export' WHEN engine >= 4 THEN 'missing' ELSE 'runtime_only' END AS status,
       CASE WHEN found AND public THEN 1 WHEN found OR engine >= 4 THEN 0 ELSE 4 END AS outcome FROM m
UNION ALL SELECT engine, pair_id, 0, 'package', 2 FROM (SELECT DISTINCT pair_id FROM part_rows), (SELECT unnest([1, 2, 3, 4, 5]) AS engine)""")
def import_outcomes_by_engine(spark, sf):
    imports, exports = _flat_pairs(spark, sf)
    v = verification.verify_engines(imports, exports, verification.RULES)
    return v.select("engine", "pair_id", "index", "status", verification.outcome(F.col("status")).alias("outcome"))


_KIND = "CASE WHEN l_linenumber % 5 = 0 THEN 'script' WHEN l_linenumber % 7 = 0 THEN 'null' ELSE 'package' END"


@query(f"""WITH i AS (SELECT l_orderkey AS file_id, l_linenumber AS index, {_KIND} AS kind, l_partkey AS package_id, l_suppkey % 4 AS export_hash, l_suppkey AS script_id FROM lineitem),
p AS (SELECT p_partkey AS package_id, min(p_size) AS provider FROM part WHERE p_size % 3 <> 0 GROUP BY p_partkey), x AS (SELECT DISTINCT p_partkey AS package_id, p_size % 4 AS export_hash FROM part WHERE p_size % 3 <> 0), s AS (SELECT DISTINCT s_suppkey AS script_id FROM supplier WHERE s_acctbal >= 0)
SELECT file_id, index, kind, CASE WHEN kind = 'package' THEN provider END AS provider,
       CASE WHEN kind = 'script' THEN CASE WHEN s.script_id IS NULL THEN 0 ELSE 1 END WHEN kind = 'null' THEN 4 WHEN x.package_id IS NOT NULL THEN 1 WHEN p.package_id IS NOT NULL THEN 2 ELSE 0 END AS outcome
FROM i LEFT JOIN p USING (package_id) LEFT JOIN x ON i.package_id = x.package_id AND i.export_hash = x.export_hash LEFT JOIN s ON i.script_id = s.script_id""")
def hashed_import_outcomes(spark, sf):
    line, part = table(spark, sf, "lineitem"), table(spark, sf, "part").where("p_size % 3 <> 0")
    i = line.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("index"), F.expr(_KIND).alias("kind"), F.col("l_partkey").alias("package_id"), (F.col("l_suppkey") % 4).alias("export_hash"), F.col("l_suppkey").alias("script_id"))
    p = part.select(F.col("p_partkey").alias("package_id"), F.col("p_size").alias("provider"))
    x = part.select(F.col("p_partkey").alias("package_id"), (F.col("p_size") % 4).cast("long").alias("export_hash"))
    s = table(spark, sf, "supplier").where("s_acctbal >= 0").select(F.col("s_suppkey").alias("script_id"))
    return verification.resolve_hashed(i, p, x, s)
