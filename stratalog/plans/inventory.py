"""Duplicates, conflicts, inventories of two sites, misnamed packages."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import quick_fingerprint
from ..operators.joins import either_key, neither_key
from ..operators.rollup import n_if
from ..registry import query
from ..tables import EDGES_SQL, edges, table

_D = "d AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, length(coalesce(text, '')) AS size, source AS game, lang AS ext FROM documents)"


def items(spark, sf):
    t = F.coalesce("text", F.lit(""))
    return table(spark, sf, "documents").select("doc_id", F.md5(t.cast("binary")).alias("md5"), F.length(t).cast("long").alias("size"), F.col("source").alias("game"), F.col("lang").alias("ext"))


@query(f"WITH {_D} SELECT md5, size, count(*) AS copies, count(DISTINCT game) AS games, min(doc_id) AS first_id FROM d GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return items(spark, sf).groupBy("md5", "size").agg(F.count("*").alias("copies"), F.countDistinct("game").alias("games"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query(f"WITH {_D}, k AS (SELECT md5, size, count(*) AS copies, min(doc_id) AS keeper FROM d GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, md5, doc_id = keeper AS keeper, size * (copies - 1) AS reclaimable FROM d JOIN k USING (md5, size)")
def duplicate_keepers(spark, sf):
    d = items(spark, sf)
    sizes = d.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size")
    d = d.join(sizes, "size", "left_semi")  # only sizes that repeat can hold copies
    k = d.groupBy("md5", "size").agg(F.count("*").alias("copies"), F.min("doc_id").alias("keep")).where("copies > 1")
    return d.join(k, ["md5", "size"]).select("doc_id", "md5", (F.col("doc_id") == F.col("keep")).alias("keeper"), (F.col("size") * (F.col("copies") - 1)).alias("reclaimable"))


@query("SELECT count(*) AS tuples FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem WHERE l_orderkey IS NOT NULL AND l_partkey IS NOT NULL AND l_suppkey IS NOT NULL)")
def distinct_tuple_count(spark, sf):
    return table(spark, sf, "lineitem").agg(F.countDistinct("l_orderkey", "l_partkey", "l_suppkey").alias("tuples"))


@query(f"WITH {EDGES_SQL} SELECT package FROM edges WHERE outcome = 1 GROUP BY package HAVING count(DISTINCT supplier) > 1 UNION SELECT p_brand FROM part WHERE p_size = 50")
def multi_provider_packages(spark, sf):
    many = edges(spark, sf).where("outcome = 1").groupBy("package").agg(F.countDistinct("supplier").alias("n")).where("n > 1").select("package")
    return many.union(table(spark, sf, "part").where("p_size = 50").select("p_brand")).distinct()


_SITES = f"{_D}, here AS (SELECT * FROM d WHERE doc_id % 2 = 0), there AS (SELECT * FROM d WHERE doc_id % 2 = 1)"


@query(f"WITH {_SITES} SELECT doc_id, md5, size, game FROM there WHERE md5 NOT IN (SELECT md5 FROM here)")
def parent_inventory(spark, sf):
    d = items(spark, sf)
    return neither_key(d.where("doc_id % 2 = 1"), d.where("doc_id % 2 = 0"), [("md5", "md5")]).select("doc_id", "md5", "size", "game")


@query(f"WITH {EDGES_SQL}, n AS (SELECT package, count(*) AS needs, CAST(max(CASE WHEN hard THEN 1 ELSE 0 END) AS BIGINT) AS any_hard FROM edges WHERE outcome = 0 GROUP BY package), p AS (SELECT package, count(DISTINCT supplier) AS peers FROM edges WHERE outcome = 1 AND supplier % 2 = 1 GROUP BY package) SELECT package AS required_package, needs, any_hard, coalesce(peers, 0) AS peers FROM n LEFT JOIN p USING (package)")
def child_needs(spark, sf):
    e = edges(spark, sf)
    n = e.where("outcome = 0").groupBy(F.col("package").alias("required_package")).agg(F.count("*").alias("needs"), F.max(F.when(F.col("hard"), 1).otherwise(0)).cast("long").alias("any_hard"))
    p = e.where("outcome = 1 AND supplier % 2 = 1").groupBy(F.col("package").alias("required_package")).agg(F.countDistinct("supplier").alias("peers"))
    return n.join(p, "required_package", "left").fillna(0, ["peers"])


_GUID = "CASE WHEN length(trim(text)) >= 12 THEN upper(md5(substr(text, 1, 24))) END"


@query(f"""WITH i AS (SELECT doc_id % 2 = 0 AS here, md5(coalesce(text, '')) AS md5, length(coalesce(text, '')) AS size, {_GUID} AS guid FROM documents),
a AS (SELECT 'guid' AS reason, guid AS identity, count(*) FILTER (WHERE here) AS here_rows, count(*) FILTER (WHERE NOT here) AS there_rows, count(DISTINCT md5) AS variants FROM i WHERE guid IS NOT NULL GROUP BY guid HAVING count(DISTINCT md5) > 1),
b AS (SELECT 'content', md5, count(*) FILTER (WHERE here), count(*) FILTER (WHERE NOT here), count(DISTINCT coalesce(guid, '') || ':' || size) FROM i WHERE size > 0 GROUP BY md5 HAVING count(DISTINCT coalesce(guid, '') || ':' || size) > 1 OR count(*) FILTER (WHERE here) > 1 AND count(*) FILTER (WHERE NOT here) > 1)
SELECT * FROM a WHERE here_rows > 0 AND there_rows > 0 UNION ALL SELECT * FROM b WHERE true""")
def inventory_conflicts(spark, sf):
    """Conflicts between two inventories, a row a group and never a pair of rows: one guid with several contents on both
    sides, or one content with several guids or sizes, or held more than once on both sides. Blanks never match."""
    i = table(spark, sf, "documents").select((F.col("doc_id") % 2 == 0).alias("here"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), F.length(F.coalesce("text", F.lit(""))).alias("size"), F.when(F.length(F.trim("text")) >= 12, F.upper(F.md5(F.substring("text", 1, 24).cast("binary")))).alias("guid"))
    both = [n_if(F.col("here")).alias("here_rows"), n_if(~F.col("here")).alias("there_rows")]
    a = i.where("guid IS NOT NULL").groupBy("guid").agg(*both, F.countDistinct("md5").alias("variants")).where("variants > 1 AND here_rows > 0 AND there_rows > 0")
    b = i.where("size > 0").groupBy("md5").agg(*both, F.countDistinct(F.coalesce("guid", F.lit("")), "size").alias("variants")).where("variants > 1 OR here_rows > 1 AND there_rows > 1")
    row = lambda reason, t, key: t.select(F.lit(reason).alias("reason"), F.col(key).alias("identity"), "here_rows", "there_rows", "variants")
    return row("guid", a, "guid").unionByName(row("content", b, "md5"))


@query(f"""WITH i AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, {_GUID} AS guid FROM documents), here AS (SELECT * FROM i WHERE doc_id % 2 = 0), there AS (SELECT * FROM i WHERE doc_id % 2 = 1)
SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM here h WHERE h.md5 = t.md5) OR EXISTS (SELECT 1 FROM here h WHERE h.guid = t.guid) THEN 'held' ELSE 'absent' END AS state FROM there t""")
def inventory_by_either_key(spark, sf):
    """Remote rows that are held here by content or by guid, and those held by neither: one equality join a key."""
    i = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), F.when(F.length(F.trim("text")) >= 12, F.upper(F.md5(F.substring("text", 1, 24).cast("binary")))).alias("guid"))
    here, there, pairs = i.where("doc_id % 2 = 0"), i.where("doc_id % 2 = 1"), [("md5", "md5"), ("guid", "guid")]
    return either_key(there, here, pairs, "doc_id").select("doc_id", F.lit("held").alias("state")).unionByName(neither_key(there, here, pairs).select("doc_id", F.lit("absent").alias("state")))


_POINTS = "CASE WHEN a = b THEN 40 WHEN regexp_replace(a, '[^a-z0-9]', '', 'g') = regexp_replace(b, '[^a-z0-9]', '', 'g') THEN 30 WHEN levenshtein(a, b) <= 2 THEN 20 WHEN levenshtein(a, b) <= 4 THEN 10 ELSE 0 END"


@query(f"WITH n AS (SELECT p_brand, min(lower(p_name)) AS a, max(lower(p_name)) AS b FROM part GROUP BY p_brand) SELECT p_brand, a, b, {_POINTS} AS points FROM n")
def name_similarity(spark, sf):
    n = table(spark, sf, "part").groupBy("p_brand").agg(F.min(F.lower("p_name")).alias("a"), F.max(F.lower("p_name")).alias("b"))
    return n.withColumn("points", similarity_points(F.col("a"), F.col("b")))


def similarity_points(a, b):
    """40 equal, 30 equal but for punctuation, 20 within two edits, 10 within four, else 0."""
    plain = lambda s: F.regexp_replace(s, "[^a-z0-9]", "")
    distance = F.levenshtein(a, b)
    return F.when(a == b, 40).when(plain(a) == plain(b), 30).when(distance <= 2, 20).when(distance <= 4, 10).otherwise(0)


@query(f"""WITH {EDGES_SQL}, m AS (SELECT object_name, package, count(*) AS missing FROM edges WHERE outcome = 0 GROUP BY ALL), c AS (SELECT object_name, package AS found_in, count(DISTINCT supplier) AS fan_out FROM edges WHERE outcome = 1 GROUP BY ALL HAVING count(DISTINCT supplier) <= 40),
s AS (SELECT m.package, found_in, CAST(sum(missing) AS BIGINT) AS evidence, {_POINTS.replace('(a', '(lower(m.package)').replace('a = b', 'lower(m.package) = lower(found_in)').replace(', b)', ', lower(found_in))').replace('(b,', '(lower(found_in),')} AS points FROM m JOIN c USING (object_name) WHERE m.package <> found_in GROUP BY ALL)
SELECT package, found_in, evidence, points, row_number() OVER (PARTITION BY package ORDER BY points DESC, evidence DESC, found_in) AS rank FROM s""")
def misnamed_candidates(spark, sf):
    e = edges(spark, sf)
    m = e.where("outcome = 0").groupBy("object_name", "package").agg(F.count("*").alias("missing"))
    c = e.where("outcome = 1").groupBy("object_name", F.col("package").alias("found_in")).agg(F.countDistinct("supplier").alias("fan_out")).where("fan_out <= 40")
    s = m.join(c, "object_name").where("package <> found_in").groupBy("package", "found_in").agg(F.sum("missing").alias("evidence"))
    s = s.withColumn("points", similarity_points(F.lower("package"), F.lower("found_in")))
    return s.withColumn("rank", F.row_number().over(W.partitionBy("package").orderBy(F.desc("points"), F.desc("evidence"), "found_in")))


@query(f"WITH {_D} SELECT ext, game, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes, CAST(count(*) FILTER (WHERE size = 0) AS BIGINT) AS empty FROM d GROUP BY ALL")
def storage_by_type(spark, sf):
    return items(spark, sf).groupBy("ext", "game").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), n_if(F.col("size") == 0).alias("empty"))


@query("""WITH h AS (SELECT page_id, hex(encode(coalesce(html, ''))) AS h, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT page_id, sha256(concat_ws(':', n::VARCHAR, substr(h, 1, 128), substr(h, 2 * floor(n / 4)::INT + 1, 128), substr(h, 2 * floor(n / 2)::INT + 1, 128), substr(h, 2 * floor(n * 3 / 4)::INT + 1, 128), substr(h, 2 * greatest(0, n - 64) + 1, 128))) AS fingerprint FROM h)
SELECT fingerprint, count(*) AS sources, min(page_id) AS first_source FROM f GROUP BY fingerprint""")
def source_fingerprints(spark, sf):
    """Sources by their quick fingerprint: five windows of 64 bytes here."""
    p = table(spark, sf, "pages").select("page_id", quick_fingerprint(F.coalesce("html", F.lit("")).cast("binary"), 64).alias("fingerprint"))
    return p.groupBy("fingerprint").agg(F.count("*").alias("sources"), F.min("page_id").alias("first_source"))
