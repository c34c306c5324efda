"""Secondary read models: counters, identity, conflicts, lookups, cache states and classifications."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..operators.joins import range_lookup
from ..operators.rollup import n_if
from ..registry import query
from ..tables import EDGES_SQL, FILES_SQL, edges, files, owned_edges, table
from .inventory import _D, items
from .queue import _J, NOW, jobs


@query(f"WITH {_J} SELECT parent, count(*) AS children, CAST(count(*) FILTER (WHERE status = 'queued') AS BIGINT) AS queued, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running, CAST(count(*) FILTER (WHERE status = 'done') AS BIGINT) AS done FROM j GROUP BY parent")
def job_child_states(spark, sf):
    state = lambda s: n_if(F.col("status") == s).alias(s)
    return jobs(spark, sf).groupBy("parent").agg(F.count("*").alias("children"), state("queued"), state("running"), state("done"))


@query("SELECT 'files' AS counter, count(*) AS value FROM orders UNION ALL SELECT 'edges', count(*) FROM lineitem UNION ALL SELECT 'packages', count(DISTINCT p_brand) FROM part UNION ALL SELECT 'providers', count(*) FROM supplier UNION ALL SELECT 'errors', count(*) FILTER (WHERE event_type = 'error') FROM events UNION ALL SELECT 'stored', CAST(sum(length(coalesce(text, ''))) AS BIGINT) FROM documents")
def dashboard_counters(spark, sf):
    """One aggregate a table, put below one another: no join."""
    of = lambda name, t, value: table(spark, sf, t).agg(value.alias("value")).select(F.lit(name).alias("counter"), F.col("value").cast("long").alias("value"))
    out = of("files", "orders", F.count("*")).unionByName(of("edges", "lineitem", F.count("*"))).unionByName(of("packages", "part", F.countDistinct("p_brand"))).unionByName(of("providers", "supplier", F.count("*")))
    return out.unionByName(of("errors", "events", F.count_if(F.col("event_type") == "error"))).unionByName(of("stored", "documents", F.sum(F.length(F.coalesce("text", F.lit(""))))))


@query(f"WITH {EDGES_SQL}, {FILES_SQL} SELECT lower(package) AS package, game_id, count(*) AS refs, count(DISTINCT file_id) AS files FROM edges JOIN files USING (file_id) GROUP BY ALL")
def reference_matches(spark, sf):
    """By file first, so the number of files is a count of rows."""
    by_file = owned_edges(spark, sf).groupBy("file_id", "game_id", F.lower("package").alias("package")).agg(F.count("*").alias("refs"))
    return by_file.groupBy("package", "game_id").agg(F.sum("refs").alias("refs"), F.count("*").alias("files"))


@query(f"WITH {_D} SELECT game, md5, min(doc_id) AS first_id, count(*) AS copies FROM d GROUP BY ALL")
def first_file_by_identity(spark, sf):
    return items(spark, sf).groupBy("game", "md5").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("copies"))


@query(f"WITH {_D} SELECT ext, CASE WHEN ext IN ('en') THEN 'map' WHEN ext IN ('de', 'fr') THEN 'texture' ELSE 'other' END AS bucket, count(*) AS files FROM d GROUP BY ALL")
def type_buckets(spark, sf):
    bucket = F.when(F.col("ext").isin("en"), "map").when(F.col("ext").isin("de", "fr"), "texture").otherwise("other")
    return items(spark, sf).groupBy("ext", bucket.alias("bucket")).agg(F.count("*").alias("files"))


@query(f"WITH {FILES_SQL} SELECT game_id, status, policy_current, payload_current, count(*) AS files, round(sum(size), 2) AS bytes FROM files GROUP BY ALL")
def readiness_counts(spark, sf):
    return files(spark, sf).groupBy("game_id", "status", "policy_current", "payload_current").agg(F.count("*").alias("files"), F.round(F.sum("size"), 2).alias("bytes"))


@query("SELECT CAST(date_trunc('day', ts) AS DATE) AS day, event_type AS kind, count(*) AS issues, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL")
def issue_histogram(spark, sf):
    return table(spark, sf, "events").groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("kind")).agg(F.count("*").alias("issues"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))


@query(f"WITH {EDGES_SQL}, u AS (SELECT file_id, count(DISTINCT package) AS uses FROM edges GROUP BY file_id), b AS (SELECT provider AS file_id, count(DISTINCT file_id) AS used_by FROM edges WHERE provider IS NOT NULL GROUP BY provider) SELECT file_id, coalesce(uses, 0) AS uses, coalesce(used_by, 0) AS used_by FROM u FULL JOIN b USING (file_id)")
def uses_rollup(spark, sf):
    e = edges(spark, sf)
    u = e.groupBy("file_id").agg(F.countDistinct("package").alias("uses"))
    b = e.where("provider IS NOT NULL").groupBy(F.col("provider").alias("id")).agg(F.countDistinct("file_id").alias("used_by"))
    return u.join(b, u["file_id"] == b["id"], "full").select(F.coalesce("file_id", "id").alias("file_id"), F.coalesce("uses", F.lit(0)).alias("uses"), F.coalesce("used_by", F.lit(0)).alias("used_by"))


#: Package versions of engine families.
ENGINES = [(1, 34, 99), (2, 100, 199), (3, 334, 867)]
_ENGINE = "CASE " + " ".join(f"WHEN v BETWEEN {lo} AND {hi} THEN {e}" for e, lo, hi in ENGINES) + " END"
#: Engine of the file that may serve games of other engines.
_SERVES = {1: (1, 2), 2: (2,), 3: (3,), 4: (4, 5), 5: (5,)}


@query(f"WITH v AS (SELECT p_partkey, CAST(p_size * 17 AS INTEGER) AS v FROM part) SELECT p_partkey, v AS version, {_ENGINE} AS engine, CASE {_ENGINE} WHEN 1 THEN '1,2' WHEN 2 THEN '2' WHEN 3 THEN '3' END AS serves FROM v")
def engine_by_version(spark, sf):
    v = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 17).cast("int").alias("v"))
    serves = F.create_map(*[F.lit(x) for e, s in _SERVES.items() for x in (e, ",".join(map(str, s)))])
    return v.withColumn("engine", F.expr(_ENGINE)).select("p_partkey", F.col("v").alias("version"), "engine", F.try_element_at(serves, F.col("engine")).alias("serves"))


#: Rules of a profile in order: (name, versions from, to). The first that accepts a header wins.
RULES = '[{"name":"old","lo":0,"hi":150},{"name":"retail","lo":100,"hi":600},{"name":"late","lo":500,"hi":900}]'


@query("SELECT p_partkey, CASE WHEN p_size * 17 <= 150 THEN 'old' WHEN p_size * 17 BETWEEN 100 AND 600 THEN 'retail' WHEN p_size * 17 BETWEEN 500 AND 900 THEN 'late' END AS rule FROM part")
def compatibility_rule(spark, sf):
    rules = F.from_json(F.lit(RULES), "array<struct<name:string,lo:int,hi:int>>")
    accepted = F.filter(rules, lambda r: (F.col("p_size") * 17).between(r["lo"], r["hi"]))
    return table(spark, sf, "part").select("p_partkey", F.get(accepted, F.lit(0))["name"].alias("rule"))


#: Private and reserved IPv4 ranges, as numbers of their first and last address.
RESERVED = [(a << 24 | b << 16, (a << 24 | b << 16) + (1 << (32 - bits)) - 1) for a, b, bits in ((0, 0, 8), (10, 0, 8), (100, 64, 10), (127, 0, 8), (169, 254, 16), (172, 16, 12), (192, 168, 16), (224, 0, 4), (240, 0, 4))]
_IP = "(user_id * 2654435761 + event_id * 40503) % 4294967296"


@query(f"SELECT event_id, {_IP} AS ip FROM events WHERE NOT (" + " OR ".join(f"{_IP} BETWEEN {lo} AND {hi}" for lo, hi in RESERVED) + ")")
def public_addresses(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_IP).alias("ip"))
    reserved = F.lit(False)
    for lo, hi in RESERVED:
        reserved = reserved | F.col("ip").between(lo, hi)
    return e.where(~reserved)


@query("WITH r AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_brand) END AS remote_name, p_partkey % 25 AS game_id FROM part), g AS (SELECT n_nationkey, n_name FROM nation) SELECT p_partkey, coalesce(g.n_name, remote_name) AS game FROM r LEFT JOIN g ON remote_name IS NULL AND game_id = g.n_nationkey")
def remote_or_local_game(spark, sf):
    """The join key exists only where there is no remote name, so one equality join serves both cases."""
    r = table(spark, sf, "part").select("p_partkey", F.when(F.col("p_size") % 2 == 0, F.upper("p_brand")).alias("remote_name"), (F.col("p_partkey") % 25).alias("game_id"))
    r = r.withColumn("k", F.when(F.col("remote_name").isNull(), F.col("game_id")))
    g = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), "n_name")
    return r.join(g, "k", "left").select("p_partkey", F.coalesce("n_name", "remote_name").alias("game"))


_KEYED = f"{_D}, k AS (SELECT doc_id, md5, size, CASE WHEN doc_id % 3 = 0 THEN '' ELSE md5(CAST(size AS VARCHAR)) END AS guid FROM d)"


@query(f"WITH {_KEYED}, g AS (SELECT guid AS key, 'guid' AS kind, count(*) AS files, count(DISTINCT md5) AS others FROM k WHERE guid <> '' GROUP BY guid), m AS (SELECT md5 AS key, 'md5' AS kind, count(*) AS files, count(DISTINCT guid) AS others FROM k WHERE guid <> '' GROUP BY md5) SELECT * FROM g WHERE others > 1 UNION ALL SELECT * FROM m WHERE others > 1")
def identity_conflicts(spark, sf):
    """Groups with one identifier and several contents, or the reverse; blanks never match. Groups, not pairs."""
    k = items(spark, sf).select("md5", F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.md5(F.col("size").cast("string").cast("binary"))).alias("guid")).where("guid <> ''")
    side = lambda kind, other: k.groupBy(F.col(kind).alias("key"), F.lit(kind).alias("kind")).agg(F.count("*").alias("files"), F.countDistinct(other).alias("others")).where("others > 1")
    return side("guid", "md5").unionByName(side("md5", "guid"))


@query(f"WITH {EDGES_SQL}, x AS (SELECT file_id, source_index, outcome AS want FROM edges WHERE supplier % 5 <> 0), y AS (SELECT file_id, source_index, CASE WHEN object_id % 9 = 0 THEN 4 ELSE outcome END AS have FROM edges WHERE supplier % 7 <> 0) SELECT file_id, source_index, CASE WHEN have IS NULL THEN 'add' WHEN want IS NULL THEN 'remove' ELSE 'change' END AS action FROM (SELECT file_id, source_index, min(want) AS want, min(have) AS have, count(want) AS nw, count(have) AS nh FROM (SELECT file_id, source_index, want, NULL AS have FROM x UNION ALL SELECT file_id, source_index, NULL, have FROM y) GROUP BY ALL) WHERE want IS DISTINCT FROM have")
def projection_difference(spark, sf):
    """Expected against stored rows by key, in one shuffle: what to add, remove and change."""
    e = edges(spark, sf)
    want = e.where("supplier % 5 <> 0").select("file_id", "source_index", F.col("outcome").alias("want"), F.lit(None).cast("int").alias("have"))
    have = e.where("supplier % 7 <> 0").select("file_id", "source_index", F.lit(None).cast("int").alias("want"), F.when(F.col("object_id") % 9 == 0, 4).otherwise(F.col("outcome")).alias("have"))
    both = want.unionByName(have).groupBy("file_id", "source_index").agg(F.min("want").alias("want"), F.min("have").alias("have")).where(~F.col("want").eqNullSafe(F.col("have")))
    return both.select("file_id", "source_index", F.when(F.col("have").isNull(), "add").when(F.col("want").isNull(), "remove").otherwise("change").alias("action"))


@query("SELECT lower(name) AS key, arg_min(name, (origin, name)) AS name FROM (SELECT p_brand AS name, 1 AS origin FROM part UNION ALL SELECT upper(p_brand), 2 FROM part WHERE p_size > 10 UNION ALL SELECT n_name, 3 FROM nation UNION ALL SELECT lower(n_name), 4 FROM nation) GROUP BY lower(name)")
def base_name_set(spark, sf):
    """Names of four origins, one a case-folded key, in the spelling of the first origin."""
    p, n = table(spark, sf, "part"), table(spark, sf, "nation")
    of = lambda df, c, i: df.select(c.alias("name"), F.lit(i).alias("origin"))
    names = of(p, F.col("p_brand"), 1).unionByName(of(p.where("p_size > 10"), F.upper("p_brand"), 2)).unionByName(of(n, F.col("n_name"), 3)).unionByName(of(n, F.lower("n_name"), 4))
    return names.groupBy(F.lower("name").alias("key")).agg(F.min_by("name", F.struct("origin", "name")).alias("name"))


_UP = f"{_D}, here AS (SELECT md5, size, min(doc_id) AS known_id, count(DISTINCT game) AS games FROM d WHERE doc_id % 2 = 0 GROUP BY ALL)"


@query(f"WITH {_UP} SELECT u.doc_id, known_id, CASE WHEN known_id IS NULL THEN 'accept' WHEN games > 1 THEN 'duplicate_many' ELSE 'duplicate' END AS decision FROM (SELECT * FROM d WHERE doc_id % 2 = 1) u LEFT JOIN here USING (md5, size)")
def upload_decisions(spark, sf):
    d = items(spark, sf)
    here = d.where("doc_id % 2 = 0").groupBy("md5", "size").agg(F.min("doc_id").alias("known_id"), F.countDistinct("game").alias("games"))
    u = d.where("doc_id % 2 = 1").select("doc_id", "md5", "size").join(here, ["md5", "size"], "left")
    return u.select("doc_id", "known_id", F.when(F.col("known_id").isNull(), "accept").when(F.col("games") > 1, "duplicate_many").otherwise("duplicate").alias("decision"))


@query("SELECT lower(p_brand || '/' || p_name) AS path, count(*) AS packages, min(p_partkey) AS first_id FROM part GROUP BY ALL HAVING count(*) > 1")
def install_path_conflicts(spark, sf):
    return table(spark, sf, "part").groupBy(F.lower(F.concat("p_brand", F.lit("/"), "p_name")).alias("path")).agg(F.count("*").alias("packages"), F.min("p_partkey").alias("first_id")).where("packages > 1")


@query(f"WITH {EDGES_SQL}, w AS (SELECT DISTINCT lower(object_name) AS ref FROM edges), h AS (SELECT lower(p_name) AS ref, count(*) AS n, min(p_partkey) AS id FROM part WHERE p_size < 12 GROUP BY ALL) SELECT ref, coalesce(n, 0) AS hits, CASE WHEN n = 1 THEN id END AS found, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'several' END AS status FROM w LEFT JOIN h USING (ref)")
def static_lookup(spark, sf):
    w = edges(spark, sf).select(F.lower("object_name").alias("ref")).distinct()
    h = table(spark, sf, "part").where("p_size < 12").groupBy(F.lower("p_name").alias("ref")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("id"))
    n = F.col("n")
    return w.join(h, "ref", "left").select("ref", F.coalesce("n", F.lit(0)).alias("hits"), F.when(n == 1, F.col("id")).alias("found"), F.when(n.isNull(), "none").when(n == 1, "one").otherwise("several").alias("status"))


@query(f"WITH {EDGES_SQL}, w AS (SELECT DISTINCT object_name AS package FROM edges), p AS (SELECT lower(p_name) AS key, 1 AS stage, p_partkey AS id FROM part WHERE p_size > 30 UNION ALL SELECT lower(p_type || ' ' || p_name), 2, p_partkey FROM part UNION ALL SELECT lower(p_name), 2, p_partkey FROM part) SELECT package, min(stage) AS stage, arg_min(id, (stage, id)) AS provider FROM w JOIN p ON lower(package) = key GROUP BY package")
def staged_package_match(spark, sf):
    """Primary names first, aliases where no primary name fits; the smallest identifier of the stage."""
    w, p = edges(spark, sf).select(F.col("object_name").alias("package")).distinct(), table(spark, sf, "part")
    of = lambda df, key, stage: df.select(F.lower(key).alias("key"), F.lit(stage).alias("stage"), F.col("p_partkey").alias("id"))
    names = of(p.where("p_size > 30"), F.col("p_name"), 1).unionByName(of(p, F.concat_ws(" ", "p_type", "p_name"), 2)).unionByName(of(p, F.col("p_name"), 2))
    best = names.groupBy("key").agg(F.min(F.struct("stage", "id")).alias("b"))
    return w.join(best, F.lower("package") == F.col("key")).select("package", "b.stage", F.col("b.id").alias("provider"))


@query("SELECT l_partkey AS package_id, min(l_linenumber) AS backend, arg_min(l_suppkey, (l_linenumber, l_orderkey)) AS entry, count(*) AS offers FROM lineitem GROUP BY l_partkey")
def backend_arbitration(spark, sf):
    """Backends in mount order: the first entry for a package wins. An aggregate, so copies combine before the shuffle."""
    return table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("package_id")).agg(F.min("l_linenumber").alias("backend"), F.min_by("l_suppkey", F.struct("l_linenumber", "l_orderkey")).alias("entry"), F.count("*").alias("offers"))


_HOST = r"regexp_extract(url, '://([^/?#]*)', 1)"


@query(f"WITH n AS (SELECT page_id, lower(regexp_extract(url, '/([^/?#]*)([?#].*)?$', 1)) AS expected, lower(regexp_extract(html, '<title>([^<%*#]*)', 1)) AS actual FROM pages) SELECT page_id, expected, actual, CASE WHEN expected = '' THEN 'no_source' WHEN trim(actual) = trim(expected) THEN 'equal' ELSE 'differs' END AS verdict FROM n")
def source_identity_audit(spark, sf):
    n = table(spark, sf, "pages").select("page_id", F.lower(F.regexp_extract("url", "/([^/?#]*)([?#].*)?$", 1)).alias("expected"), F.lower(F.regexp_extract("html", "<title>([^<%*#]*)", 1)).alias("actual"))
    return n.withColumn("verdict", F.when(F.col("expected") == "", "no_source").when(F.trim("actual") == F.trim("expected"), "equal").otherwise("differs"))


@query(f"SELECT {_HOST} AS route, count(*) AS samples, CAST(sum(length(html)) AS BIGINT) AS total, max(length(html)) AS most, CAST(floor(sum(length(html)) / count(*)) AS BIGINT) AS average, sum(length(html)) / count(*) > 3000 AS slow FROM pages GROUP BY ALL")
def route_audit(spark, sf):
    n = F.length("html").cast("long")
    s = table(spark, sf, "pages").groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("route")).agg(F.count("*").alias("samples"), F.sum(n).alias("total"), F.max(n).alias("most"))
    return s.withColumn("average", F.floor(F.col("total") / F.col("samples"))).withColumn("slow", F.col("total") / F.col("samples") > 3000)


@query(f"WITH {FILES_SQL} SELECT file_id, game_id, CASE WHEN file_id % 5 = 0 THEN 'pending' WHEN NOT payload_current THEN 'version_stale' WHEN status = 'P' THEN 'failed' ELSE 'ready' END AS state FROM files")
def match_cache_state(spark, sf):
    state = F.when(F.col("file_id") % 5 == 0, "pending").when(~F.col("payload_current"), "version_stale").when(F.col("status") == "P", "failed").otherwise("ready")
    return files(spark, sf).select("file_id", "game_id", state.alias("state"))


@query(f"WITH {EDGES_SQL}, c AS (SELECT DISTINCT file_id FROM edges) SELECT coalesce(o_orderkey, file_id) AS file_id, CASE WHEN file_id IS NULL THEN 'no_bytes' ELSE 'no_row' END AS problem FROM (SELECT o_orderkey FROM orders WHERE o_custkey % 9 <> 0) FULL JOIN c ON o_orderkey = file_id WHERE o_orderkey IS NULL OR file_id IS NULL")
def storage_audit(spark, sf):
    """Catalogue rows against stored files, both ways."""
    rows = table(spark, sf, "orders").where("o_custkey % 9 <> 0").select("o_orderkey")
    stored = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey"), F.col("l_partkey") == F.col("p_partkey"), "left_semi").select(F.col("l_orderkey").alias("file_id")).distinct()
    return rows.join(stored, F.col("o_orderkey") == F.col("file_id"), "full").where("o_orderkey IS NULL OR file_id IS NULL").select(F.coalesce("o_orderkey", "file_id").alias("file_id"), F.when(F.col("file_id").isNull(), "no_bytes").otherwise("no_row").alias("problem"))


@query(f"WITH {EDGES_SQL}, m AS (SELECT DISTINCT package FROM edges WHERE outcome = 0), b AS (SELECT DISTINCT lower(p_brand) AS k FROM part WHERE p_size = 1) SELECT p_partkey, p_brand AS package, p_brand IN (SELECT package FROM m) AND lower(p_brand) NOT IN (SELECT k FROM b) AS needed FROM part")
def still_needed(spark, sf):
    """If a requested package is missing still, and no base name."""
    p = table(spark, sf, "part")
    m = edges(spark, sf).where("outcome = 0").select(F.col("package")).distinct().withColumn("missing", F.lit(True))
    b = p.where("p_size = 1").select(F.lower("p_brand").alias("k")).distinct().withColumn("base", F.lit(True))
    r = p.select("p_partkey", F.col("p_brand").alias("package")).join(m, "package", "left").join(b, F.lower("package") == F.col("k"), "left")
    return r.select("p_partkey", "package", (F.col("missing").isNotNull() & F.col("base").isNull()).alias("needed"))


#: Classes of failures, in order of precedence.
CLASSES = [("truncated", "eof|truncated|short read"), ("bad_tag", "magic|signature|not a package"), ("version", "version"), ("io", "timeout|refused|reset")]
_MESSAGES = ["Unexpected EOF at 120", "Bad magic 0x12", "unsupported VERSION 900", "connection reset", "other trouble", "bad version, truncated"]
_MSG = "CASE event_id % 6 " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate(_MESSAGES)) + " END"


@query(f"WITH m AS (SELECT event_type, {_MSG} AS message FROM events) SELECT event_type, CASE " + " ".join(f"WHEN regexp_matches(lower(message), '{p}') THEN '{c}'" for c, p in CLASSES) + " ELSE 'unknown' END AS class, count(*) AS n FROM m GROUP BY ALL")
def error_classes(spark, sf):
    m = table(spark, sf, "events").select("event_type", F.expr(_MSG).alias("message"))
    found = F.lit("unknown")
    for c, pattern in reversed(CLASSES):
        found = F.when(F.lower("message").rlike(pattern), c).otherwise(found)
    return m.groupBy("event_type", found.alias("class")).agg(F.count("*").alias("n"))


@query(f"WITH {EDGES_SQL} SELECT file_id, count(*) AS rows, sha256(string_agg(concat_ws(chr(0), source_index, package, object_name, outcome), chr(10) ORDER BY source_index, package, object_name, outcome)) AS fingerprint FROM edges GROUP BY file_id")
def section_fingerprints(spark, sf):
    """A hash of each file's rows in order; one file's section is what a task holds."""
    line = F.concat_ws("\u0000", F.col("source_index").cast("string"), "package", "object_name", F.col("outcome").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("source_index", "package", "object_name", "outcome", line.alias("line"))))
    s = edges(spark, sf).groupBy("file_id").agg(F.count("*").alias("rows"), rows.alias("r"))
    return s.select("file_id", "rows", F.sha2(F.array_join("r.line", "\n").cast("binary"), 256).alias("fingerprint"))


_PATH = "lower(p_type || '.' || replace(p_name, ' ', '.'))"


@query(f"SELECT p_partkey, {_PATH} AS path, {_PATH} = 'standard.small' AS whole FROM part WHERE {_PATH} = 'standard.small' OR starts_with({_PATH}, 'standard.small.')")
def dotted_path_search(spark, sf):
    """The path itself and what lies below it."""
    p = table(spark, sf, "part").select("p_partkey", F.lower(F.concat("p_type", F.lit("."), F.replace("p_name", F.lit(" "), F.lit(".")))).alias("path"))
    return p.where((F.col("path") == "standard.small") | F.col("path").startswith("standard.small.")).withColumn("whole", F.col("path") == "standard.small")


#: Lines Old=New of two texts; the later text wins.
REMAPS = ("ECONOMY=Basic\nPROMO=Offer", "PROMO=Special\n# note\nLARGE = Wide")
_REMAPPED = {"economy": "Basic", "promo": "Special", "large": "Wide"}


@query("SELECT p_partkey, CASE lower(p_type) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _REMAPPED.items()) + " ELSE p_type END AS class FROM part")
def class_remap(spark, sf):
    pairs: dict[str, str] = {}
    for text in REMAPS:
        pairs |= {a.strip().lower(): b.strip() for a, eq, b in (line.partition("=") for line in text.splitlines()) if eq}
    remap = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return table(spark, sf, "part").select("p_partkey", F.coalesce(F.try_element_at(remap, F.lower("p_type")), "p_type").alias("class"))


@query(f"WITH {EDGES_SQL}, m AS (SELECT DISTINCT package, object_name AS field, supplier AS value FROM edges) SELECT package, field, value FROM (SELECT *, row_number() OVER (PARTITION BY package ORDER BY field, value) AS n FROM m) WHERE n <= 12")
def matches_shown(spark, sf):
    """Different (field, value) matches, 12 a package: a display limit of the report."""
    m = edges(spark, sf).select("package", F.col("object_name").alias("field"), F.col("supplier").alias("value")).distinct()
    return m.withColumn("n", F.row_number().over(W.partitionBy("package").orderBy("field", "value"))).where("n <= 12").drop("n")


@query(f"WITH {EDGES_SQL}, x AS (SELECT lower(trim(p_name)) AS k, p_brand AS package, count(*) AS n, arg_min(p_partkey, (CASE WHEN p_name = lower(p_name) THEN 0 ELSE 1 END, p_partkey)) AS export FROM part WHERE p_size % 4 <> 0 GROUP BY ALL) SELECT e.file_id, e.source_index, e.package, x.export, coalesce(x.n, 0) > 25 AS overflow FROM edges e LEFT JOIN x ON lower(trim(e.object_name)) = x.k AND e.package = x.package")
def export_resolution(spark, sf):
    """Imports to exports of the same package by case-folded name; an exact spelling wins; above 25 candidates is overflow."""
    p = table(spark, sf, "part").where("p_size % 4 <> 0")
    exact = F.when(F.col("p_name") == F.lower("p_name"), 0).otherwise(1)
    x = p.groupBy(name_key(F.col("p_name")).alias("k"), F.col("p_brand").alias("package")).agg(F.count("*").alias("n"), F.min_by("p_partkey", F.struct(exact, "p_partkey")).alias("export"))
    e = edges(spark, sf).select("file_id", "source_index", "package", name_key(F.col("object_name")).alias("k"))
    return e.join(x, ["k", "package"], "left").select("file_id", "source_index", "package", "export", (F.coalesce("n", F.lit(0)) > 25).alias("overflow"))


@query(f"WITH {_J} SELECT j.id, j.parent, epoch(TIMESTAMP '{NOW}' - available_at) > 86400 * 365 AS orphaned FROM j WHERE status = 'running'")
def orphaned_jobs(spark, sf):
    """Running jobs whose last sign of life is older than the lease."""
    return jobs(spark, sf).where("status = 'running'").select("id", "parent", (F.expr(f"timestampdiff(SECOND, available_at, TIMESTAMP '{NOW}')") > 86400 * 365).alias("orphaned"))


@query(f"WITH {_J}, q AS (SELECT *, row_number() OVER (PARTITION BY queue, parent ORDER BY available_at, id) AS n FROM j WHERE status = 'queued'), p AS (SELECT queue, count(DISTINCT parent) AS parents FROM q GROUP BY queue) SELECT id, queue, parent, parents = 1 OR n <= 2 AS fair FROM q JOIN p USING (queue)")
def fair_claims(spark, sf):
    """Two jobs a root where another root competes in the queue."""
    q = jobs(spark, sf).where("status = 'queued'").select("id", "queue", "parent", "available_at")
    p = q.groupBy("queue").agg(F.countDistinct("parent").alias("parents"))
    q = q.withColumn("n", F.row_number().over(W.partitionBy("queue", "parent").orderBy("available_at", "id")))
    return q.join(p, "queue").select("id", "queue", "parent", ((F.col("parents") == 1) | (F.col("n") <= 2)).alias("fair"))


@query("SELECT event_id, ts, user_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00'")
def retained_events(spark, sf):
    return table(spark, sf, "events").where("ts >= TIMESTAMP '2024-01-15 00:00:00'").select("event_id", "ts", "user_id")


@query(f"WITH {_D} SELECT doc_id, md5, CASE WHEN repeat('0', 2) = left(md5, 2) THEN 'zero' ELSE 'set' END AS guid_state FROM d WHERE starts_with(md5, '00')")
def zero_prefix_identities(spark, sf):
    return items(spark, sf).where(F.col("md5").startswith("00")).select("doc_id", "md5", F.lit("zero").alias("guid_state"))


_BANDS = [(0, 99, "small"), (100, 499, "medium"), (500, 9_999, "large")]


@query(f"WITH {_D} SELECT doc_id, size, CASE " + " ".join(f"WHEN size BETWEEN {lo} AND {hi} THEN '{b}'" for lo, hi, b in _BANDS) + " END AS band FROM d")
def size_bands(spark, sf):
    bands = spark.createDataFrame(_BANDS, "lo long, hi long, band string")
    return range_lookup(items(spark, sf).select("doc_id", "size"), bands, "size", "lo", "hi", "band")
