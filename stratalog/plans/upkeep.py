"""Export plans, identity surgery, stored rows of later engines, retirement and repair."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import fname_key, name_key, path_key, stem_key
from ..operators import graph
from ..operators.joins import either_key
from ..operators.rollup import n_if
from ..registry import query
from ..tables import EDGES_SQL, FILES_SQL, edges, files, owned_edges, table

#: Files need what the providers of their resolved edges are; a provider's own needs are those of the file with its number.
_NEEDS = f"{EDGES_SQL}, {FILES_SQL}, needs AS (SELECT DISTINCT file_id AS src, CAST(provider * 7 + 1 AS BIGINT) AS dst FROM edges WHERE outcome = 1)"


def needs(spark, sf):
    return edges(spark, sf).where("outcome = 1").select(F.col("file_id").alias("src"), (F.col("provider") * 7 + 1).cast("long").alias("dst")).distinct()


@query(f"""WITH RECURSIVE {_NEEDS}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN needs ON src = node WHERE depth < 60),
c AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), f AS (SELECT node, depth, size, game_id, game_id % 5 = 0 AS base FROM c JOIN files ON file_id = node),
s AS (SELECT *, row_number() OVER (ORDER BY depth DESC, node) AS place, sum(CASE WHEN base THEN 0 ELSE size END) OVER (ORDER BY depth DESC, node ROWS UNBOUNDED PRECEDING) AS bytes FROM f)
SELECT node AS file_id, CAST(depth AS BIGINT) AS depth, base AS blocked, NOT base AND place <= 400 AND bytes <= 3e7 AS exported, round(bytes, 2) AS bytes FROM s""")
def export_plan(spark, sf):
    """What goes with a file when it is exported: its closure, deeper files first, those of base games blocked, up to 400
    files and 30 million bytes. The closure of one export is what one plan holds."""
    c = graph.closure(needs(spark, sf), [1])
    f = c.join(files(spark, sf).select(F.col("file_id").alias("node"), "size", "game_id"), "node").withColumn("base", F.col("game_id") % 5 == 0)
    upto = W.orderBy(F.desc("depth"), "node")
    s = f.withColumn("place", F.row_number().over(upto)).withColumn("bytes", F.sum(F.when(F.col("base"), 0).otherwise(F.col("size"))).over(upto.rowsBetween(W.unboundedPreceding, 0)))
    return s.select(F.col("node").alias("file_id"), "depth", F.col("base").alias("blocked"), (~F.col("base") & (F.col("place") <= 400) & (F.col("bytes") <= 3e7)).alias("exported"), F.round("bytes", 2).alias("bytes"))


@query(f"""WITH RECURSIVE {_NEEDS}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN needs ON src = node WHERE depth < 60), c AS (SELECT DISTINCT node FROM r),
p AS (SELECT node, lower(p_brand || '/' || split_part(p_name, ' ', 1)) AS path FROM c JOIN part ON p_partkey = node % 2000 + 1)
SELECT path, count(*) AS files, min(node) AS first_file FROM p GROUP BY path HAVING count(*) > 1""")
def export_path_conflicts(spark, sf):
    """Install paths that several files of an export would write to."""
    c = graph.closure(needs(spark, sf), [1]).select("node", (F.col("node") % 2000 + 1).alias("p_partkey"))
    p = c.join(table(spark, sf, "part"), "p_partkey").select("node", F.lower(F.concat("p_brand", F.lit("/"), F.split("p_name", " ")[0])).alias("path"))
    return p.groupBy("path").agg(F.count("*").alias("files"), F.min("node").alias("first_file")).where("files > 1")


@query(f"""WITH RECURSIVE {_NEEDS}, r AS (SELECT CAST(1 AS BIGINT) AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM r JOIN needs ON src = node WHERE depth < 60), c AS (SELECT DISTINCT node FROM r)
SELECT count(DISTINCT CASE WHEN outcome = 0 THEN package END) AS missing, count(DISTINCT CASE WHEN outcome = 4 THEN package END) AS unresolved, count(DISTINCT CASE WHEN outcome = 2 THEN package END) AS package_only, count(DISTINCT file_id) AS files FROM edges WHERE file_id IN (SELECT node FROM c)""")
def closure_gaps(spark, sf):
    """Different packages that a closure lacks, by kind of gap."""
    c = graph.closure(needs(spark, sf), [1]).select(F.col("node").alias("file_id"))
    gap = lambda k: F.countDistinct(F.when(F.col("outcome") == k, F.col("package")))
    return edges(spark, sf).join(c, "file_id", "left_semi").agg(gap(0).alias("missing"), gap(4).alias("unresolved"), gap(2).alias("package_only"), F.countDistinct("file_id").alias("files"))


_HEX = "h AS (SELECT p_partkey, upper(lpad(to_hex(p_partkey * 7919), 32, '0')) AS guid FROM part)"


@query(f"WITH {_HEX} SELECT p_partkey, substr(guid, 1, 8) || '-' || substr(guid, 9, 8) || '-' || substr(guid, 17, 8) || '-' || substr(guid, 25, 8) AS dashed, guid = repeat('0', 32) OR p_partkey % 50 = 0 AS zero, substr(guid, 17, 16) AS low_key FROM h")
def guid_forms(spark, sf):
    """A guid as bytes, in its dashed form, whether it is the zero guid, and its lower half as a key."""
    raw = F.unhex(F.lpad(F.hex(F.col("p_partkey") * 7919), 32, "0"))
    g = table(spark, sf, "part").select("p_partkey", raw.alias("raw")).withColumn("hex", F.hex("raw"))
    dashed = F.concat_ws("-", *(F.substring("hex", k, 8) for k in (1, 9, 17, 25)))
    return g.select("p_partkey", dashed.alias("dashed"), ((F.col("hex") == F.repeat(F.lit("0"), F.lit(32))) | (F.col("p_partkey") % 50 == 0)).alias("zero"), F.hex(F.substring("raw", 9, 8)).alias("low_key"))


@query("WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 2 = 0 THEN concat_ws('.', 10 + user_id % 90, event_id % 256, (event_id // 256) % 256, user_id % 256) ELSE '2001:db8:0:0:0:0:' || lower(to_hex(user_id % 65536)) || ':' || lower(to_hex(event_id % 65536)) END AS address FROM events) SELECT address, count(*) AS hits, count(DISTINCT user_id) AS users FROM a GROUP BY address")
def addresses(spark, sf):
    """Stored addresses (4 or 16 bytes) as text, with their hits: dotted numbers, or eight groups without leading zeros."""
    e = table(spark, sf, "events").select("event_id", "user_id")
    v4 = F.concat(*(F.lpad(F.hex(x.cast("long")), 2, "0") for x in (10 + F.col("user_id") % 90, F.col("event_id") % 256, F.floor(F.col("event_id") / 256) % 256, F.col("user_id") % 256)))
    v6 = F.concat(F.lit("20010db8" + "0000" * 4), F.lpad(F.hex(F.col("user_id") % 65536), 4, "0"), F.lpad(F.hex(F.col("event_id") % 65536), 4, "0"))
    stored = e.select("user_id", F.unhex(F.when(F.col("event_id") % 2 == 0, v4).otherwise(v6)).alias("ip")).withColumn("h", F.lower(F.hex("ip")))
    dotted = F.concat_ws(".", *(F.conv(F.substring("h", k, 2), 16, 10) for k in (1, 3, 5, 7)))
    groups = F.concat_ws(":", *(F.regexp_replace(F.substring("h", k, 4), "^0{1,3}", "") for k in range(1, 33, 4)))
    return stored.select("user_id", F.when(F.length("ip") == 4, dotted).otherwise(groups).alias("address")).groupBy("address").agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"))


@query("SELECT event_id, concat_ws(' ', event_type, json_extract_string(props, '$.k')) AS search_text FROM events WHERE contains(concat_ws(' ', event_type, json_extract_string(props, '$.k')), '42')")
def leaf_value_search(spark, sf):
    """Stored rows whose values (not the names of their fields) hold a text."""
    values = F.map_values(F.from_json("props", "map<string,string>"))
    e = table(spark, sf, "events").select("event_id", F.concat_ws(" ", "event_type", values).alias("search_text"))
    return e.where(F.col("search_text").contains("42"))


@query("WITH s AS (SELECT s_suppkey - 1 AS raw_index, s_name AS label FROM supplier) SELECT l_orderkey, l_linenumber, l_suppkey % 120 AS raw_index, label, label IS NULL AS unknown FROM lineitem LEFT JOIN s ON raw_index = l_suppkey % 120")
def script_labels(spark, sf):
    """Labels of script objects by raw index; an index behind the table has none."""
    s = table(spark, sf, "supplier").select((F.col("s_suppkey") - 1).alias("raw_index"), F.col("s_name").alias("label"))
    i = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 120).alias("raw_index"))
    return i.join(s, "raw_index", "left").select("l_orderkey", "l_linenumber", "raw_index", "label", F.col("label").isNull().alias("unknown"))


_RENAMED = "renamed AS (SELECT p_partkey AS file_id, lower(trim(p_name)) AS old_key, lower(trim(p_name)) || '_' || p_brand AS new_name FROM part WHERE p_size > 45)"


@query(f"WITH {_RENAMED}, hit AS (SELECT DISTINCT l_orderkey AS file_id FROM lineitem JOIN part ON l_partkey = p_partkey WHERE lower(trim(p_name)) IN (SELECT old_key FROM renamed)) SELECT 'renamed' AS change, file_id, lower(new_name) AS key FROM renamed UNION ALL SELECT 'refers', file_id, NULL FROM hit")
def identity_rebuild(spark, sf):
    """A rename: the files with their new keys, and the files whose imports name an old key and must be resolved anew."""
    part = table(spark, sf, "part")
    renamed = part.where("p_size > 45").select(F.col("p_partkey").alias("file_id"), name_key(F.col("p_name")).alias("old_key"), F.concat(name_key(F.col("p_name")), F.lit("_"), "p_brand").alias("new_name"))
    imports = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file_id"), "l_partkey").join(part.select("p_partkey", name_key(F.col("p_name")).alias("old_key")), F.col("l_partkey") == F.col("p_partkey"))
    refers = imports.join(renamed.select("old_key").distinct(), "old_key", "left_semi").select("file_id").distinct()
    return renamed.select(F.lit("renamed").alias("change"), "file_id", fname_key(F.col("new_name")).alias("key")).unionByName(refers.select(F.lit("refers").alias("change"), "file_id", F.lit(None).cast("string").alias("key")))


@query("""WITH j AS (SELECT conv_id, turn, (conv_id * 31 + turn * 17) % 5 = 0 AS failed FROM conversations)
SELECT conv_id, turn, failed AS own, coalesce(bool_or(failed) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING), false) AS repaired FROM j""")
def ancestor_repair(spark, sf):
    """Outcomes of jobs repaired from below: a job whose descendant failed has failed. Chains are a tree's paths, so what lies
    below a job is a window over its own chain."""
    j = table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("conv_id") * 31 + F.col("turn") * 17) % 5 == 0).alias("own"))
    return j.withColumn("repaired", F.bool_or("own").over(W.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(W.unboundedPreceding, 0)))


_G = "g AS (SELECT doc_id, source AS game, upper(md5(lower(trim(text)))) AS guid, length(text) AS size, lang FROM documents WHERE length(trim(coalesce(text, ''))) > 0)"


@query(f"WITH {_G}, k AS (SELECT game, guid, arg_min(doc_id, (CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 1 END, doc_id)) AS keeper, count(*) AS peers FROM g GROUP BY ALL HAVING count(*) > 1) SELECT doc_id, keeper, peers, doc_id <> keeper AS retired, CASE WHEN doc_id <> keeper THEN keeper END AS points_to FROM g JOIN k USING (game, guid)")
def duplicate_retirement(spark, sf):
    """Files of one game with one guid: which stays (an indexed one, then the lowest), and where the others' locations and
    aliases point from then on."""
    d = table(spark, sf, "documents").where(F.length(F.trim(F.coalesce("text", F.lit("")))) > 0)
    g = d.select("doc_id", F.col("source").alias("game"), F.upper(F.md5(F.lower(F.trim("text")).cast("binary"))).alias("guid"))
    k = g.groupBy("game", "guid").agg(F.min_by("doc_id", F.struct(F.when(F.col("doc_id") % 4 == 0, 0).otherwise(1), "doc_id")).alias("keeper"), F.count("*").alias("peers")).where("peers > 1")
    retired = F.col("doc_id") != F.col("keeper")
    return g.join(k, ["game", "guid"]).select("doc_id", "keeper", "peers", retired.alias("retired"), F.when(retired, F.col("keeper")).alias("points_to"))


_Q = "q AS (SELECT doc_id, md5(coalesce(text, '')) AS md5, length(coalesce(text, '')) AS size, doc_id % 4 = 0 AS indexed, TIMESTAMP '2024-01-01' - to_days((doc_id * 37 % 500)::INT) AS uploaded_at, doc_id % 3 AS queue FROM documents)"


@query(f"WITH {_Q}, r AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY md5, size) AS copies FROM q WINDOW w AS (PARTITION BY md5, size ORDER BY indexed DESC, uploaded_at, queue, doc_id)) SELECT doc_id, place = 1 AS keeper, copies, CASE WHEN place = 1 THEN size * (copies - 1) ELSE 0 END AS reclaimable FROM r WHERE copies > 1")
def ranked_keepers(spark, sf):
    """The copy that stays in a group of equal bytes: indexed, then oldest, then of the lowest queue. The best of a group is
    found by a minimum that is combined before it moves, so a group with a third of all files is no task of its own."""
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    rank = F.struct((F.col("doc_id") % 4 != 0).alias("i"), (-(F.col("doc_id") * 37 % 500)).alias("t"), (F.col("doc_id") % 3).alias("q"), "doc_id")
    k = d.groupBy("md5", "size").agg(F.min(rank).alias("best"), F.count("*").alias("copies")).where("copies > 1")
    keeper = F.col("doc_id") == F.col("best.doc_id")
    return d.join(k, ["md5", "size"]).select("doc_id", keeper.alias("keeper"), "copies", F.when(keeper, F.col("size") * (F.col("copies") - 1)).otherwise(0).alias("reclaimable"))


@query("WITH f AS (SELECT p_partkey, p_brand || '/sub/' || p_name || '.' || p_partkey || '.UMX' AS file FROM part) SELECT p_partkey, lower(trim(regexp_replace(file, '\\.[^.]*$', ''))) AS stem, lower(replace(p_partkey || '..Root. Inner .' || file, ' ', '')) AS raw FROM f")
def file_stems(spark, sf):
    """Keys of file names without their last extension, and of dotted paths without blanks."""
    f = table(spark, sf, "part").select("p_partkey", F.concat("p_brand", F.lit("/sub/"), "p_name", F.lit("."), F.col("p_partkey").cast("string"), F.lit(".UMX")).alias("file"))
    return f.select("p_partkey", stem_key(F.col("file")).alias("stem"), F.lower(F.replace(F.concat(F.col("p_partkey").cast("string"), F.lit("..Root. Inner ."), "file"), F.lit(" "), F.lit(""))).alias("raw"))


@query("SELECT p_partkey, 'root.' || lower(trim(p_brand)) || '.' || lower(trim(p_type)) AS path FROM part")
def dotted_paths(spark, sf):
    """Path keys: empty parts go, parts are trimmed."""
    p = table(spark, sf, "part")
    return p.select("p_partkey", path_key(F.concat(F.lit(".Root.. "), "p_brand", F.lit(" ."), "p_type", F.lit("."))).alias("path"))


@query("WITH c AS (SELECT s_suppkey, lower(s_name) AS k1, 's' || s_suppkey AS k2 FROM supplier WHERE s_acctbal > 0) SELECT p_partkey FROM part WHERE 's' || p_size IN (SELECT k2 FROM c) OR 'supplier#' || lpad(p_partkey::VARCHAR, 9, '0') IN (SELECT k1 FROM c)")
def providers_by_either_form(spark, sf):
    """Requirements that some provider answers to in either form of its name."""
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.lower("s_name").alias("k1"), F.concat(F.lit("s"), "s_suppkey").alias("k2"))
    p = table(spark, sf, "part").select("p_partkey", F.concat(F.lit("supplier#"), F.lpad(F.col("p_partkey").cast("string"), 9, "0")).alias("a"), F.concat(F.lit("s"), "p_size").alias("b"))
    return either_key(p, s, [("a", "k1"), ("b", "k2")], "p_partkey").select("p_partkey")


#: Flags of names that a reader takes as they are, and the most letters of a name it uses. Fixed values.
USED_FLAG, LONGEST = 1, 63


@query("""WITH n AS (SELECT l_orderkey AS file_id, l_linenumber AS i, p_name AS name, (l_suppkey % 4)::INT AS flags FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT file_id, i, name, flags, CASE WHEN flags % 2 = 1 AND length(name) <= 63 THEN name ELSE last_value(CASE WHEN flags % 2 = 1 AND length(name) <= 63 THEN name END IGNORE NULLS) OVER (PARTITION BY file_id ORDER BY i, name, flags ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) END AS effective FROM n""")
def effective_names(spark, sf):
    """The name that an entry of a file's table stands for: its own where its flags and length allow it, else the last one
    before it that they do."""
    n = table(spark, sf, "lineitem").join(table(spark, sf, "part").select("p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    n = n.select(F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("i"), F.col("p_name").alias("name"), (F.col("l_suppkey") % 4).cast("int").alias("flags"))
    own = F.when((F.col("flags").bitwiseAND(USED_FLAG) != 0) & (F.length("name") <= LONGEST), F.col("name"))
    return n.withColumn("effective", F.last(own, ignorenulls=True).over(W.partitionBy("file_id").orderBy("i", "name", "flags").rowsBetween(W.unboundedPreceding, 0)))


_EXPORTS = "x AS (SELECT (p_partkey // 40)::BIGINT AS file_id, (p_partkey % 40 + 1)::INT AS i, p_name AS name, CASE WHEN p_size % 5 = 0 THEN 0 WHEN p_size % 2 = 0 THEN (p_size % 40 + 1)::INT ELSE -(p_size % 7 + 1)::INT END AS class_index FROM part)"


@query(f"WITH {_EXPORTS}, m AS (SELECT s_suppkey::INT AS i, s_name AS name FROM supplier) SELECT x.file_id, x.i, x.name, CASE WHEN x.class_index = 0 THEN 'Class' WHEN x.class_index > 0 THEN c.name ELSE m.name END AS class_name, CASE WHEN x.class_index = 0 THEN 'Core' WHEN x.class_index > 0 THEN 'file ' || x.file_id ELSE 'import' END AS class_package FROM x LEFT JOIN x c ON x.class_index > 0 AND c.file_id = x.file_id AND c.i = x.class_index LEFT JOIN m ON x.class_index < 0 AND m.i = -x.class_index")
def export_classes(spark, sf):
    """The class of each export: none names a class itself, a positive index another export of the file, a negative one an
    import."""
    p = table(spark, sf, "part")
    index = F.when(F.col("p_size") % 5 == 0, 0).when(F.col("p_size") % 2 == 0, F.col("p_size") % 40 + 1).otherwise(-(F.col("p_size") % 7 + 1)).cast("int")
    x = p.select(F.floor(F.col("p_partkey") / 40).alias("file_id"), (F.col("p_partkey") % 40 + 1).cast("int").alias("i"), F.col("p_name").alias("name"), index.alias("class_index"))
    own = x.select("file_id", F.col("i").alias("class_index"), F.col("name").alias("own_class"))
    imports = table(spark, sf, "supplier").select((-F.col("s_suppkey")).cast("int").alias("class_index"), F.col("s_name").alias("imported"))
    j = x.join(own, ["file_id", "class_index"], "left").join(imports, "class_index", "left")
    c = F.col("class_index")
    return j.select("file_id", "i", "name", F.when(c == 0, "Class").when(c > 0, F.col("own_class")).otherwise(F.col("imported")).alias("class_name"), F.when(c == 0, "Core").when(c > 0, F.concat(F.lit("file "), F.col("file_id").cast("string"))).otherwise("import").alias("class_package"))


@query(f"""WITH {EDGES_SQL}, {FILES_SQL}, c AS (SELECT game_id, file_id, count(DISTINCT package) AS required, count(DISTINCT CASE WHEN outcome = 0 THEN package END) AS lacking FROM edges JOIN files USING (file_id) GROUP BY ALL)
SELECT game_id, count(*) AS consumers, CAST(count(*) FILTER (WHERE lacking = 0) AS BIGINT) AS complete, CAST(count(*) FILTER (WHERE lacking = required) AS BIGINT) AS empty, CAST(sum(lacking) AS BIGINT) AS lacking FROM c GROUP BY game_id""")
def consumer_completeness(spark, sf):
    """How many consumers of a game have all, or none, of the packages that they require."""
    packages = owned_edges(spark, sf).groupBy("game_id", "file_id", "package").agg(F.bool_or(F.col("outcome") == 0).alias("missing"))
    named = F.col("package").isNotNull()
    c = packages.groupBy("game_id", "file_id").agg(n_if(named).alias("required"), n_if(named & F.col("missing")).alias("lacking"))
    return c.groupBy("game_id").agg(F.count("*").alias("consumers"), n_if(F.col("lacking") == 0).alias("complete"), n_if(F.col("lacking") == F.col("required")).alias("empty"), F.sum("lacking").alias("lacking"))
