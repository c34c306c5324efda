"""Core search in stages, filters of file lists, sorts and pages, and lists of jobs, files and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import name_key
from ..operators.paging import beyond, order, page
from ..operators.rollup import n_if
from ..registry import query
from ..tables import FILES_SQL, files, table

#: Catalogue files as a search sees them: a package name, a file name, a stored name, an alias for one in three.
_FILES = """pf AS (SELECT p_partkey AS file_id, p_size % 7 AS game_id, lower(trim(p_name)) AS package, lower(p_name || '-' || p_partkey || CASE WHEN p_size % 2 = 0 THEN '.umx' ELSE '.utx' END) AS file_name,
  lower(p_brand || '/' || p_partkey) AS stored, CASE WHEN p_partkey % 3 = 0 THEN lower(p_type) END AS alias, CASE WHEN p_size % 2 = 0 THEN 'umx' ELSE 'utx' END AS extension, p_size AS size, md5(p_name) AS md5, sha1(p_name) AS sha1, p_retailprice AS price FROM part)"""
_FIELDS = ("package", "file_name", "stored", "alias")


def catalogue_files(spark, sf):
    p = table(spark, sf, "part")
    ext = F.when(F.col("p_size") % 2 == 0, "umx").otherwise("utx")
    raw = F.col("p_name").cast("binary")
    return p.select(F.col("p_partkey").alias("file_id"), (F.col("p_size") % 7).alias("game_id"), name_key(F.col("p_name")).alias("package"), F.lower(F.concat("p_name", F.lit("-"), "p_partkey", F.lit("."), ext)).alias("file_name"),
                    F.lower(F.concat("p_brand", F.lit("/"), "p_partkey")).alias("stored"), F.when(F.col("p_partkey") % 3 == 0, F.lower("p_type")).alias("alias"), ext.alias("extension"), F.col("p_size").alias("size"), F.md5(raw).alias("md5"), F.sha1(raw).alias("sha1"), F.col("p_retailprice").alias("price"))


def core_search(rows, text: str, limit: int, extensions: tuple[str, ...] = ()):
    """file_id, game_id, package, file_name, stage, fields of the best ``limit`` files for a text.

    An identity (md5 or sha1 in hex) is stage 1 and ends the search where it hits. Else prefix stages of package, file,
    stored name and alias (2 to 5) come before the same as contains stages (6 to 9). One scan finds all of a file's
    stages; a file counts in the first, its fields are those of all. The first files by stage are taken and shown by game,
    package, file name and identifier."""
    text = text.lower().strip()
    rows = rows.where(F.col("extension").isin(*extensions)) if extensions else rows
    stages = [(1, "identity", (F.col("md5") == text) | (F.col("sha1") == text))]
    stages += [(2 + i, f, F.col(f).startswith(text)) for i, f in enumerate(_FIELDS)] + [(6 + i, f, F.col(f).contains(text)) for i, f in enumerate(_FIELDS)]
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(s).alias("stage"), F.lit(f).alias("field"))) for s, f, c in stages)))
    found = rows.select("file_id", "game_id", "package", "file_name", hits.alias("hits")).where(F.size("hits") > 0)
    found = found.select("file_id", "game_id", "package", "file_name", F.get("hits", F.lit(0))["stage"].alias("stage"), F.array_join(F.array_distinct(F.transform("hits", lambda h: h["field"])), ",").alias("fields"))
    if len(text) in (32, 40) and not found.where("stage = 1").isEmpty():
        found = found.where("stage = 1")
    return found.orderBy("stage", "file_id").limit(limit).orderBy("game_id", "package", "file_name", "file_id")


def _core_sql(text: str, limit: int, where: str = "true") -> str:
    cases = [(1, "identity", f"md5 = '{text}' OR sha1 = '{text}'")] + [(2 + i, f, f"starts_with({f}, '{text}')") for i, f in enumerate(_FIELDS)] + [(6 + i, f, f"contains({f}, '{text}')") for i, f in enumerate(_FIELDS)]
    stage = " ".join(f"WHEN {c} THEN {s}" for s, _, c in cases)
    firsts = ", ".join(f"CASE WHEN {c} THEN '{f}' END" for s, f, c in cases if s < 6)
    later = ", ".join(f"CASE WHEN {c} AND NOT ({d}) THEN '{f}' END" for (s, f, c), d in zip([x for x in cases if x[0] >= 6], [x[2] for x in cases if 2 <= x[0] < 6], strict=True))
    return f"hit AS (SELECT file_id, game_id, package, file_name, CASE {stage} END AS stage, concat_ws(',', {firsts}, {later}) AS fields FROM pf WHERE {where}), core AS (SELECT * FROM hit WHERE stage IS NOT NULL AND (stage = 1 OR NOT EXISTS (SELECT 1 FROM hit WHERE stage = 1)) ORDER BY stage, file_id LIMIT {limit})"


@query(f"WITH {_FILES}, {_core_sql('an', 200)} SELECT * FROM core")
def search_core_files(spark, sf):
    return core_search(catalogue_files(spark, sf), "an", 200)


@query(f"WITH {_FILES}, {_core_sql('brand#2', 300, chr(101) + 'xtension IN (' + chr(39) + 'umx' + chr(39) + ')')} SELECT * FROM core")
def search_core_scoped(spark, sf):
    return core_search(catalogue_files(spark, sf), "Brand#2", 300, ("umx",))


@query(f"""WITH {_FILES}, {_core_sql('st', 150)}, meta AS (SELECT p_partkey AS file_id FROM part WHERE contains(lower(p_type), 'st') AND p_size > 25)
SELECT coalesce(c.file_id, m.file_id) AS file_id, CASE WHEN c.file_id IS NULL THEN 10 ELSE stage END AS stage, concat_ws(',', nullif(fields, ''), CASE WHEN m.file_id IS NOT NULL THEN 'metadata' END) AS fields FROM core c FULL JOIN meta m ON c.file_id = m.file_id""")
def search_broad(spark, sf):
    """Core hits first, files whose metadata match behind them; a file in both has the fields of both."""
    core = core_search(catalogue_files(spark, sf), "st", 150).select("file_id", "stage", "fields")
    meta = table(spark, sf, "part").where(F.lower("p_type").contains("st") & (F.col("p_size") > 25)).select(F.col("p_partkey").alias("file_id"), F.lit("metadata").alias("m"))
    return core.join(meta, "file_id", "full").select("file_id", F.coalesce("stage", F.lit(10)).alias("stage"), F.concat_ws(",", "fields", "m").alias("fields"))


@query(f"WITH {_FILES} SELECT file_id, extension FROM pf WHERE (extension = 'umx' AND file_id NOT IN (SELECT p_partkey FROM part WHERE p_retailprice < 950)) OR (extension = 'utx' AND file_id IN (SELECT p_partkey FROM part WHERE p_retailprice > 1900))")
def mixed_format_files(spark, sf):
    """Files of one format without its exceptions, and of the other its exceptions alone."""
    rows, part = catalogue_files(spark, sf).select("file_id", "extension", "price"), table(spark, sf, "part")
    out, into = part.where("p_retailprice < 950").select(F.col("p_partkey").alias("file_id")), part.where("p_retailprice > 1900").select(F.col("p_partkey").alias("file_id"))
    return rows.where("extension = 'umx'").join(out, "file_id", "left_anti").unionByName(rows.where("extension = 'utx'").join(into, "file_id", "left_semi")).select("file_id", "extension")


_INVALID = "bad AS (SELECT DISTINCT size, upper(md5) AS md5, sha1 FROM pf WHERE price > 1900)"


@query(f"WITH {_FILES}, {_INVALID} SELECT file_id FROM pf WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.size = pf.size AND lower(b.md5) = lower(pf.md5) AND lower(b.sha1) = lower(pf.sha1))")
def without_invalid_bytes(spark, sf):
    """Files but those whose bytes (size, md5, sha1, whatever the case of the hex digits) are known to be bad."""
    rows = catalogue_files(spark, sf)
    bad = rows.where("price > 1900").select("size", F.lower(F.upper("md5")).alias("md5"), F.lower("sha1").alias("sha1")).distinct()
    return rows.withColumn("md5", F.lower("md5")).withColumn("sha1", F.lower("sha1")).join(bad, ["size", "md5", "sha1"], "left_anti").select("file_id")


#: Which engines' files a game of an engine takes; hints treat the three legacy engines as one. Fixed values.
TAKES = {1: (1,), 2: (1, 2), 3: (3,), 4: (4,), 5: (4, 5)}
_TAKES = "takes(engine, source) AS (VALUES (1, 1), (2, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 5))"
_GAMES = "games AS (SELECT n_nationkey AS game_id, n_nationkey % 5 + 1 AS engine, CASE WHEN n_nationkey % 2 = 0 THEN 'umx' ELSE 'utx' END AS allowed FROM nation)"


@query(f"""WITH {_FILES}, {_GAMES}, {_TAKES}, f AS (SELECT file_id, extension, size % 5 + 1 AS engine FROM pf)
SELECT file_id, game_id, g.engine, f.engine AS file_engine, EXISTS (SELECT 1 FROM takes t WHERE t.engine = g.engine AND t.source = f.engine) AS compatible FROM f JOIN games g ON g.allowed = f.extension AND (g.engine = f.engine OR EXISTS (SELECT 1 FROM takes t WHERE t.engine = g.engine AND t.source = f.engine) OR (g.engine <= 3 AND f.engine <= 3))""")
def profile_admission(spark, sf):
    """Games that may take a file: its extension allowed and its engine equal, compatible, or a legacy one beside another.

    The allowed pairs of engines are a small table; files meet games by extension and engine, not all with all."""
    pairs = [(e, s, s in TAKES[e]) for e in TAKES for s in TAKES if s == e or s in TAKES[e] or (e <= 3 and s <= 3)]
    takes = spark.createDataFrame(pairs, "engine long, file_engine int, compatible boolean")
    games = table(spark, sf, "nation").select(F.col("n_nationkey").alias("game_id"), (F.col("n_nationkey") % 5 + 1).cast("long").alias("engine"), F.when(F.col("n_nationkey") % 2 == 0, "umx").otherwise("utx").alias("extension"))
    f = catalogue_files(spark, sf).select("file_id", "extension", (F.col("size") % 5 + 1).alias("file_engine"))
    return f.join(games.join(takes, "engine"), ["extension", "file_engine"]).select("file_id", "game_id", F.col("engine").cast("int").alias("engine"), "file_engine", "compatible")


@query("WITH s AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM documents WHERE contains(lower(concat_ws(' ', lang, source, coalesce(text, ''))), 'licensed')) SELECT doc_id, (SELECT count(*) FROM s) AS total FROM s ORDER BY doc_id LIMIT 25")
def section_search(spark, sf):
    """A page of the rows that hold a text in any visible field, with the exact number of all of them."""
    hits = table(spark, sf, "documents").where(F.lower(F.concat_ws(" ", "lang", "source", F.coalesce("text", F.lit("")))).contains("licensed")).select("doc_id")
    return hits.orderBy("doc_id").limit(25).withColumn("total", hits.agg(F.count("*")).scalar())


#: The eight sorts of the file list: columns and directions, made total by names and the identifier.
SORTS = {
    "package": [("package", True)], "package_down": [("package", False)], "size": [("size", True)], "size_down": [("size", False)],
    "price": [("price", True)], "price_down": [("price", False)], "extension": [("extension", True)], "game": [("game_id", True)],
}
_TIES = [("package", True), ("file_name", True), ("file_id", True)]


def sort_of(name: str):
    own = SORTS[name]
    return own + [t for t in _TIES if t[0] != own[0][0]]


def _order_sql(sort) -> str:
    return ", ".join(f"{c} {'ASC NULLS FIRST' if up else 'DESC NULLS LAST'}" for c, up in sort)


_ALL_SORTS = " UNION ALL ".join(f"SELECT * FROM (SELECT '{name}' AS sort, file_id, row_number() OVER (ORDER BY {_order_sql(sort_of(name))}) AS place FROM pf ORDER BY place LIMIT 40)" for name in SORTS)


@query(f"WITH {_FILES} {_ALL_SORTS}")
def file_list_sorts(spark, sf):
    """The first page by each of the eight sorts."""
    rows = catalogue_files(spark, sf)
    one = lambda name: page(rows, sort_of(name), 40, None, "first").withColumn("place", F.row_number().over(W.orderBy(*order(sort_of(name))))).select(F.lit(name).alias("sort"), "file_id", "place")  # noqa: E731  # forty rows
    return reduce(lambda a, b: a.unionByName(b), map(one, SORTS))


_SIZE_NAME = "(size < 30 OR (size = 30 AND (package > 'm' OR (package = 'm' AND file_id > 0))))"


@query(f"WITH {_FILES} SELECT file_id, size, package FROM pf WHERE {_SIZE_NAME} ORDER BY size DESC, package, file_id LIMIT 60")
def file_list_after(spark, sf):
    rows, sort = catalogue_files(spark, sf).select("file_id", "size", "package"), [("size", False), ("package", True), ("file_id", True)]
    return rows.where(beyond(sort, [30, "m", 0])).orderBy(*order(sort)).limit(60)


@query(f"WITH {_FILES}, t AS (SELECT count(*) AS total FROM pf WHERE extension = 'umx') SELECT file_id, (SELECT total FROM t) AS total FROM (SELECT file_id FROM pf WHERE extension = 'umx' ORDER BY file_id DESC LIMIT (SELECT CASE WHEN total % 45 = 0 THEN least(45, total) ELSE total % 45 END FROM t))")
def last_offset_page(spark, sf):
    """The last page of a list in pages of 45: as many rows as the total leaves over."""
    from ..operators.paging import last_size

    rows = catalogue_files(spark, sf).where("extension = 'umx'").select("file_id")
    total = rows.count()
    return rows.orderBy(F.col("file_id").desc()).limit(last_size(total, 45)).withColumn("total", F.lit(total))


@query(f"WITH {_FILES} SELECT file_id, package = 'brand' OR starts_with(package, 'a') AS exact, row_number() OVER (PARTITION BY game_id ORDER BY (package = 'brand' OR starts_with(package, 'a')) DESC, price DESC, file_id) AS place FROM pf")
def exact_first(spark, sf):
    """Rows of a game that fit exactly before the others: a boolean in the order."""
    exact = (F.col("package") == "brand") | F.col("package").startswith("a")
    rows = catalogue_files(spark, sf).withColumn("exact", exact)
    return rows.select("file_id", "exact", F.row_number().over(W.partitionBy("game_id").orderBy(F.col("exact").desc(), F.col("price").desc(), "file_id")).alias("place"))


_U = "u AS (SELECT o_orderkey AS file_id, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'retry' END AS queue, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 5 + 1 END AS engine, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey % 3 END AS version, o_totalprice AS size FROM orders)"


def unverified(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("file_id"), F.when(F.col("o_orderstatus") == "O", "new").otherwise("retry").alias("queue"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_custkey") % 5 + 1).alias("engine"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_custkey") % 3).alias("version"), F.col("o_totalprice").alias("size"))


@query(f"WITH {_U} SELECT file_id, queue, engine, version FROM u WHERE queue = 'new' AND engine IS NOT DISTINCT FROM NULL AND version IS NOT DISTINCT FROM 2")
def unverified_filter(spark, sf):
    """Filters in which no value is a value: engine unknown, version 2."""
    return unverified(spark, sf).where((F.col("queue") == "new") & F.col("engine").eqNullSafe(F.lit(None)) & F.col("version").eqNullSafe(F.lit(2))).select("file_id", "queue", "engine", "version")


@query(f"WITH {_U} SELECT engine, version, count(*) AS files FROM u GROUP BY ALL")
def version_histogram(spark, sf):
    return unverified(spark, sf).groupBy("engine", "version").agg(F.count("*").alias("files"))


@query(f"WITH {_U}, s AS (SELECT count(*) AS n, max(file_id) AS top FROM u WHERE queue = 'retry' AND engine = 4) SELECT file_id, floor((row_number() OVER (ORDER BY file_id) - 1) / 250)::BIGINT AS chunk FROM u WHERE queue = 'retry' AND engine = 4 AND file_id <= (SELECT top FROM s) AND file_id > 1000 ORDER BY file_id LIMIT 1000")
def bulk_selection(spark, sf):
    """A selection frozen by its largest identifier, then taken in order, four chunks of 250 behind a cursor."""
    rows = unverified(spark, sf).where("queue = 'retry' AND engine = 4").select("file_id")
    frozen = rows.where(F.col("file_id") <= rows.agg(F.max("file_id")).scalar())
    part = page(frozen, [("file_id", True)], 1000, [1000], "next")
    return part.withColumn("chunk", F.floor((F.row_number().over(W.orderBy("file_id")) - 1) / 250))  # a thousand rows


@query(f"WITH {FILES_SQL} SELECT game_id, status, count(*) AS n, max(uploaded_at) AS latest, arg_max(file_id, (uploaded_at, file_id)) AS latest_file FROM files GROUP BY ALL")
def dashboard_drilldown(spark, sf):
    return files(spark, sf).groupBy("game_id", "status").agg(F.count("*").alias("n"), F.max("uploaded_at").alias("latest"), F.max_by("file_id", F.struct("uploaded_at", "file_id")).alias("latest_file"))


@query("SELECT event_id, event_type, user_id, ts FROM events WHERE event_type = 'error' AND user_id BETWEEN 10 AND 90 AND (ts < TIMESTAMP '2024-01-20' OR (ts = TIMESTAMP '2024-01-20' AND event_id < 0)) ORDER BY ts DESC, event_id DESC LIMIT 100")
def job_browser_page(spark, sf):
    """A page of jobs of a kind behind a cursor, newest first; the filters and the cursor reach the scan."""
    import datetime

    e = table(spark, sf, "events").where((F.col("event_type") == "error") & F.col("user_id").between(10, 90)).select("event_id", "event_type", "user_id", "ts")
    return page(e, [("ts", False), ("event_id", False)], 100, [datetime.datetime(2024, 1, 20), 0], "next")


@query("WITH l AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 11 = 0 THEN '' WHEN o_custkey % 13 = 0 THEN NULL ELSE n_name END AS country, o_totalprice AS bytes, o_orderdate AS ts FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) SELECT id, country, bytes, ts, (SELECT count(*) FROM l) AS total FROM l ORDER BY (country IS NULL OR country = ''), country, ts DESC, id LIMIT 300")
def download_log(spark, sf):
    """A page of the log by country, blanks last, with the number of all entries."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    country = F.when(F.col("o_custkey") % 11 == 0, "").when(F.col("o_custkey") % 13 != 0, F.col("n_name"))
    rows = o.select(F.col("o_orderkey").alias("id"), country.alias("country"), F.col("o_totalprice").alias("bytes"), F.col("o_orderdate").alias("ts"))
    blank = F.col("country").isNull() | (F.col("country") == "")
    return rows.orderBy(blank, F.col("country").asc_nulls_last(), F.col("ts").desc(), "id").limit(300).withColumn("total", table(spark, sf, "orders").agg(F.count("*")).scalar())


_COUNTS = {"files": "SELECT count(*) FROM orders", "verified": "SELECT count(*) FROM orders WHERE o_orderstatus = 'F'", "edges": "SELECT count(*) FROM lineitem", "missing": "SELECT count(*) FROM lineitem WHERE l_returnflag = 'N' AND l_linestatus = 'F'", "packages": "SELECT count(DISTINCT p_brand) FROM part", "pages": "SELECT count(*) FROM pages", "unverified": "SELECT count(*) FROM orders WHERE o_orderstatus <> 'F'", "errors": "SELECT count(*) FROM events WHERE event_type = 'error'"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS name, ({v}) AS n" for k, v in _COUNTS.items()))
def exact_counts(spark, sf):
    """The counts that pages show, each exact over its whole table."""
    t = lambda name: table(spark, sf, name)
    o, line = t("orders").agg(F.count("*").alias("files"), n_if(F.col("o_orderstatus") == "F").alias("verified"), n_if(F.col("o_orderstatus") != "F").alias("unverified")), t("lineitem").agg(F.count("*").alias("edges"), n_if((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")).alias("missing"))
    out = [o, line, t("part").agg(F.countDistinct("p_brand").alias("packages")), t("pages").agg(F.count("*").alias("pages")), t("events").agg(n_if(F.col("event_type") == "error").alias("errors"))]
    return reduce(lambda a, b: a.unionByName(b), (x.unpivot([], x.columns, "name", "n") for x in out))


@query("WITH c AS (SELECT event_type, user_id % 3 AS audience, count(*) AS samples FROM events GROUP BY ALL) SELECT sha256('{\"audience\":\"' || audience || '\",\"event_type\":\"' || event_type || '\"}') AS context_hash, samples FROM c")
def count_contexts(spark, sf):
    """Contexts of counts by the hash of their canonical form: JSON with sorted keys and text values."""
    c = table(spark, sf, "events").groupBy("event_type", (F.col("user_id") % 3).alias("audience")).agg(F.count("*").alias("samples"))
    canonical = F.to_json(F.struct(F.col("audience").cast("string").alias("audience"), F.col("event_type").alias("event_type")))
    return c.select(F.sha2(canonical.cast("binary"), 256).alias("context_hash"), "samples")
