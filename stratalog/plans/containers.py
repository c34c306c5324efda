"""Containers of engine 5 and exchange files, over samples generated from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.rollup import n_if
from ..registry import query
from ..session import scratch_folder
from ..sources import containers
from ..tables import table


def tocs(spark, sf):
    """A table of contents for each forty parts: a chunk and a block a part; one in eleven has another tag, one in thirteen
    is cut short."""
    p = table(spark, sf, "part").select(F.floor(F.col("p_partkey") / 40).alias("id"), "p_partkey", "p_size")
    chunk = F.struct("p_partkey", F.col("p_partkey").alias("package_id"), (F.col("p_size") % 3).alias("index"), (F.col("p_size") % 6 + 1).alias("type"), (F.col("p_partkey") * 4096).alias("offset"), (F.col("p_size") * 100).alias("length"))
    block = F.struct("p_partkey", (F.col("p_partkey") * 2048).alias("offset"), F.col("p_size").alias("packed"), (F.col("p_size") * 2).alias("size"), (F.col("p_size") % 2).alias("method"))
    g = p.groupBy("id").agg(F.array_sort(F.collect_list(chunk)).alias("chunks"), F.array_sort(F.collect_list(block)).alias("blocks"))  # forty parts
    made = g.select("id", containers.write_toc(F.col("chunks"), F.col("blocks"), F.col("id") % 7 + 2, F.col("id") + 1000).alias("b"))
    data = F.when(F.col("id") % 13 == 12, F.substr("b", F.lit(1), F.lit(90))).when(F.col("id") % 11 == 10, F.concat(F.lit(b"?"), F.substr("b", F.lit(2), F.length("b")))).otherwise(F.col("b"))
    return containers.toc_header(made.select("id", data.alias("content")))


_P = "p AS (SELECT CAST(floor(p_partkey / 40) AS BIGINT) AS id, p_partkey, p_size, row_number() OVER (PARTITION BY floor(p_partkey / 40) ORDER BY p_partkey) - 1 AS i FROM part), good AS (SELECT * FROM p WHERE id % 13 <> 12 AND id % 11 <> 10)"


@query(f"WITH {_P} SELECT id, CASE WHEN id % 13 = 12 THEN 'truncated' WHEN id % 11 = 10 THEN 'bad_tag' ELSE 'ok' END AS status, CASE WHEN id % 13 <> 12 AND id % 11 <> 10 THEN id % 7 + 2 END AS version, CASE WHEN id % 13 <> 12 AND id % 11 <> 10 THEN count(*) END AS entries, CASE WHEN id % 13 <> 12 AND id % 11 <> 10 THEN upper(lpad(to_hex(id + 1000), 16, '0')) END AS container_id FROM p GROUP BY id")
def container_headers(spark, sf):
    return tocs(spark, sf).select("id", "status", "version", "entries", "container_id")


@query(f"WITH {_P} SELECT id, i, upper(lpad(to_hex(p_partkey), 16, '0')) AS package_id, (p_size % 3)::BIGINT AS chunk_index, (p_size % 6 + 1)::BIGINT AS chunk_type, p_partkey * 4096 AS \"offset\", (p_size * 100)::BIGINT AS length FROM good")
def container_chunks(spark, sf):
    return containers.toc_chunks(tocs(spark, sf), "id")


@query(f"WITH {_P} SELECT id, i, p_partkey * 2048 AS \"offset\", p_size::BIGINT AS packed, (p_size * 2)::BIGINT AS size, CASE WHEN p_size % 2 = 0 THEN 'None' ELSE 'Zlib' END AS method FROM good")
def container_blocks(spark, sf):
    return containers.toc_blocks(tocs(spark, sf), "id")


@query(f"WITH {_P} SELECT (p_size % 6 + 1)::BIGINT AS chunk_type, count(*) AS chunks, sum(p_size * 100)::BIGINT AS bytes, count(DISTINCT p_partkey) AS packages FROM good GROUP BY 1")
def container_chunk_types(spark, sf):
    c = containers.toc_chunks(tocs(spark, sf), "id")
    return c.groupBy("chunk_type").agg(F.count("*").alias("chunks"), F.sum("length").alias("bytes"), F.countDistinct("package_id").alias("packages"))


#: Assets as a registry holds them: an object, its tags, and what it depends on, hard or soft.
_ASSETS = "a AS (SELECT event_id AS id, '/Game/' || event_type || '/' || user_id || '.' || event_id AS object_path, event_type AS class, json_extract_string(props, '$.k') AS k FROM events)"


def assets(spark, sf):
    e = table(spark, sf, "events")
    tags = F.from_json("props", "map<string,string>")
    soft = F.struct(F.concat(F.lit("/Game/shared/"), (F.col("user_id") % 7).cast("string")).alias("path"), F.lit("soft").alias("kind"))
    hard = F.struct(F.concat(F.lit("/Script/"), "event_type").alias("path"), F.lit("hard").alias("kind"))
    path = F.concat(F.lit("/Game/"), "event_type", F.lit("/"), F.col("user_id").cast("string"), F.lit("."), F.col("event_id").cast("string"))
    return e.select(F.col("event_id").alias("id"), path.alias("object_path"), F.col("event_type").alias("class"), tags.alias("tags"), F.array(hard, soft).alias("needs"))


@query(f"WITH {_ASSETS} SELECT object_path, class, split_part(object_path, '.', 1) AS package FROM a")
def registry_assets(spark, sf):
    return assets(spark, sf).select("object_path", "class", F.split_part("object_path", F.lit("."), F.lit(1)).alias("package"))


@query(f"WITH {_ASSETS} SELECT object_path, 'k' AS tag, k AS value FROM a WHERE k IS NOT NULL")
def registry_tags(spark, sf):
    return assets(spark, sf).select("object_path", F.explode("tags").alias("tag", "value")).where("value IS NOT NULL")


@query("SELECT path, kind, count(*) AS assets FROM (SELECT '/Script/' || event_type AS path, 'hard' AS kind FROM events UNION ALL SELECT '/Game/shared/' || (user_id % 7), 'soft' FROM events) GROUP BY ALL")
def registry_dependencies(spark, sf):
    return assets(spark, sf).select(F.explode("needs").alias("n")).groupBy(F.col("n.path").alias("path"), F.col("n.kind").alias("kind")).agg(F.count("*").alias("assets"))


def _exchange(spark, df, form: str):
    """df written to and read back from the shared folder as CSV or JSON lines: quotes, line ends and nulls survive."""
    path = scratch_folder(spark, "exchange")
    options = {"header": "true", "multiLine": "true", "escape": '"', "nullValue": "\\N", "emptyValue": ""} if form == "csv" else {}
    df.write.format(form).options(**options).save(path)
    return spark.read.schema(df.schema).format(form).options(**options).load(path)


@query("SELECT p_partkey, p_name, p_brand || ' \"x\", ' || p_type || chr(10) || p_size AS note, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def section_export_csv(spark, sf):
    """A section exported as CSV and read again."""
    note = F.concat("p_brand", F.lit(' "x", '), "p_type", F.lit("\n"), F.col("p_size").cast("string"))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", note.alias("note"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return _exchange(spark, rows, "csv")


@query("SELECT p_partkey, p_name, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_retailprice END AS price FROM part")
def section_export_json(spark, sf):
    rows = table(spark, sf, "part").select("p_partkey", "p_name", F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice")).alias("price"))
    return _exchange(spark, rows, "json")


@query("SELECT o_orderkey AS file_id, o_orderpriority AS reason, o_totalprice AS size FROM orders WHERE o_orderstatus = 'P'")
def corrupt_export_csv(spark, sf):
    """Sources that could not be read, as CSV."""
    return _exchange(spark, table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("reason"), F.col("o_totalprice").alias("size")), "csv")


@query("SELECT n_name AS country, count(*) AS ranges, sum(hi - lo + 1)::BIGINT AS addresses, count(*) FILTER (WHERE hi < lo) AS refused FROM (SELECT n_name, c_custkey * 256 AS lo, c_custkey * 256 + CASE WHEN c_custkey % 100 = 0 THEN -1 ELSE 255 END AS hi FROM customer JOIN nation ON c_nationkey = n_nationkey) GROUP BY n_name")
def range_import(spark, sf):
    """Address ranges from a CSV of countries: numbers are read by schema, ranges that end before they start are counted apart."""
    c = table(spark, sf, "customer").join(table(spark, sf, "nation").select("n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = c.select((F.col("c_custkey") * 256).alias("lo"), (F.col("c_custkey") * 256 + F.when(F.col("c_custkey") % 100 == 0, -1).otherwise(255)).alias("hi"), F.col("n_name").alias("country"))
    r = _exchange(spark, rows, "csv")
    return r.groupBy("country").agg(F.count("*").alias("ranges"), F.sum(F.col("hi") - F.col("lo") + 1).alias("addresses"), n_if(F.col("hi") < F.col("lo")).alias("refused"))
