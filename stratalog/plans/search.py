"""Search over files and packages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.keys import name_key, natural_key
from ..operators.searching import identity_column, staged, token_prefix
from ..registry import query
from ..tables import table

_D = "d AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS md5, source, lang FROM documents)"
PROBE = "d41d8cd98f00b204e9800998ecf8427e"


@query(f"WITH {_D} SELECT doc_id, md5 FROM d WHERE md5 = '{PROBE}' OR md5 IN (SELECT md5 FROM d WHERE doc_id = 7)")
def search_identity(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("md5"))
    column = identity_column(PROBE)
    return d.where(F.col(column) == PROBE).union(d.join(d.where("doc_id = 7").select("md5").distinct(), "md5", "left_semi").select("doc_id", "md5")).distinct()


@query("SELECT p_partkey, CASE WHEN starts_with(lower(p_name), 'a') THEN 1 WHEN starts_with(lower(p_brand), 'brand#1') THEN 2 ELSE 3 END AS stage, array_to_string(list_filter([CASE WHEN starts_with(lower(p_name), 'a') THEN 'name' END, CASE WHEN starts_with(lower(p_brand), 'brand#1') THEN 'brand' END, CASE WHEN starts_with(lower(p_type), 'eco') THEN 'type' END], lambda x: x IS NOT NULL), ',') AS fields FROM part WHERE starts_with(lower(p_name), 'a') OR starts_with(lower(p_brand), 'brand#1') OR starts_with(lower(p_type), 'eco')")
def search_prefix(spark, sf):
    return staged(table(spark, sf, "part"), "p_partkey", [("name", F.lower("p_name").startswith("a")), ("brand", F.lower("p_brand").startswith("brand#1")), ("type", F.lower("p_type").startswith("eco"))])


@query("SELECT p_partkey, CASE WHEN contains(lower(p_name), 'an') THEN 1 ELSE 2 END AS stage, concat_ws(',', CASE WHEN contains(lower(p_name), 'an') THEN 'name' END, CASE WHEN contains(lower(p_type), 'an') THEN 'type' END) AS fields FROM part WHERE contains(lower(p_name), 'an') OR contains(lower(p_type), 'an')")
def search_contains(spark, sf):
    return staged(table(spark, sf, "part"), "p_partkey", [("name", F.lower("p_name").contains("an")), ("type", F.lower("p_type").contains("an"))])


@query(f"WITH {_D}, c AS (SELECT doc_id, CASE WHEN starts_with(lower(text), 'the') THEN 1 WHEN contains(lower(text), 'licensed') THEN 2 END AS stage FROM d) SELECT doc_id, stage, row_number() OVER (ORDER BY stage, doc_id) AS rank FROM c WHERE stage IS NOT NULL ORDER BY stage, doc_id LIMIT 100")
def search_merged(spark, sf):
    t = F.lower(F.coalesce("text", F.lit("")))
    hits = staged(table(spark, sf, "documents").select("doc_id", "text"), "doc_id", [("start", t.startswith("the")), ("inside", t.contains("licensed"))])
    top = hits.orderBy("stage", "doc_id").limit(100)  # the cap of the feature
    from pyspark.sql import Window as W

    return top.select("doc_id", "stage", F.row_number().over(W.orderBy("stage", "doc_id")).alias("rank"))


@query("SELECT doc_id FROM documents WHERE len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'ther'))) > 0 AND len(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}_]+'), lambda x: starts_with(x, 'tion'))) > 0")
def search_token_prefix(spark, sf):
    return table(spark, sf, "documents").where(token_prefix(F.coalesce("text", F.lit("")), ["ther", "tion", "of"])).select("doc_id")


@query("SELECT p_partkey, p_name FROM part WHERE lower(trim(p_name)) IN (SELECT lower(trim(p_name)) FROM part WHERE p_partkey = 1)")
def search_exact_name(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_name", name_key(F.col("p_name")).alias("k"))
    return p.join(p.where("p_partkey = 1").select("k").distinct(), "k", "left_semi").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY CAST(regexp_extract(c_name, '([0-9]+)', 1) AS BIGINT), c_custkey) AS place FROM customer")
def natural_order(spark, sf):
    """Places in natural order within a list (customers of a nation and segment)."""
    from pyspark.sql import Window as W

    named = table(spark, sf, "customer").withColumn("k", natural_key(F.col("c_name")))
    return named.select("c_custkey", "c_nationkey", F.row_number().over(W.partitionBy("c_nationkey", "c_mktsegment").orderBy("k", "c_custkey")).alias("place"))
