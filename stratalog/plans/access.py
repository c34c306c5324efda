"""Access-log reports, address ranges, event promotion, error fingerprints."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import error_fingerprint
from ..operators.joins import range_lookup
from ..operators.rollup import n_if
from ..registry import query
from ..tables import table

TYPES = ("click", "error", "purchase", "signup", "view")
#: Address ranges, not overlapping, with gaps: (first, last, country).
RANGES = ((0, 29, "DE"), (30, 59, "FR"), (70, 99, "ES"), (100, 139, "US"))


@query(f"""SELECT count(*) AS events, {', '.join(f"CAST(count(*) FILTER (WHERE event_type = '{t}') AS BIGINT) AS {t}s" for t in TYPES)}, count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'view' THEN user_id END) AS viewers, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS buyers FROM events""")
def access_summary(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").agg(F.count("*").alias("events"), *(n_if(kind == t).alias(f"{t}s") for t in TYPES), F.countDistinct("user_id").alias("users"), F.countDistinct(F.when(kind == "view", F.col("user_id"))).alias("viewers"), F.countDistinct(F.when(kind == "purchase", F.col("user_id"))).alias("buyers"))


@query("SELECT json_extract_string(props, '$.k') AS page, count(*) AS hits, count(DISTINCT user_id) AS users, min(ts) AS first_seen FROM events GROUP BY 1 ORDER BY hits DESC, page LIMIT 20")
def top_pages(spark, sf):
    return table(spark, sf, "events").groupBy(F.get_json_object("props", "$.k").alias("page")).agg(F.count("*").alias("hits"), F.countDistinct("user_id").alias("users"), F.min("ts").alias("first_seen")).orderBy(F.desc("hits"), "page").limit(20)


@query(f"""SELECT user_id, count(*) AS hits, {', '.join(f"CAST(count(*) FILTER (WHERE event_type = '{t}') AS BIGINT) AS {t}s" for t in TYPES)}, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY hits DESC, user_id LIMIT 50""")
def top_ips(spark, sf):
    kind = F.col("event_type")
    return table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("hits"), *(n_if(kind == t).alias(f"{t}s") for t in TYPES), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).orderBy(F.desc("hits"), "user_id").limit(50)


@query("SELECT a.role AS from_role, b.role AS to_role, count(*) AS steps, count(DISTINCT a.conv_id) AS conversations FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 GROUP BY ALL")
def navigation_matrix(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "role")
    nxt = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("to_role"))
    return c.join(nxt, ["conv_id", "turn"]).groupBy(F.col("role").alias("from_role"), "to_role").agg(F.count("*").alias("steps"), F.countDistinct("conv_id").alias("conversations"))


@query("SELECT event_type, CAST(floor(epoch(ts) / 86400) AS BIGINT) AS day, count(*) AS hits FROM events WHERE event_type IN ('view', 'click') GROUP BY ALL")
def access_filtered_groups(spark, sf):
    return table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).groupBy("event_type", F.floor(F.unix_timestamp("ts") / 86400).alias("day")).agg(F.count("*").alias("hits"))


@query(f"SELECT event_id, user_id, country FROM events LEFT JOIN (VALUES {', '.join(f'({a}, {b}, {chr(39)}{c}{chr(39)})' for a, b, c in RANGES)}) AS r(lo, hi, country) ON user_id BETWEEN lo AND hi")
def geoip_lookup(spark, sf):
    ranges = spark.createDataFrame(RANGES, "lo long, hi long, country string")
    return range_lookup(table(spark, sf, "events").select("event_id", "user_id"), ranges, "user_id", "lo", "hi", "country")


@query("""WITH s AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'view'), c AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click')
SELECT c.event_id AS click_id, s.event_id AS view_id, epoch(c.ts) - epoch(s.ts) <= 15 AS promoted FROM c LEFT JOIN LATERAL (SELECT event_id, ts FROM s WHERE s.user_id = c.user_id AND s.ts <= c.ts AND s.ts >= c.ts - INTERVAL 15 SECOND ORDER BY s.ts DESC, s.event_id DESC LIMIT 1) s ON true""")
def event_promotion_15s(spark, sf):
    """A click promotes the user's latest view of the 15 seconds before. Views stand in their own 15-second bucket and the
    next, so a click meets all it may promote in its bucket, and a busy user is many groups."""
    e = table(spark, sf, "events").where(F.col("event_type").isin("view", "click")).select("event_id", "user_id", "ts", "event_type", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 15_000_000).alias("b"))
    e = e.withColumn("b", F.explode(F.when(F.col("event_type") == "view", F.array("b", F.col("b") + 1)).otherwise(F.array("b"))))
    before = W.partitionBy("user_id", "b").orderBy("ts", F.when(F.col("event_type") == "view", 0).otherwise(1), "event_id").rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("event_type") == "view", F.struct("event_id", "ts")), ignorenulls=True).over(before)
    e = e.withColumn("v", last).where("event_type = 'click'")
    fresh = F.col("v.ts") >= F.col("ts") - F.expr("INTERVAL 15 SECOND")
    return e.select(F.col("event_id").alias("click_id"), F.when(fresh, F.col("v.event_id")).alias("view_id"), F.when(fresh, F.lit(True)).alias("promoted"))


_MSG = "'Error ' || event_id || ' in \"' || event_type || '\" at 0x' || to_hex(event_id + 4096) || ' for user ' || user_id"


@query(f"""WITH m AS (SELECT event_id, ts, lower({_MSG}) AS m FROM events WHERE event_type = 'error'),
f AS (SELECT event_id, ts, sha256(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(m, '''[^'']*''|"[^"]*"', '{{name}}', 'g'), '0x[0-9a-f]+|[0-9a-f]{{16,}}', '{{hex}}', 'g'), '[0-9]+', '{{id}}', 'g'), '[ \t\r\n]+', ' ', 'g'))) AS fingerprint FROM m)
SELECT fingerprint, count(*) AS occurrences, min(ts) AS first_seen, max(ts) AS last_seen, min(event_id) AS first_event FROM f GROUP BY fingerprint""")
def error_fingerprints(spark, sf):
    e = table(spark, sf, "events").where("event_type = 'error'")
    message = F.concat(F.lit("Error "), "event_id", F.lit(' in "'), "event_type", F.lit('" at 0x'), F.hex(F.col("event_id") + 4096), F.lit(" for user "), "user_id")
    return e.groupBy(error_fingerprint(message).alias("fingerprint")).agg(F.count("*").alias("occurrences"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("event_id").alias("first_event"))
