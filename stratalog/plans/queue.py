"""Work-queue metrics, claim order, admission and retries, telemetry."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.keys import display_status, retry_delay
from ..operators.rollup import n_if
from ..registry import query
from ..tables import table

#: "Now" of all reports, so that results can be repeated.
NOW = "2024-02-01 00:00:00"
_Q = "CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'running' ELSE 'done' END"


def jobs(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.expr(_Q).alias("status"), F.col("o_orderpriority").alias("queue"), F.col("o_orderdate").alias("available_at"), F.col("o_custkey").alias("parent"), F.col("o_totalprice").alias("cost"))


_J = f"j AS (SELECT o_orderkey AS id, {_Q} AS status, o_orderpriority AS queue, o_orderdate AS available_at, o_custkey AS parent, o_totalprice AS cost FROM orders)"


@query(f"WITH {_J} SELECT queue, status, count(*) AS jobs, CAST(floor(epoch(TIMESTAMP '{NOW}' - min(available_at))) AS BIGINT) AS oldest_seconds FROM j GROUP BY ALL")
def queue_metrics(spark, sf):
    return jobs(spark, sf).groupBy("queue", "status").agg(F.count("*").alias("jobs"), F.expr(f"timestampdiff(SECOND, min(available_at), TIMESTAMP '{NOW}')").alias("oldest_seconds"))


@query(f"WITH {_J} SELECT queue, CAST(count(*) FILTER (WHERE status = 'queued') AS BIGINT) AS queued, CAST(count(*) FILTER (WHERE status = 'running') AS BIGINT) AS running FROM j GROUP BY queue")
def queue_totals(spark, sf):
    return jobs(spark, sf).groupBy("queue").agg(n_if(F.col("status") == "queued").alias("queued"), n_if(F.col("status") == "running").alias("running"))


@query("SELECT event_type AS status, coalesce(json_extract_string(CASE WHEN user_id % 3 = 0 THEN '{\"display_status\":\"waiting\"}' WHEN user_id % 3 = 1 THEN props ELSE '{}' END, '$.display_status'), event_type) AS display_status, count(*) AS jobs FROM events GROUP BY ALL")
def display_status_counts(spark, sf):
    payload = F.when(F.col("user_id") % 3 == 0, F.lit('{"display_status":"waiting"}')).when(F.col("user_id") % 3 == 1, F.col("props")).otherwise(F.lit("{broken"))
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("status"), display_status(payload, F.col("event_type")).alias("display_status")).agg(F.count("*").alias("jobs"))


@query(f"WITH {_J}, r AS (SELECT DISTINCT parent FROM j WHERE status = 'running') SELECT id, queue, row_number() OVER (PARTITION BY queue ORDER BY available_at, id) AS position FROM j WHERE status = 'queued' AND available_at <= TIMESTAMP '{NOW}' AND parent NOT IN (SELECT parent FROM r)")
def claim_order(spark, sf):
    j = jobs(spark, sf)
    free = j.where(f"status = 'queued' AND available_at <= TIMESTAMP '{NOW}'").join(j.where("status = 'running'").select("parent").distinct(), "parent", "left_anti")
    return free.select("id", "queue", F.row_number().over(W.partitionBy("queue").orderBy("available_at", "id")).alias("position"))


@query(f"WITH {_J}, q AS (SELECT id, queue, parent, row_number() OVER (PARTITION BY queue, parent ORDER BY available_at, id) AS n FROM j WHERE status = 'queued') SELECT id, queue, parent, n <= 2 AS admitted FROM q")
def admission(spark, sf):
    q = jobs(spark, sf).where("status = 'queued'").withColumn("n", F.row_number().over(W.partitionBy("queue", "parent").orderBy("available_at", "id")))
    return q.select("id", "queue", "parent", (F.col("n") <= 2).alias("admitted"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(power(2, least(8, user_id % 12)) AS INTEGER) END AS delay FROM events")
def retry_delays(spark, sf):
    return table(spark, sf, "events").select("event_id", retry_delay((F.col("user_id") % 12).cast("int"), F.col("event_type") == "error").alias("delay"))


@query("SELECT event_type AS context, count(*) AS samples, CAST(round(sum(value), 4) AS DOUBLE) AS total, max(value) AS most, arg_max(value, (ts, event_id)) AS latest, CAST(count(*) FILTER (WHERE value >= 100) AS BIGINT) AS slow, CAST(floor(round(sum(value), 4) / count(*)) AS BIGINT) AS average FROM events GROUP BY event_type")
def count_telemetry(spark, sf):
    total = F.round(F.sum("value"), 4)
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("context")).agg(F.count("*").alias("samples"), total.alias("total"), F.max("value").alias("most"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"), n_if(F.col("value") >= 100).alias("slow"), F.floor(total / F.count("*")).alias("average"))


_A = "CASE WHEN (full_scan AND n >= 50000) OR (sorts AND n >= 10000) THEN 'investigate' WHEN (full_scan AND n >= 5000) OR (sorts AND n >= 1000) OR (NOT indexed AND n >= 10000) THEN 'watch' ELSE 'normal' END"


@query(f"WITH p AS (SELECT l_shipdate::DATE AS context, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM lineitem), q AS (SELECT *, context IS NULL OR month(context) = 1 AS full_scan, coalesce(month(context) = 2, false) AS sorts, coalesce(month(context) > 3, false) AS indexed FROM p) SELECT context, n, full_scan, sorts, indexed, {_A} AS assessment FROM q")
def plan_assessment(spark, sf):
    """Row counts of plans (one a day, and one over all) against the marks for full scans, sorts and plans without a key."""
    line = table(spark, sf, "lineitem").select(F.to_date("l_shipdate").alias("context"))
    p = line.groupBy("context").agg(F.count("*").alias("n")).unionByName(line.agg(F.count("*").alias("n")).select(F.lit(None).cast("date").alias("context"), "n"))
    month = F.month("context")
    q = p.withColumn("full_scan", F.col("context").isNull() | (month == 1)).withColumn("sorts", F.coalesce(month == 2, F.lit(False))).withColumn("indexed", F.coalesce(month > 3, F.lit(False)))
    return q.withColumn("assessment", F.expr(_A))


@query(f"WITH {_J} SELECT p.queue, count(DISTINCT q.parent) AS blocked_roots, count(*) AS blocked FROM j q JOIN (SELECT DISTINCT parent, queue FROM j WHERE status = 'running') p USING (parent) WHERE q.status = 'queued' GROUP BY p.queue")
def blocked_work(spark, sf):
    j = jobs(spark, sf)
    running = j.where("status = 'running'").select("parent", "queue").distinct()
    return j.where("status = 'queued'").select("parent").join(running, "parent").groupBy("queue").agg(F.countDistinct("parent").alias("blocked_roots"), F.count("*").alias("blocked"))


_ENQ = "e AS (SELECT event_id, event_type, user_id, ts, event_type || ':' || user_id AS dedupe_key, event_type IN ('view', 'click') AS active FROM events)"


@query(f"WITH {_ENQ}, k AS (SELECT dedupe_key, min(event_id) AS job_id, count(*) AS asked FROM e WHERE active GROUP BY dedupe_key) SELECT job_id, dedupe_key, asked - 1 AS refused FROM k UNION ALL SELECT event_id, dedupe_key, 0 FROM e WHERE NOT active")
def enqueue_deduplicated(spark, sf):
    """Jobs after enqueueing: one for each active key, the first asked for, with how many were refused; ended ones stand alone."""
    e = table(spark, sf, "events").select("event_id", F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("dedupe_key"), F.col("event_type").isin("view", "click").alias("active"))
    k = e.where("active").groupBy("dedupe_key").agg(F.min("event_id").alias("job_id"), (F.count("*") - 1).alias("refused"))
    return k.select("job_id", "dedupe_key", "refused").unionByName(e.where("NOT active").select(F.col("event_id").alias("job_id"), "dedupe_key", F.lit(0).cast("long").alias("refused")))


@query("WITH u AS (SELECT o_custkey AS workflow, o_orderkey AS file_id, floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4)::BIGINT AS unit FROM orders) SELECT workflow, unit, count(*) AS files, min(file_id) AS first_file, max(file_id) AS last_file FROM u GROUP BY ALL")
def bulk_units(spark, sf):
    """A workflow's files in units of four, in order."""
    from pyspark.sql import Window as W

    at = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey"))
    u = table(spark, sf, "orders").select(F.col("o_custkey").alias("workflow"), F.col("o_orderkey").alias("file_id"), F.floor((at - 1) / 4).alias("unit"))
    return u.groupBy("workflow", "unit").agg(F.count("*").alias("files"), F.min("file_id").alias("first_file"), F.max("file_id").alias("last_file"))
