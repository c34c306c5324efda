from datetime import datetime

from stratalog.streaming import incremental as inc
from stratalog.streaming import jobs


def test_affected_files_of_a_stream(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", 1, 7), (2, "b", 1, 8), (3, "c", 0, None), (4, "d", 2, 8)], "file_id long, package string, outcome int, provider long")
    schema = "package string, provider long"
    spark.createDataFrame([("c", None), (None, 8)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    q = inc.watch_changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), edges, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert {r.file_id for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {2, 3}


def test_loads_overlap_and_repeat(spark):
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    schema = "id long, v string, updated timestamp"
    old = spark.createDataFrame([(1, "x", at(1)), (2, "y", at(5))], schema)
    new = spark.createDataFrame([(1, "z", at(6)), (2, "y2", at(5)), (3, "old", at(1))], schema)
    fresh = inc.since(new, "updated", at(6))
    assert {r.id for r in fresh.collect()} == {1, 2}
    once = inc.upsert(old, fresh, "id", "updated")
    assert sorted((r.id, r.v) for r in once.collect()) == sorted((r.id, r.v) for r in inc.upsert(once, fresh, "id", "updated").collect()) == [(1, "z"), (2, "y2")]
    assert inc.since(new, "updated", None).count() == 3


def test_job_steps():
    s = jobs.NEW
    for event, at, worker, want in [("claim", 0, "w", False), ("enqueue", 0, None, True), ("enqueue", 0, None, False), ("claim", 1, "a", True), ("claim", 2, "b", False), ("heartbeat", 5, "b", False), ("heartbeat", 9, "a", True), ("claim", 20, "b", True), ("complete", 21, "a", False), ("fail", 22, "b", True)]:
        s, ok = jobs.step(s, event, at, worker, 10, False)
        assert ok is want, (event, at)
    assert s[0] == "queued" and s[4] == 22 + 4
    assert jobs.step(s, "claim", 25, "c", 10, False)[1] is False
    s, _ = jobs.step(s, "claim", 26, "c", 10, False)
    assert jobs.step(s, "fail", 27, "c", 10, False)[0][0] == "dead"
    s, _ = jobs.step(s, "cancel", 27, None, 0, False)
    assert jobs.step(s, "fail", 28, "c", 10, False) == (s, False) and s[0] == "cancelled"


def test_job_stream(spark, tmp_path):
    schema = "job_id long, seq long, at double, event string, worker string, lease_s double, deterministic boolean, max_attempts int"
    rows = [(j, s, float(s), e, "w" if e != "enqueue" else None, 10.0, None, None) for j in (1, 2) for s, e in enumerate(["enqueue", "claim", "complete" if j == 1 else "fail"])]
    for k in range(2):  # two files: the state passes from batch to batch
        spark.createDataFrame([r for r in rows if (r[1] == 2) == (k == 1)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = jobs.job_states(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {(r.job_id, r.event): (r.accepted, r.status, r.attempts) for r in spark.read.parquet(out).collect()}
    assert got[1, "complete"] == (True, "done", 1) and got[2, "fail"] == (True, "queued", 1) and len(got) == 6
