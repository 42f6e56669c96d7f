from datetime import datetime, timedelta

from pyspark.sql import functions as F

from marlstone.operators import jobs
from marlstone.streaming import ingest

NOW = datetime(2024, 5, 1)
SCHEMA = "id bigint, name string, status string, error string, attempts int, next_attempt_at timestamp, owner bigint, heartbeat timestamp, updated_at timestamp"


def table(spark, rows):
    base = {"name": "a", "status": "queued", "error": None, "attempts": 0, "next_attempt_at": None, "owner": None, "heartbeat": None, "updated_at": NOW}
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], SCHEMA)


def test_states(spark):
    now = F.lit(NOW)
    rows = table(spark, [{"id": 1}, {"id": 2, "next_attempt_at": NOW + timedelta(1)}, {"id": 3, "status": "done"}, {"id": 1, "status": "error", "updated_at": NOW + timedelta(1)}, {"id": 1}])
    cur = jobs.current(rows)
    assert {(r.id, r.status) for r in cur.collect()} == {(1, "error"), (2, "queued"), (3, "done")}
    assert [r.id for r in jobs.due(table(spark, [{"id": 5}, {"id": 4}, {"id": 6, "next_attempt_at": NOW + timedelta(1)}]), now).collect()] == [4, 5]
    assert [r.id for r in jobs.recent(cur, 1).collect()] == [3] and [r.id for r in jobs.active(cur).collect()] == [2]
    assert jobs.stats(cur).first().asDict() == {"queued": 1, "processing": 0, "done": 1, "error": 1}
    assert jobs.latest_per_document(cur).count() == 1


def test_leases(spark):
    beats = [{"id": i, "status": "processing", "owner": 7, "heartbeat": NOW - timedelta(seconds=s)} for i, s in ((1, 180), (2, 181))]
    got = {r.id: (r.status, r.owner) for r in jobs.requeue_stale(table(spark, beats), F.lit(NOW)).collect()}
    assert got == {1: ("processing", 7), 2: ("queued", None)}


def test_claim_and_heartbeat(spark):
    now = F.lit(NOW + timedelta(hours=1))
    rows = table(spark, [{"id": 2}, {"id": 1, "next_attempt_at": NOW + timedelta(1)}, {"id": 3}, {"id": 0, "status": "done"}])
    once = jobs.claim(rows, now, 9)
    assert {(r.id, r.status, r.owner) for r in once.collect()} == {(0, "done", None), (1, "queued", None), (2, "processing", 9), (3, "queued", None)}
    assert {r.id for r in jobs.claim(once, now, 8).where("owner = 8").collect()} == {3}
    assert jobs.first_due(rows.where("false"), now).count() == 0 and jobs.claim(rows.where("id < 2"), now, 9).where("owner is not null").count() == 0
    assert {r.id for r in jobs.heartbeat(once, [2, 3], now).where(F.col("heartbeat") == now).collect()} == {2}


def test_pull_triage(spark):
    files = spark.createDataFrame([("a", "s1", "A", False), ("a", "s2", "B", None), ("a", "s3", "C", False), ("b", "s", "D", False), ("c", "s", "E", True), ("d", "s", "F", False), ("e", "s", "G", False)], "job_id string, stem string, slug string, pulled boolean")
    states = spark.createDataFrame([("a", "done", None, None), ("b", "processing", "3 of 9", None), ("c", "done", None, None), ("e", "error", None, "boom")], "job_id string, status string, progress string, error string")
    results = spark.createDataFrame([("a", "s1", "A.gz", None), ("a", "s2", None, "# text"), ("a", "s3", None, " ")], "job_id string, stem string, bundle string, markdown string")
    known = spark.createDataFrame([("A",)], "slug string")
    got = {(r.job_id, r.slug): (r.outcome, r.detail) for r in jobs.triage(files, states, results, known).collect()}
    assert got == {("a", "A"): ("skipped", None), ("a", "B"): ("markdown", None), ("a", "C"): ("failed", "no OCR result for s3"), ("b", "D"): ("waiting", "3 of 9"), ("d", "F"): ("failed", "no answer"), ("e", "G"): ("failed", "boom")}
    again = jobs.triage(files, states, results, known, replace=True)
    assert again.where("slug = 'A'").first().outcome == "bundle"
    after = jobs.after_pull(files, again)
    assert {r.job_id for r in after.where("pulled").collect()} == {"a", "c"}
    assert jobs.triage(after, states, results, known).where("job_id = 'a'").count() == 0


def test_failures(spark):
    rows = [{"id": 1, "error": "HTTP 502", "attempts": 0}, {"id": 2, "error": "timed out", "attempts": 49}, {"id": 3, "error": "timed out", "attempts": 50}, {"id": 4, "error": "no such file"}]
    got = {r.id: (r.status, r.attempts, r.next_attempt_at) for r in jobs.after_failure(table(spark, rows), F.lit(NOW)).collect()}
    assert got == {1: ("queued", 1, NOW + timedelta(seconds=30)), 2: ("queued", 50, NOW + timedelta(seconds=600)), 3: ("error", 50, None), 4: ("error", 0, None)}


def test_index_stream(spark, tmp_path):
    spark.createDataFrame([(1, "quick fox"), (1, "quick fox"), (2, "fox")], "chunk_id bigint, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    out = []
    q = ingest.index_stream(ingest.chunk_stream(spark, str(tmp_path / "in"), "chunk_id bigint, text string"), lambda df, n: out.extend((r.term, r.chunk_id, r.tf) for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert sorted(out) == [("fox", 1, 1), ("fox", 2, 1), ("quick", 1, 1)]


def test_sessions(spark):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    df = spark.createDataFrame([(1, at(0), 1.0), (1, at(29), 2.0), (1, at(80), 4.0), (2, at(0), 8.0)], "user_id int, ts timestamp, value double")
    assert sorted((r.user_id, r.n, r.total) for r in ingest.sessions(df).collect()) == [(1, 1, 4.0), (1, 2, 3.0), (2, 1, 8.0)]


def test_leases_run_out_on_a_stream(spark, tmp_path):
    at = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    import time

    for n, rows in enumerate([[(1, at(0)), (1, at(1))], [(2, at(60))], [(2, at(61)), (3, at(120))], [(4, at(121))]]):
        spark.createDataFrame(rows, "job bigint, at timestamp").coalesce(1).write.parquet(str(tmp_path / f"b{n}"))
        src = next((tmp_path / f"b{n}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        src.rename(tmp_path / "in" / f"{n}.parquet")
        time.sleep(0.02)
    beats = spark.readStream.schema("job bigint, at timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.expired_leases(beats).writeStream.format("memory").queryName("expired").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert sorted((r.job, r["last"]) for r in spark.sql("select * from expired").collect()) == [(1, at(1)), (2, at(61))]
