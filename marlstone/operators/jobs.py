"""The indexing queue as transitions of a jobs table, and the triage of jobs that run on a server.

A transition gives the table as it is afterwards. That no two sessions make one at a time is up to the caller's lock.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import backoff_ms, retryable, trimmed
from marlstone.operators.numbering import running_sum

LEASE_SECONDS, MAX_ATTEMPTS = 180, 50
LOST = "re-queued (worker lost heartbeat)"


def current(jobs: DataFrame) -> DataFrame:
    """One row per id: the one updated last, of equals the greatest in all columns."""
    rest = [c for c in jobs.columns if c not in ("id", "updated_at")]
    return jobs.where("id is not null").groupBy("id").agg(F.max(F.struct("updated_at", *rest)).alias("m")).select(*[F.col("id") if c == "id" else F.col(f"m.{c}").alias(c) for c in jobs.columns])


def job_view(jobs: DataFrame) -> DataFrame:
    """Jobs as they are shown: empty texts and zeros in the place of nulls, null in that of empty names and errors, reindex as a boolean."""
    text = lambda c: F.nullif(F.col(c), F.lit(""))
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    return jobs.select(
        "id", "label", text("name").alias("name"), "source", F.coalesce(F.col("reindex").cast("boolean"), F.lit(False)).alias("reindex"), "status", F.coalesce("progress", F.lit("")).alias("progress"),
        "chunks", text("error").alias("error"), count("attempts").alias("attempts"), F.coalesce("next_attempt_at", F.lit("1970-01-01").cast(jobs.schema["next_attempt_at"].dataType)).alias("next_attempt_at"),
        "owner", "created_at", "updated_at",
    )


def due(jobs: DataFrame, now: Column) -> DataFrame:
    return jobs.where((F.col("status") == "queued") & (F.coalesce("next_attempt_at", F.to_timestamp(F.lit("1970-01-01"))) <= now)).orderBy("id")


def first_due(jobs: DataFrame, now: Column) -> DataFrame:
    """The one job to be worked on next: of those that are due the one with the least id; no row if there is none."""
    return due(jobs, now).limit(1)


def claim(jobs: DataFrame, now: Column, owner: int) -> DataFrame:
    """The table after the first due job was taken by owner."""
    taken = F.broadcast(first_due(jobs, now).select("id", F.lit(True).alias("_taken")))  # one row
    mine = F.coalesce("_taken", F.lit(False))
    put = {"status": F.lit("processing"), "owner": F.lit(owner).cast("bigint"), "heartbeat": now, "updated_at": now}
    return jobs.join(taken, "id", "left").withColumns({c: F.when(mine, v).otherwise(F.col(c)) for c, v in put.items()}).drop("_taken").select(*jobs.columns)


def heartbeat(jobs: DataFrame, ids: list[int], now: Column) -> DataFrame:
    """The table after the owners of `ids` gave a sign of life; only jobs in work take it."""
    alive = F.col("id").isin(*ids) & (F.col("status") == "processing")
    return jobs.withColumns({c: F.when(alive, now).otherwise(F.col(c)) for c in ("heartbeat", "updated_at")})


def enqueue(jobs: DataFrame, new: DataFrame, now: Column) -> DataFrame:
    """The table with a queued job for every row of new (label, name, source, reindex), with ids after the greatest one, in order of label and source."""
    numbered = running_sum(new.select(F.lit(0).alias("_all"), "label", "name", "source", "reindex"), F.lit(1), ["_all"], ["label", "source", "name"], "_k")
    base = F.broadcast(jobs.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_base")))  # one row
    put = {
        "id": F.col("_base") + F.col("_k"), "label": F.col("label"), "name": F.col("name"), "source": F.col("source"), "reindex": F.coalesce("reindex", F.lit(False)), "status": F.lit("queued"),
        "progress": F.lit("queued"), "attempts": F.lit(0), "next_attempt_at": F.lit("1970-01-01"), "created_at": now, "updated_at": now,
    }
    rows = numbered.crossJoin(base).select(*[put.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in jobs.schema])
    return jobs.unionByName(rows)


LEGACY = "id bigint, label string, name string, source string, reindex boolean, status string, progress string, chunks int, error string, attempts int, queuedAt bigint"


def legacy_jobs(entries: DataFrame, now: Column) -> DataFrame:
    """Rows of the queue from the entries of its old JSON file (columns as in LEGACY; queuedAt in milliseconds).

    What was in work is queued again, and so is what failed for a passing reason; the rest is history. next_attempt_at is 1970.
    """
    status = F.coalesce("status", F.lit("queued"))
    status = F.when(status == "processing", "queued").when((status == "error") & retryable(F.coalesce("error", F.lit(""))), "queued").otherwise(status)
    return entries.select(
        "id", F.coalesce("label", F.lit("job")).alias("label"), F.nullif("name", F.lit("")).alias("name"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("reindex", F.lit(False)).alias("reindex"),
        status.alias("status"), F.coalesce("progress", F.when(status == "queued", "queued (migrated)").otherwise("")).alias("progress"), "chunks", F.nullif("error", F.lit("")).alias("error"),
        F.coalesce("attempts", F.lit(0)).alias("attempts"), F.timestamp_micros(F.lit(0)).alias("next_attempt_at"), F.coalesce(F.timestamp_millis("queuedAt"), now).alias("created_at"), now.alias("updated_at"),
    )


def requeue_stale(jobs: DataFrame, now: Column, lease: int = LEASE_SECONDS) -> DataFrame:
    """Jobs in work whose heartbeat is older than the lease are queued again at once, without an owner."""
    stale = (F.col("status") == "processing") & (F.col("heartbeat") < now - F.expr(f"interval {lease} seconds"))
    stale = F.coalesce(stale, F.lit(False))
    put = {"status": F.lit("queued"), "progress": F.lit(LOST), "next_attempt_at": now, "updated_at": now}
    return jobs.withColumns({**{c: F.when(stale, v).otherwise(F.col(c)) for c, v in put.items() if c in jobs.columns}, "owner": F.when(~stale, F.col("owner"))})


def after_failure(jobs: DataFrame, now: Column, most: int = MAX_ATTEMPTS) -> DataFrame:
    """(id, status, attempts, next_attempt_at) of jobs with an error: queued again after a growing wait if it may pass."""
    again = retryable(F.col("error")) & (F.coalesce("attempts", F.lit(0)) < most)
    n = F.coalesce("attempts", F.lit(0)) + F.when(again, 1).otherwise(0)
    wait = F.make_dt_interval(secs=(backoff_ms(n) / 1000).cast("decimal(18,6)"))
    return jobs.where("error is not null").select("id", F.when(again, "queued").otherwise("error").alias("status"), n.alias("attempts"), F.when(again, now + wait).alias("next_attempt_at"))


def recent(jobs: DataFrame, n: int = 5) -> DataFrame:
    return jobs.where(F.col("status").isin("done", "error")).orderBy(F.desc("id")).limit(n)


def active(jobs: DataFrame) -> DataFrame:
    return jobs.where(F.col("status").isin("queued", "processing")).orderBy("id")


def stats(jobs: DataFrame) -> DataFrame:
    names = ("queued", "processing", "done", "error")
    return jobs.agg(*[F.count_if(F.col("status") == s).alias(s) for s in names])


def latest_per_document(jobs: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc("updated_at"), F.desc("id"))
    return jobs.where("name is not null").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def pulled_results(files: DataFrame, results: DataFrame) -> DataFrame:
    """The files of remote jobs (job_id, stem, slug) with what the server has for each (job_id, stem, bundle, markdown, bundle_error): a left join."""
    return files.join(results, ["job_id", "stem"], "left")


def triage(files: DataFrame, states: DataFrame, results: DataFrame, known: DataFrame, replace: bool = False) -> DataFrame:
    """(job_id, stem, slug, outcome, detail), one row per file of the jobs that were not pulled yet: what a pull does with it.

    files: (job_id, stem, slug, pulled); states: (job_id, status, progress, error), without a row where the server gave no
    answer; results: see pulled_results; known: slugs that are in the collection. Outcomes: `waiting` for jobs not done,
    `failed` (detail is the error), `skipped` for known documents unless replace, `bundle` where the server has built one, else
    `markdown`, or `failed` where there is none. A job is pulled as a whole once it is done, so a second pull does nothing.
    """
    open_ = files.where(~F.coalesce("pulled", F.lit(False)))
    rows = pulled_results(open_, results).join(states, "job_id", "left").join(known.select("slug", F.lit(True).alias("_known")).distinct(), "slug", "left")
    empty = F.coalesce(trimmed(F.col("markdown")), F.lit("")) == ""
    outcome = (
        F.when(F.col("status").isNull(), "failed").when(F.col("status") == "error", "failed").when(F.col("status") != "done", "waiting")
        .when(F.col("_known") & F.lit(not replace), "skipped").when(F.col("bundle").isNotNull(), "bundle").when(empty, "failed").otherwise("markdown")
    )
    busy = F.col("status").isin("queued", "processing")
    detail = (
        F.when(F.col("status").isNull(), "no answer").when(F.col("status") == "error", F.coalesce("error", F.lit("job error"))).when(busy, F.coalesce("progress", F.lit("queued")))
        .when(F.col("status") != "done", F.col("status")).when(outcome == "failed", F.concat(F.lit("no OCR result for "), "stem")).when(outcome == "bundle", F.col("bundle"))
    )
    return rows.select("job_id", "stem", "slug", outcome.alias("outcome"), detail.alias("detail"))


def after_pull(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """files with pulled set for the jobs that are done (whatever became of their files)."""
    done = outcomes.groupBy("job_id").agg(F.bool_and(F.col("outcome").isin("skipped", "bundle", "markdown") | F.col("detail").startswith("no OCR result")).alias("_done"))
    return files.join(done, "job_id", "left").withColumn("pulled", F.coalesce("pulled", F.lit(False)) | F.coalesce("_done", F.lit(False))).drop("_done").select(*files.columns)
