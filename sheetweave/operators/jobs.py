"""Jobs, results, request logs and feedback as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheetweave.functions.text import SUPPORTED, extension

#: States of a job, in the order it passes them (fixed values).
STATES = ("queued", "running", "succeeded", "failed")
RANK = {s: i for i, s in enumerate(STATES)}
#: The states that may follow each; a job begins queued.
FOLLOWS = {None: ("queued",), "queued": ("running",), "running": ("succeeded", "failed")}


def job_state(events: DataFrame, created: Column | None = None) -> DataFrame:
    """The current row of each job from (job_id, ts, status, error): last by time, a later state before an earlier at one time.
    created: an aggregate for created_at other than the first time."""
    rank = F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status"))
    at = F.struct("ts", rank)
    return events.groupBy("job_id").agg(
        F.max_by("status", at).alias("status"), F.max_by("error", at).alias("error"), (F.min("ts") if created is None else created).alias("created_at"),
        F.min(F.when(F.col("status") == "running", F.col("ts"))).alias("started_at"),
        F.max(F.when(F.col("status").isin("succeeded", "failed"), F.col("ts"))).alias("finished_at")
    )


def replay(events: DataFrame) -> DataFrame:
    """events (job_id, seq, ts, status, error) with accepted and was, the state that each met, as the stream of job states
    would judge them in order of time, state and seq, without its time limit.

    A job moves three times at most, so its moves are three least events, each the least after the one before: sums that
    shrink before they are shuffled, and joins on the job, but no list or window of a job's events. Events of one seq count once."""
    at = F.struct("ts", F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATES]), F.col("status")), F.lit(0)).alias("rank"), "seq")
    rows = events.dropDuplicates(["job_id", "seq"]).withColumn("_at", at)
    moves = [("_queued", ("queued",), None), ("_running", ("running",), "_queued"), ("_ended", ("succeeded", "failed"), "_running")]
    for name, states, after in moves:
        may = F.col("status").isin(*states)
        least = rows.where(may & (F.col("_at") > F.col(after)) if after else may).groupBy("job_id").agg(F.min("_at").alias(name))
        rows = rows.join(least, "job_id", "left")
    met = F.when(F.col("_at") > F.col("_ended"), F.lit("_ended")).when(F.col("_at") > F.col("_running"), "running").when(F.col("_at") > F.col("_queued"), "queued")
    ended = rows.where(F.col("_at") == F.col("_ended")).select("job_id", F.col("status").alias("_last"))
    rows = rows.withColumn("was", met).join(ended, "job_id", "left").withColumn("was", F.when(F.col("was") == "_ended", F.col("_last")).otherwise(F.col("was")))
    accepted = F.coalesce(F.col("_at").isin(*[F.col(n) for n, _, _ in moves]), F.lit(False))
    return rows.withColumn("accepted", accepted).drop("_at", "_last", *[n for n, _, _ in moves])


def recent_jobs(jobs: DataFrame, status: str | None = None, limit: int = 20) -> DataFrame:
    rows = jobs if status is None else jobs.where(F.col("status") == status)
    return rows.orderBy(F.desc("created_at"), "job_id").limit(min(limit, 200))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with rows put in, replacing those of equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").unionByName(rows)


def patch(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """table with the columns of rows set where keys match; a null leaves what was there. Keys that are new are added."""
    given = [c for c in rows.columns if c not in keys]
    new = rows.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in given])
    out = table.join(new, keys, "full")
    values = [F.coalesce(F.col(f"_new_{c}"), F.col(c)).alias(c) if c in given else F.col(c) for c in table.columns if c not in keys]
    return out.select(*keys, *values, *[F.col(f"_new_{c}").alias(c) for c in given if c not in table.columns])


def find(table: DataFrame, key: str, value) -> DataFrame:
    """The row of one key; the filter reaches the files."""
    return table.where(F.col(key) == value)


def upload_status(name: Column, size: Column, max_mb: int) -> Column:
    """HTTP status of an upload: 415 unknown ending, 400 empty, 413 too large, 202 taken."""
    return F.when(~extension(name).isin(*SUPPORTED), 415).when(size == 0, 400).when(size > max_mb * 1024 * 1024, 413).otherwise(202)


def result_status(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """For asked-for jobs (job_id, status null if unknown): 404 unknown, 409 not succeeded, 404 without a result, else 200."""
    has = results.select("job_id").distinct().withColumn("_has", F.lit(True))
    code = F.when(F.col("status").isNull(), 404).when(F.col("status") != "succeeded", 409).when(F.col("_has").isNull(), 404).otherwise(200)
    return jobs.join(has, "job_id", "left").withColumn("code", code).drop("_has")


def valid_feedback(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    """Feedback on known jobs with a rating of 1 to 5 or none, and at most 5000 characters."""
    ok = (F.col("rating").isNull() | F.col("rating").between(1, 5)) & (F.coalesce(F.length("comment"), F.lit(0)) <= 5000)
    return feedback.where(ok).join(jobs.select("job_id"), "job_id", "left_semi")


def request_summary(logs: DataFrame) -> DataFrame:
    """(path, status_code, n, mean_ms, slowest_ms) without health checks; paths are cut at 512 characters and latencies
    kept to hundredths, as the log holds them."""
    rows = logs.where(~F.col("path").isin("/healthz", "/readyz"))
    rows = rows.withColumns({"path": F.substring("path", 1, 512), "latency_ms": F.round("latency_ms", 2)})
    return rows.groupBy("path", "status_code").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("mean_ms"), F.max("latency_ms").alias("slowest_ms"))


def clean_metrics(metrics: Column) -> Column:
    """A map of texts as finite numbers under plain names; what is no number goes, of names that become equal the last stays."""
    plain = lambda k: F.regexp_replace(F.trim(k), r"[^A-Za-z0-9_./ -]", "_")
    entries = F.transform(F.map_entries(metrics), lambda e: F.struct(plain(e["key"]).alias("key"), e["value"].try_cast("double").alias("value")))
    finite = F.filter(entries, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < F.lit(float("inf"))))
    last = F.filter(finite, lambda e, i: ~F.exists(F.slice(finite, i + 2, F.greatest(F.size(finite) - i - 1, F.lit(0))), lambda x: x["key"] == e["key"]))
    return F.map_from_entries(last)
