"""Jobs, their logs and history, telemetry, and deletion with what depends on it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.urls import url_hash
from webloom.operators.crawl import ring
from webloom.operators.index import purge_origin

LOG_ROWS, HISTORY_ROWS = 50, 500


def job_logs(logs: DataFrame, size: int = LOG_ROWS) -> DataFrame:
    """The newest lines of each job: logs(job_id, ts, seq, level, msg)."""
    return ring(logs, "job_id", ["ts", "seq"], size)


def history(archives: DataFrame, size: int | None = HISTORY_ROWS) -> DataFrame:
    """archives(seq, job_id, ...): an entry keeps the place of the job's first and has the values of its last; the newest places stay, or all where size is None. place, then the last row's columns."""
    rest = [c for c in archives.columns if c not in ("seq", "job_id")]
    rows = archives.groupBy("job_id").agg(F.min("seq").alias("place"), F.max_by(F.struct(*rest), "seq").alias("last"))
    if size is not None:
        rows = rows.orderBy(F.col("place").desc()).limit(size)
    return rows.select("place", "job_id", "last.*")


def history_page(past: DataFrame, limit: int = 100) -> tuple[DataFrame, DataFrame]:
    """The newest entries of a history(place, ...), newest first, and a row with the count of all. limit must be 1 to 1000."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit must be 1 to 1000")
    return past.orderBy(F.col("place").desc()).limit(limit), past.agg(F.count(F.lit(1)).alias("count"))


def recent(live_jobs: DataFrame, past: DataFrame, size: int = 5) -> DataFrame:
    """The jobs last started, each once, live ones before their history."""
    return job_list(live_jobs, past).orderBy(F.coalesce("started_at", F.lit(0.0)).desc(), "job_id").limit(size)


def ticking(uptime_then: Column, polled_at: Column, now: Column, running: Column) -> Column:
    """An uptime as shown between two polls: it goes on while the job runs."""
    return uptime_then + F.when(running, F.greatest(now - polled_at, F.lit(0.0))).otherwise(F.lit(0.0))


def uptime(started: Column, ended: Column, now: Column) -> Column:
    return F.when(F.coalesce(started, F.lit(0.0)) == 0, F.lit(0.0)).otherwise(F.coalesce(ended, now) - started)


def speed(crawled: Column, seconds: Column) -> Column:
    return F.when(seconds > 0, crawled / seconds).otherwise(F.lit(0.0))


def metrics(jobs: DataFrame) -> DataFrame:
    """One row over jobs(crawled, errors, pending, dropped, ended_at, paused)."""
    sums = [F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).cast("long").alias(n) for c, n in (("crawled", "total_crawled"), ("errors", "total_errors"), ("pending", "pending_total"), ("dropped", "dropped_total"))]
    active = F.coalesce(F.col("ended_at"), F.lit(0.0)) == 0
    return jobs.agg(*sums, F.count_if(active).alias("active_jobs"), F.count_if(F.coalesce("paused", F.lit(False))).alias("paused_jobs"), F.count(F.lit(1)).alias("total_jobs"))


def global_metrics(jobs: DataFrame, past: DataFrame, visited: DataFrame, metadata: DataFrame, index: DataFrame) -> DataFrame:
    """The twelve figures of a service: metrics() with the sizes of the stores beside it, each one row."""
    from webloom.operators.index import node_count, vocabulary_size

    out = metrics(jobs)
    for df, name in ((past, "history_count"), (visited, "visited_urls"), (metadata, "indexed_pages")):
        out = out.join(df.agg(F.count(F.lit(1)).alias(name)))
    return out.join(vocabulary_size(index)).join(node_count(index))


def job_list(live: DataFrame, past: DataFrame) -> DataFrame:
    """Jobs of both tables, each once, live ones first and before their history; then by start, newest first."""
    rows = live.withColumn("is_active", F.lit(True)).unionByName(past.withColumn("is_active", F.lit(False)))
    rest = [c for c in rows.columns if c != "job_id"]
    best = rows.groupBy("job_id").agg(F.max_by(F.struct(*rest), F.struct(F.col("is_active"), F.coalesce("started_at", F.lit(0.0)))).alias("j"))
    return best.select("job_id", "j.*").orderBy(F.col("is_active").desc(), F.coalesce("started_at", F.lit(0.0)).desc(), "job_id")


def job_status(ids: DataFrame, live: DataFrame, past: DataFrame) -> DataFrame:
    """ids(job_id) with the live status, else the newest in the history(place), else null."""
    newest = past.groupBy("job_id").agg(F.max_by("status", "place").alias("old"))
    return ids.join(live.select("job_id", "status"), "job_id", "left").join(newest, "job_id", "left").select("job_id", F.coalesce("status", "old").alias("status"))


def status_label(started: Column, ended: Column, paused: Column, stopping: Column) -> Column:
    """idle, running, paused, stopped or completed; a stop wins over a pause."""
    none = lambda c: F.coalesce(c, F.lit(0.0)) == 0
    flag = lambda c: F.coalesce(c, F.lit(False))
    return F.when(none(started), "idle").when(~none(ended) & flag(stopping), "stopped").when(~none(ended), "completed").when(flag(paused) & ~flag(stopping), "paused").otherwise("running")


def controlled(jobs: DataFrame, commands: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs(job_id, started_at, ended_at, ...) after commands(seq, job_id, action), action being pause, resume or stop: with paused, stopping and status; and the ids that no job has. Of pause and resume the last counts, a stop stays."""
    last = commands.groupBy(F.col("job_id").alias("__id")).agg(
        F.max_by(F.col("action") == "pause", F.when(F.col("action").isin("pause", "resume"), F.col("seq"))).alias("paused"), F.bool_or(F.col("action") == "stop").alias("stopping")
    )
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in ("paused", "stopping")]
    kept = [c for c in jobs.columns if c not in ("paused", "stopping", "status")]
    rows = jobs.select(*kept).join(last, F.col("job_id") == F.col("__id"), "left").select(*kept, *flags)
    rows = rows.withColumn("status", status_label(F.col("started_at"), F.col("ended_at"), F.col("paused"), F.col("stopping")))
    return rows, commands.join(jobs.select(F.col("job_id").alias("__id")), F.col("job_id") == F.col("__id"), "left_anti").select("job_id").distinct()


def archived(archives: DataFrame, rows: DataFrame, reason: str) -> DataFrame:
    """archives with rows(job_id, status, ...) added as their newest entries; a deletion's status is `deleted`, whatever the job's."""
    last = archives.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("__last"))
    new = rows.withColumn("status", F.lit("deleted") if reason == "deleted" else F.col("status")).withColumn("archive_reason", F.lit(reason))
    new = new.join(F.broadcast(last)).withColumn("seq", F.col("__last") + 1).drop("__last")
    return archives.unionByName(new.select(*[c for c in archives.columns if c in new.columns]), allowMissingColumns=True)


def status_tone(label: Column) -> Column:
    s = F.lower(F.coalesce(label, F.lit("")))
    return F.when(F.contains(s, F.lit("critical")), "critical").when(F.contains(s, F.lit("pressure")) | (s == "paused"), "warn").when(s.isin("running", "healthy"), "ok").otherwise("idle")


@dataclass
class Survivors:
    """What a purge leaves, and one row that counts what went."""

    index: DataFrame
    metadata: DataFrame
    visited: DataFrame
    removed: DataFrame


def purge(index: DataFrame, metadata: DataFrame, visited: DataFrame, origin: str) -> Survivors:
    """All that stems from one origin goes: postings, page metadata, and the visited entries of those pages."""
    kept_index, counts = purge_origin(index, origin)
    gone = F.coalesce("origin", F.lit("")) == origin
    victims = metadata.where(gone).select(url_hash(F.col("url")).alias("__h")).distinct()
    kept_visited = visited.join(victims, F.col("url_hash") == F.col("__h"), "left_anti")
    removed = counts.drop("postings_left").join(metadata.agg(F.count_if(gone).alias("metadata_removed"))).join(visited.join(victims, F.col("url_hash") == F.col("__h"), "left_semi").agg(F.count(F.lit(1)).alias("visited_removed")))
    return Survivors(kept_index, metadata.where(~gone), kept_visited, removed)


def delete_job(job_id: str, jobs: DataFrame, archives: DataFrame, logs: DataFrame, index: DataFrame, metadata: DataFrame, visited: DataFrame) -> dict[str, DataFrame | bool]:
    """A job's deletion: its logs and row go, and all that stems from its seed is purged. `known` says whether the job is live (a column `live` of jobs, true if there is none); only then is it archived, as deleted. A row that is not live, left by an earlier run, is purged all the same; an id without a row changes nothing."""
    mine = jobs.where(F.col("job_id") == job_id)
    row = mine.first()
    if row is None:
        nothing = purge(index.limit(0), metadata.limit(0), visited.limit(0), "").removed
        return {"known": False, "jobs": jobs, "archives": archives, "logs": logs.where(F.col("job_id") != job_id), "index": index, "metadata": metadata, "visited": visited, "removed": nothing}
    known = bool(row.asDict().get("live", True))
    left = purge(index, metadata, visited, row["seed_url"])
    return {"known": known, "jobs": jobs.where(F.col("job_id") != job_id), "archives": archived(archives, mine, "deleted") if known else archives, "logs": logs.where(F.col("job_id") != job_id), "index": left.index, "metadata": left.metadata, "visited": left.visited, "removed": left.removed}
