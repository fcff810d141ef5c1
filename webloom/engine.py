"""A running engine over one folder: its state tables, its index, its streams, from boot to shutdown."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from webloom import tables
from webloom.functions.urls import is_valid_url, normalize_url
from webloom.operators import crawl, index, search, state
from webloom.sources import flatfile
from webloom.streaming import ingest

_fields = lambda text: T._parse_datatype_string(text)
#: State tables and their columns.
SCHEMAS = {
    "jobs": "job_id string, seed_url string, status string, started_at double, ended_at double, paused boolean, stopping boolean, crawled long, errors long, pending long, dropped long, max_depth int, hit_rate double, max_capacity int, max_urls int",
    "job_history": "seq long, job_id string, seed_url string, status string, archive_reason string, started_at double, ended_at double, crawled long",
    "job_logs": "job_id string, ts double, seq long, level string, msg string",
    "metadata": "url string, title string, snippet string, depth int, origin string, ts double",
    "visited_urls": "url_hash string, expiry double",
}


class Engine:
    """Tables are written as versions, so that a reader sees one whole version, whatever is written meanwhile; each counts its own writes. `writes` is the number of changes since the last shutdown's export: without any, nothing is exported again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.writes = spark, folder.rstrip("/"), 0
        self.streams: dict[str, tuple[Callable[[], StreamingQuery], StreamingQuery | None]] = {}

    # --- state tables ---

    def get(self, name: str) -> DataFrame:
        return tables.latest(self.spark, f"{self.folder}/state/{name}", _fields(SCHEMAS[name]))

    def put(self, name: str, rows: DataFrame) -> int:
        """The table as of now; the number of its version."""
        self.writes += 1
        whole = self.spark.createDataFrame([], _fields(SCHEMAS[name])).unionByName(rows, allowMissingColumns=True)
        return tables.publish(whole.select(*_fields(SCHEMAS[name]).names), f"{self.folder}/state/{name}")

    def update(self, name: str, change: Callable[[DataFrame], DataFrame]) -> int:
        return self.put(name, change(self.get(name)))

    def reset_state(self) -> None:
        """Every table empty."""
        for name in SCHEMAS:
            self.put(name, self.get(name).limit(0))

    def clear_all(self) -> None:
        """Every table gone, with its files."""
        tables.drop(self.spark, f"{self.folder}/state")

    # --- the index ---

    @property
    def index_path(self) -> str:
        return f"{self.folder}/index"

    def index(self) -> DataFrame:
        known = tables.committed(self.spark, self.index_path, "version=")
        return index.stored(self.spark, known[-1][1]) if known else self.spark.createDataFrame([], index.SCHEMA + ", shard string")

    def put_index(self, postings: DataFrame) -> None:
        """The index as of now, stored by shard and word."""
        self.writes += 1
        known = tables.committed(self.spark, self.index_path, "version=")
        index.store(postings.select(*_fields(index.SCHEMA).names), f"{self.index_path}/version={known[-1][0] + 1 if known else 0}")
        for _, old in known[:-1]:
            tables.drop(self.spark, old)

    def add(self, corpus: DataFrame) -> None:
        """Postings of a corpus added to the index."""
        self.put_index(index.merge(self.index().drop("shard"), index.postings(corpus)))

    def clear_index(self) -> None:
        self.put_index(index.clear(self.index()))

    def answer(self, query: str | None, limit: int = 10, offset: int = 0) -> dict:
        return search.answer(self.index(), self.get("metadata"), query, limit, offset)

    def metrics(self) -> DataFrame:
        return state.global_metrics(self.get("jobs"), self.get("job_history"), self.get("visited_urls"), self.get("metadata"), self.index())

    # --- jobs ---

    def create_job(self, seed_url: str, now: float, **request) -> str:
        """A new job, running from now on; its id. ValueError for a seed that may not be fetched or a parameter outside its limits."""
        asked = crawl.checked(request)
        ok = self.spark.range(1).select(F.when(is_valid_url(F.lit(seed_url)), normalize_url(F.lit(seed_url))).alias("u")).first()["u"]
        if ok is None:
            raise ValueError(f"invalid seed_url: {seed_url}")
        job_id = uuid.uuid4().hex[:12]
        row = self.spark.createDataFrame([(job_id, ok, "running", float(now), False, False, 0, 0, 0, 0, asked["max_depth"], float(asked["hit_rate"]), asked["max_capacity"], asked["max_urls"])], "job_id string, seed_url string, status string, started_at double, paused boolean, stopping boolean, crawled long, errors long, pending long, dropped long, max_depth int, hit_rate double, max_capacity int, max_urls int")
        self.update("jobs", lambda jobs: jobs.unionByName(row, allowMissingColumns=True))
        return job_id

    def control(self, job_id: str, action: str) -> str:
        """pause, resume or stop; the job's status after it. KeyError for an id that no job has."""
        if action not in ("pause", "resume", "stop"):
            raise ValueError(action)
        before = self.get("jobs").where(F.col("job_id") == job_id).first()
        if before is None:
            raise KeyError(job_id)
        told = [(1, job_id, "stop")] * bool(before["stopping"]) + [(2, job_id, "pause")] * bool(before["paused"]) + [(3, job_id, action)]
        others = self.get("jobs").where(F.col("job_id") != job_id)
        rows, _ = state.controlled(self.get("jobs").where(F.col("job_id") == job_id), self.spark.createDataFrame(told, "seq int, job_id string, action string"))
        self.put("jobs", others.unionByName(rows, allowMissingColumns=True))
        return self.get("jobs").where(F.col("job_id") == job_id).first()["status"]

    def finish(self, job_id: str, now: float) -> None:
        """A job's end: completed or stopped, and archived as such."""
        ended = F.when(F.col("job_id") == job_id, F.lit(float(now))).otherwise(F.col("ended_at"))
        label = state.status_label(F.col("started_at"), F.col("ended_at"), F.col("paused"), F.col("stopping"))
        self.update("jobs", lambda jobs: jobs.withColumn("ended_at", ended).withColumn("status", F.when(F.col("job_id") == job_id, label).otherwise(F.col("status"))))
        mine = self.get("jobs").where(F.col("job_id") == job_id)
        self.update("job_history", lambda past: state.archived(past, mine, "finished"))

    def delete(self, job_id: str) -> tuple[bool, dict]:
        """Whether the job was known, and what went with it."""
        left = state.delete_job(job_id, self.get("jobs"), self.get("job_history"), self.get("job_logs"), self.index().drop("shard"), self.get("metadata"), self.get("visited_urls"))
        counts = left["removed"].first().asDict()
        for name, key in (("metadata", "metadata"), ("visited_urls", "visited"), ("job_history", "archives"), ("job_logs", "logs"), ("jobs", "jobs")):
            self.put(name, left[key])
        self.put_index(left["index"])
        return left["known"], counts

    # --- streams ---

    def start(self, name: str, corpus: DataFrame, every: str | None = None) -> StreamingQuery:
        """Indexing of a stream, kept by name so that it can be paused and resumed."""
        begin = lambda: ingest.index_stream(corpus, f"{self.folder}/batches/{name}", f"{self.folder}/checkpoints/{name}", every)
        query = begin()
        self.streams[name] = (begin, query)
        return query

    def pause(self, name: str) -> None:
        """Stops a stream at a batch; what it has done is in its checkpoint."""
        begin, query = self.streams[name]
        if query is not None:
            query.stop()
        self.streams[name] = (begin, None)

    def resume(self, name: str) -> StreamingQuery:
        """Goes on from the checkpoint."""
        begin, query = self.streams[name]
        if query is None:
            query = begin()
            self.streams[name] = (begin, query)
        return query

    def stop_streams(self) -> None:
        for name in list(self.streams):
            self.pause(name)

    # --- life ---

    def boot(self) -> None:
        """The index and state of the last shutdown, if there was one."""
        if tables.children(self.spark, f"{self.folder}/shards"):
            self.put_index(flatfile.import_postings(self.spark, f"{self.folder}/shards"))
        for name, rows in flatfile.load_snapshot(self.spark, f"{self.folder}/snapshot", {n: _fields(s) for n, s in SCHEMAS.items()}).items():
            self.put(name, rows)
        self.writes = 0

    def shutdown(self) -> bool:
        """Streams stop; index and state are exported, if anything was written since the last time; whether it was."""
        self.stop_streams()
        if not self.writes:
            return False
        flatfile.export_postings(self.index(), f"{self.folder}/shards")
        flatfile.save_snapshot({n: self.get(n) for n in SCHEMAS}, f"{self.folder}/snapshot")
        self.writes = 0
        return True

    def reset(self) -> None:
        """All gone: gates close so that no late batch is written, streams stop, index, state and shards are dropped, gates open."""
        paths = [f"{self.folder}/batches/{name}" for name in self.streams]
        for p in paths:
            ingest.close_gate(self.spark, p)
        self.stop_streams()
        for part in ("index", "state", "shards", "snapshot", "checkpoints"):
            tables.drop(self.spark, f"{self.folder}/{part}")
        for p in paths:
            tables.drop(self.spark, p)
        self.streams.clear()
        self.writes = 0
