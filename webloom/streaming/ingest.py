"""Incremental indexing and stateful crawl operators with Structured Streaming."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from webloom import tables
from webloom.operators.crawl import PRESSURE
from webloom.operators.index import SCHEMA, first_origin, postings, store

GATE = "_closed"


def close_gate(spark: SparkSession, path: str) -> None:
    """From now on no batch is written to an index."""
    tables.mark(spark, f"{path}/{GATE}")


def open_gate(spark: SparkSession, path: str) -> None:
    tables.drop(spark, f"{path}/{GATE}")


def index_stream(corpus: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Postings of each micro-batch of corpus(url, text, origin_url, depth) as one folder, batch=N. A batch that is replayed is left as it was committed, so nothing is counted twice and nobody's reading is disturbed; a batch counts only when its writer has finished. Nothing is written behind a closed gate. A source's maxFilesPerTrigger and `every` (every 5 seconds, say) set the pace."""

    def write(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        if n in {k for k, _ in tables.committed(spark, path, "batch=")} or tables.exists(spark, f"{path}/{GATE}"):
            return
        tables.write(postings(batch), f"{path}/batch={n}")

    writer = corpus.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The index that the batches committed so far add up to; the first origin is that of the earliest batch. Batches that are committed later play no part in it."""
    known = tables.committed(spark, path, "batch=")
    if not known:
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA + ", batch long").option("basePath", path).parquet(*[p for _, p in known])
    return rows.groupBy("word", "url").agg(first_origin(F.struct("batch", "origin_url")).alias("origin_url"), F.min("depth").alias("depth"), F.sum("term_frequency").alias("term_frequency"))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """The batches as one stored index, by shard and sorted by word."""
    store(read_index(spark, path), target)


def _with_state(spark: SparkSession) -> None:
    """Keyed maps and lists of any size need the store that keeps them on disk."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Expiry(StatefulProcessor):
    """Until when a key is marked; gone when event time has passed it."""

    def __init__(self, key: str, at: str, ttl: int):
        self.key, self.at, self.ttl = key, at, ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.until = handle, handle.getValueState("until", "until double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        until = self.until.get()[0] if self.until.exists() else float("-inf")
        before, kept = until, []
        for t in sorted(t for r in rows for t in r[self.at].astype(float)):
            if until <= t:
                kept.append(t)
                until = t + self.ttl
        if until != before:
            self.until.update((until,))
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old)
            self.handle.registerTimer(int(until * 1000))
        if kept:
            yield pd.DataFrame({self.key: [key[0]] * len(kept), self.at: kept})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.until.clear()
        return iter(())

    def close(self) -> None:
        pass


def ttl_stream(visits: DataFrame, key: str, at: str, ttl: int = 3600, late: str = "1 hour") -> DataFrame:
    """Accepted visits of a stream (key, at in seconds): state holds each key's expiry. Both accepting and forgetting go by the visits' own time, so a replay accepts the same; visits later than `late` behind the newest are left out."""
    _with_state(visits.sparkSession)
    kind = visits.schema[key].dataType.simpleString()
    timed = visits.withColumn("__time", F.timestamp_seconds(F.col(at))).withWatermark("__time", late)
    return timed.groupBy(key).transformWithStateInPandas(statefulProcessor=_Expiry(key, at, ttl), outputStructType=f"{key} {kind}, {at} double", outputMode="Append", timeMode="EventTime")


class _Queue(StatefulProcessor):
    """A bounded queue: entries by their number, the hashes of all urls that ever entered, and five counts."""

    def __init__(self, capacity: int):
        self.capacity = capacity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "number long", "url string, depth long")
        self.seen = handle.getMapState("seen", "hash string", "one int")
        self.counts = handle.getValueState("counts", "head long, tail long, popped long, dropped long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        head, tail, popped, dropped, seen = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0)
        cleared = 0
        for r in pd.concat(list(rows)).sort_values("seq").itertuples():  # of one batch
            if r.op == "push" and r.url and r.depth >= 0:
                name = (hashlib.sha256(r.url.encode()).hexdigest(),)
                if self.seen.containsKey(name):
                    continue
                self.seen.updateValue(name, (1,))
                seen += 1
                if tail - head >= self.capacity:
                    self.entries.removeKey((head,))
                    head, dropped = head + 1, dropped + 1
                self.entries.updateValue((tail,), (r.url, int(r.depth)))
                tail += 1
            elif r.op == "pop" and tail > head:
                self.entries.removeKey((head,))
                head, popped = head + 1, popped + 1
            elif r.op == "clear":
                cleared += tail - head
                self.entries.clear()
                head = tail
        self.counts.update((head, tail, popped, dropped, seen))
        pending = tail - head
        status = "Critical (Queue Full)" if pending >= self.capacity else "Back-pressure Active" if pending >= PRESSURE * self.capacity else "Healthy"
        first = self.entries.getValue((head,))[0] if pending else None
        yield pd.DataFrame({"job_id": [key[0]], "pending": [pending], "capacity": [self.capacity], "enqueued": [seen], "popped": [popped], "dropped": [dropped], "status": [status], "seen": [seen], "cleared": [cleared], "head": [first]})

    def close(self) -> None:
        pass


def queue_stream(events: DataFrame, capacity: int) -> DataFrame:
    """A bounded queue for each job over events(job_id, seq, op, url, depth), op being push, pop or clear: pushes of urls already seen are rejected, a full queue loses its oldest, pops take the oldest. After each batch: job_id, pending, capacity, enqueued, popped, dropped, status, seen, cleared (entries that this batch cleared), head. Entries and hashes are map states: an operation reads and writes its own entry, however long the queue is."""
    _with_state(events.sparkSession)
    out = "job_id long, pending long, capacity long, enqueued long, popped long, dropped long, status string, seen long, cleared long, head string"
    return events.groupBy("job_id").transformWithStateInPandas(statefulProcessor=_Queue(max(1, capacity)), outputStructType=out, outputMode="Update", timeMode="None")


__all__ = ["close_gate", "compact", "index_stream", "open_gate", "queue_stream", "read_index", "ttl_stream"]
