"""Crawling as graph operators: frontier, visited set with expiry, breadth-first levels under a budget."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.functions import html as H
from webloom.functions.urls import is_valid_url, normalize_url, url_hash
from webloom.tables import cut, numbered

TTL_SECONDS = 3600
CAPACITY = 10_000
PRESSURE = 0.8
#: What a crawl may ask for: least and most of each (fixed values); its defaults.
LIMITS = {"max_depth": (0, 32), "hit_rate": (0.1, 100.0), "max_capacity": (1, 10_000_000), "max_urls": (1, 10_000_000)}
DEFAULTS = {"max_depth": 3, "hit_rate": 2.0, "max_capacity": CAPACITY, "max_urls": 1000}


def checked(request: dict) -> dict:
    """A crawl's parameters, defaults filled in; ValueError where one is outside the limits that the service accepts."""
    out = DEFAULTS | {k: v for k, v in request.items() if k in DEFAULTS and v is not None}
    for k, (low, high) in LIMITS.items():
        if not (0 < out[k] <= high if k == "hit_rate" else low <= out[k] <= high):
            raise ValueError(f"{k} must be {low} to {high}")
    return out


def clamped(c: Column, name: str) -> Column:
    """A parameter as a worker takes it: never below the least."""
    return F.greatest(c, F.lit(LIMITS[name][0]))


def _entries(pushes: DataFrame) -> DataFrame:
    """The first push of each url that is not empty and has a depth that is not negative."""
    good = pushes.where("url <> '' and depth >= 0").withColumn("url_hash", url_hash(F.col("url")))
    return good.groupBy("url_hash").agg(F.min_by(F.struct("seq", "url", "depth"), "seq").alias("p")).select("p.*")


def frontier(pushes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """pushes(seq, url, depth) to a bounded queue that nothing leaves: the first of each url enters, and at capacity the oldest goes. What is pending, in order."""
    return _entries(pushes).orderBy(F.col("seq").desc()).limit(max(1, capacity)).orderBy("seq")


def frontier_counts(pushes: DataFrame, capacity: int = CAPACITY, job_id: str = "") -> DataFrame:
    """The snapshot of the same queue: job_id, pending, capacity, enqueued, dropped, popped, status, seen."""
    n = F.lit(max(1, capacity)).cast("long")
    good = pushes.where("url <> '' and depth >= 0").select(url_hash(F.col("url")).alias("h")).agg(F.countDistinct("h").alias("enqueued"))
    rows = good.select(F.lit(job_id).alias("job_id"), F.least("enqueued", n).alias("pending"), n.alias("capacity"), "enqueued", (F.col("enqueued") - F.least("enqueued", n)).alias("dropped"), F.lit(0).cast("long").alias("popped"))
    return rows.withColumn("status", queue_status(F.col("pending"), F.col("capacity"))).withColumn("seen", F.col("enqueued"))


def queue_status(pending: Column, capacity: Column) -> Column:
    return F.when(pending >= capacity, "Critical (Queue Full)").when(pending >= PRESSURE * capacity, "Back-pressure Active").otherwise("Healthy")


def ttl_accept(visits: DataFrame, key: str, at: str, ttl: int = TTL_SECONDS) -> DataFrame:
    """Visits that are let through: one visit marks its key for ttl seconds, and those that fall strictly inside are skipped without prolonging it. One row for each accepted visit. `at` is a number of seconds; visits without one are left out.

    Each visit depends on the one accepted before, so a key's visits pass one task in order, but as a sorted stream: a task holds a batch and one
    time, whatever the number of a key's visits, and jumps from one accepted visit to the next.
    """
    kind = visits.schema[key].dataType.simpleString()
    rows = visits.select(key, F.col(at).cast("double").alias(at)).where(F.col(at).isNotNull()).repartition(key).sortWithinPartitions(key, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, until = pa.scalar(None), -np.inf
        begun = False
        for b in batches:
            if not b.num_rows:
                continue
            code = pc.fill_null(b.column(0).dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
            times = b.column(1).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(code[1:] != code[:-1]) + 1).tolist(), len(code)]
            kept: list[int] = []
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                if not (begun and i == 0 and b.column(0)[0].as_py() == last.as_py()):
                    until = -np.inf
                while (i := i + int(np.searchsorted(times[i:j], until))) < j:
                    kept.append(i)
                    until = times[i] + ttl
            begun, last = True, b.column(0)[b.num_rows - 1]
            yield b.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, f"{key} {kind}, {at} double")


def live(visited: DataFrame, now: Column) -> DataFrame:
    """Entries of visited(url_hash, expiry) that still suppress a fetch."""
    return visited.where(F.col("expiry") > now)


def unvisited(candidates: DataFrame, visited: DataFrame, now: Column) -> DataFrame:
    """candidates(url, ...) whose hash has no live entry."""
    kept = live(visited, now).select(F.col("url_hash").alias("__seen"))
    return candidates.join(kept, url_hash(F.col("url")) == F.col("__seen"), "left_anti")


def children(links: DataFrame) -> DataFrame:
    """links(url, ...) as they enter the frontier: canonical and valid, each once with its other columns."""
    u = normalize_url(F.col("url"))
    return links.where(is_valid_url(F.col("url"))).withColumn("url", u).where("url is not null").distinct()


def fetched(pages: DataFrame, frontier: DataFrame) -> DataFrame:
    """frontier(url, ...) with the html of the pages(url, html) that are stored; an url that is not stored is a failed fetch and gives no row."""
    return frontier.join(pages.select(F.col("url").alias("__url"), "html"), F.col("url") == F.col("__url")).drop("__url")


def readable(responses: DataFrame, most_bytes: int = 2 << 20) -> DataFrame:
    """What a fetch makes of responses(url, final_url, content_type, body binary): pages(url, final_url, html) of those whose type names html or xml, their first most_bytes bytes read as UTF-8 with replacement characters."""
    kind = F.lower(F.coalesce("content_type", F.lit("")))
    good = responses.where(F.contains(kind, F.lit("html")) | F.contains(kind, F.lit("xml")))
    return good.select("url", F.coalesce("final_url", "url").alias("final_url"), F.decode(F.substring("body", 1, most_bytes), "UTF-8").alias("html"))


def bfs(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, max_nodes: int | None = None) -> DataFrame:
    """node and depth of all that is reached from seeds(node) over edges(src, dst) in at most max_depth steps. With max_nodes, levels stop once that many are reached; of the last level those come first whose first parent came first, then by node."""
    if max_depth < 0 or max_nodes is not None and max_nodes < 1:
        raise ValueError("max_depth must not be negative, max_nodes must be 1 or more")
    level = cut(numbered(seeds.select("node").distinct(), [F.col("node")], "place").withColumn("depth", F.lit(0)))
    seen, count = level, level.count()
    for depth in range(1, max_depth + 1):
        if max_nodes is not None and count >= max_nodes:
            break
        found = level.join(edges, level["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min("place").alias("parent"))
        found = found.join(seen.select(F.col("node").alias("old")), F.col("node") == F.col("old"), "left_anti")
        level = cut(numbered(found, [F.col("parent"), F.col("node")], "place").select("node", "place", F.lit(depth).alias("depth")))
        n = level.count()
        if not n:
            break
        seen, count = seen.unionByName(level), count + n
    if max_nodes is not None:
        seen = seen.orderBy("depth", "place").limit(max_nodes)
    return seen.select("node", "depth")


@dataclass
class Crawl:
    """pages: url, depth, place (order of fetching), origin_url, title, text, snippet. visited: url_hash and expiry of what was fetched. counts: crawled, skipped (live visits), failed (urls not stored), dropped (by the capacity or the budget)."""

    pages: DataFrame
    visited: DataFrame
    counts: dict[str, int]


def crawl(pages: DataFrame | Callable[[DataFrame], DataFrame], seed: str, max_depth: int = 3, max_urls: int = 1000, capacity: int = CAPACITY, visited: DataFrame | None = None, now: float = 0.0, ttl: int = TTL_SECONDS) -> Crawl:
    """A breadth-first crawl of the pages(url, html) that are stored, from a seed over their links. pages is a table, or a function that gives the pages stored for a table of canonical urls(url), where a whole table is dear to make.

    Level by level, in the order of the first parent and then the url: live visits (of visited(url_hash, expiry), at `now`) are skipped, urls that are not stored fail,
    and only pages that are read count for max_urls. Of a level that is longer than the capacity the oldest entries go. What was seen once never enters again.
    Only pages that are read are parsed.
    """
    checked({"max_depth": max_depth, "max_urls": max_urls, "max_capacity": capacity})
    spark: SparkSession = pages.sparkSession if isinstance(pages, DataFrame) else SparkSession.active()
    origin = normalize_url(F.lit(seed))
    if isinstance(pages, DataFrame):
        stored = cut(pages.select(normalize_url(F.col("url")).alias("url"), "html").where("url is not null"))
        fetch = lambda urls: fetched(stored, urls)
    else:
        fetch = pages
    level = cut(spark.range(1).where(is_valid_url(F.lit(seed))).select(origin.alias("url"), F.lit(0).cast("long").alias("place")))
    seen, taken, counts = level.select("url"), None, {"crawled": 0, "skipped": 0, "failed": 0, "dropped": 0}
    for depth in range(max_depth + 1):
        n = level.count()
        if not n:
            break
        if n > capacity:
            level, n, counts["dropped"] = cut(level.orderBy(F.col("place").desc()).limit(capacity)), capacity, counts["dropped"] + n - capacity
        fresh = level if visited is None else cut(unvisited(level, visited, F.lit(now)))
        n_fresh = n if visited is None else fresh.count()
        counts["skipped"] += n - n_fresh
        got = fetch(fresh.select("url")).select(F.col("url").alias("__url"), "html").dropDuplicates(["__url"])
        read = cut(fresh.join(got, F.col("url") == F.col("__url")).drop("__url").withColumn("depth", F.lit(depth)))
        n_read, left = read.count(), max_urls - counts["crawled"]
        counts["failed"] += n_fresh - n_read
        if n_read > left:
            read, n_read, counts["dropped"] = cut(read.orderBy("place").limit(left)), left, counts["dropped"] + n_read - left
        counts["crawled"] += n_read
        read = cut(H.parsed(read).drop("html"))
        taken = read if taken is None else taken.unionByName(read)
        if depth == max_depth or counts["crawled"] >= max_urls:
            break
        found = children(read.select(F.col("place").alias("parent"), F.explode("links").alias("url"))).groupBy("url").agg(F.min("parent").alias("parent"))
        found = found.join(seen.select(F.col("url").alias("__old")), F.col("url") == F.col("__old"), "left_anti")
        level = cut(numbered(found, [F.col("parent"), F.col("url")], "place").select("url", "place"))
        seen = seen.unionByName(level.select("url"))
    if taken is None:
        taken = H.parsed(level.limit(0).withColumns({"depth": F.lit(0), "html": F.lit("")}))
    rows = taken.select("url", "depth", "place", origin.alias("origin_url"), "title", "text", "snippet")
    return Crawl(rows, taken.select(url_hash(F.col("url")).alias("url_hash"), F.lit(now + ttl).alias("expiry")), counts)


def ring(rows: DataFrame, key: str, order: list[str], size: int) -> DataFrame:
    """The newest `size` rows of each key; the limit is applied in each task before rows move."""
    newest = Window.partitionBy(key).orderBy(*[F.col(c).desc() for c in order])
    return rows.withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= size).drop("__n")
