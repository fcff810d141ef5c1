import pytest
from pyspark.sql import functions as F

from webloom import catalog
from webloom.operators import crawl, index, search, state
from webloom.sources import flatfile
from webloom.streaming import ingest

POST = "word string, url string, origin_url string, depth int, term_frequency long"


def seeded(spark, rows):
    """Rows (word, url, depth, origin), each one insert."""
    corpus = spark.createDataFrame([(w, u, d, o) for w, u, d, o in rows], "text string, url string, depth int, origin_url string")
    return index.postings(corpus)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_insert_adds_up_and_keeps_least_depth(spark):
    assert rows(seeded(spark, [("a", "u", 5, ""), ("a", "u", 2, "o"), ("a", "u", 7, "o")])) == [("a", "u", "o", 2, 3)]


def test_empty_words_and_urls_are_rejected(spark):
    assert rows(seeded(spark, [("", "u", 0, "o"), ("a", "", 0, "o"), (None, "u", 0, "o")])) == []


def test_prefix_and_exact(spark):
    post = seeded(spark, [("foo", "u", 3, "o"), ("food", "u", 1, "o"), ("istanbul", "v", 0, "o")])
    assert rows(index.prefix(post, "fo")) == [("u", 2, 1, "o")]
    assert index.exact(post, "ist").count() == 0 and index.exact(post, " İstanbul ").count() == 1
    assert index.lookup(post, "fo", exact_only=True, prefix_too=True).count() == 0
    assert rows(index.contains(post, spark.createDataFrame([("foo",), ("zip",)], "word string"))) == [("foo", True), ("zip", False)]
    assert rows(index.starts_with(post, spark.createDataFrame([("fo",), ("x",), ("",)], "prefix string"))) == [("", False), ("fo", True), ("x", False)]
    assert index.vocabulary_size(post).first()[0] == 3 and index.node_count(post).first()[0] == 1 + 4 + 8


def test_merge_is_additive_and_upsert_is_not(spark):
    a, b = seeded(spark, [("a", "u", 2, "")]), seeded(spark, [("a", "u", 1, "o"), ("a", "u", 3, "o")])
    assert rows(index.merge(a, b)) == [("a", "u", "o", 1, 3)]
    given = spark.createDataFrame([(" A ", "u", "x", 9, 5, 1), ("a", "u", "y", None, None, 2), ("a", "", "y", 1, 1, 3)], POST + ", seq int")
    assert rows(index.bulk_upsert(given)) == [("a", "u", "y", 0, 1)]


def test_purge(spark):
    post = seeded(spark, [("only", "d1", 0, "doomed"), ("shared", "d2", 0, "doomed"), ("shared", "k", 0, "keeper")])
    left, removed = index.purge_origin(post, "doomed")
    assert tuple(removed.first()) == (2, 1, 1) and left.count() == 1


def test_purge_everything_linked_to_an_origin(spark):
    meta = spark.createDataFrame([("http://d/1", "doomed"), ("http://d/2", "doomed"), ("http://k/", "keeper")], "url string, origin string")
    from webloom.functions.urls import url_hash

    visited = meta.select(url_hash(F.col("url")).alias("url_hash"))
    done = state.purge(seeded(spark, [("w", "http://d/1", 0, "doomed")]), meta, visited, "doomed")
    assert tuple(done.removed.first()) == (1, 1, 2, 2) and done.visited.count() == 1 and done.metadata.count() == 1


def test_scores():
    assert [search.PER_HIT * 3 + search.BASE - search.PER_LEVEL * 2, search.BASE] == [1020, 1000]
    assert (search.clamp("x", 10), search.clamp(-4, 10), search.clamp("7", 1)) == (10, 0, 7)


def test_search_pages_are_disjoint_and_ranked(spark):
    post = seeded(spark, [("word", f"http://e/{d}", d, "o") for d in range(5)])
    meta = spark.createDataFrame([("http://e/0", "T", "S")], "url string, title string, snippet string")
    first, second = search.search(post, meta, " Word word ", 2, 0), search.search(post, meta, "word", 2, 2)
    assert [(r.url, r.frequency, r.relevance_score, r.title) for r in first.rows.collect()] == [("http://e/0", 2, 1020, "T"), ("http://e/1", 2, 1015, "")]
    assert [r.url for r in second.rows.collect()] == ["http://e/2", "http://e/3"] and first.total.first()[0] == 5
    assert search.page(post, "word", 0).count() == 0 and search.page(post, "").count() == 0
    with pytest.raises(ValueError):
        search.search(post, meta, "word", 999)


def test_limit_is_a_top_k_and_the_word_filter_reaches_the_scan(spark, tmp_path):
    seeded(spark, [("a", "u", 0, "o")]).write.parquet(str(tmp_path / "p"))
    post = spark.read.parquet(str(tmp_path / "p"))
    plan = search.page(post, "a")._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "BroadcastHashJoin" in plan
    assert "EqualTo(word,a)" in index.exact(post, "A")._jdf.queryExecution().executedPlan().toString()


def test_frontier(spark):
    push = spark.createDataFrame([(i, f"http://h/{i}", 0) for i in range(5)] + [(9, "http://h/4#x", 1), (10, "", 0), (11, "http://h/z", -1)], "seq int, url string, depth int")
    assert [r.url for r in crawl.frontier(push, 3).collect()] == ["http://h/2", "http://h/3", "http://h/4"]
    assert crawl.frontier_counts(push, 3, "j").first().asDict() == {"job_id": "j", "pending": 3, "capacity": 3, "enqueued": 5, "dropped": 2, "popped": 0, "status": "Critical (Queue Full)", "seen": 5}
    got = spark.createDataFrame([(0,), (8,), (10,)], "p int").select(crawl.queue_status(F.col("p"), F.lit(10))).collect()
    assert [r[0] for r in got] == ["Healthy", "Back-pressure Active", "Critical (Queue Full)"]


def test_ttl(spark):
    visits = spark.createDataFrame([("a", float(t)) for t in (0, 10, 3599, 3600, 5000, 7200)] + [("b", 1.0)], "k string, at double")
    assert rows(crawl.ttl_accept(visits, "k", "at")) == [("a", 0.0), ("a", 3600.0), ("a", 7200.0), ("b", 1.0)]


def test_ttl_against_one_visit_at_a_time(spark):
    """Many keys over many batches, null keys and times, ties, and a hot key."""
    import random

    rng = random.Random(1)
    visits = [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), rng.choice([None, rng.randrange(3000) / 2])) for _ in range(3000)]
    want, until = [], {}
    for k, t in sorted((x for x in visits if x[1] is not None), key=lambda x: (str(x[0]), x[1])):
        if until.get(k, float("-inf")) <= t:
            want.append((k, t))
            until[k] = t + 40
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        got = [tuple(r) for r in crawl.ttl_accept(spark.createDataFrame(visits, "k string, at double"), "k", "at", 40).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got, key=str) == sorted(want, key=str)


def test_numbered(spark):
    from webloom.tables import numbered

    df = spark.range(500).select((F.col("id") * 37 % 501).alias("x")).repartition(6)
    assert [(r.x, r.n) for r in numbered(df, [F.col("x").desc()], "n").orderBy("n").collect()] == [(x, i) for i, x in enumerate(sorted((i * 37 % 501 for i in range(500)), reverse=True))]


def test_stored_index_is_pruned_by_shard_and_word(spark, tmp_path):
    post = seeded(spark, [(w, f"http://h/{i}", i, "o") for i, w in enumerate(["apple", "ant", "bee", "ıbm", "9x", "bee"])])
    index.store(post, str(tmp_path / "i"))
    kept = index.stored(spark, str(tmp_path / "i"))
    plan = search.page(kept, "Bee IBM")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [shard" in plan and "In(word, [bee,ıbm])" in plan
    assert rows(search.page(kept, "Bee IBM").select("url")) == [("http://h/2",), ("http://h/3",), ("http://h/5",)]
    assert rows(index.prefix(kept, "a").select("url")) == [("http://h/0",), ("http://h/1",)]
    assert search.page(kept, "").count() == 0 and search.page(kept, "nothing").count() == 0
    assert rows(kept.drop("shard")) == rows(post)


def test_answer(spark):
    post = seeded(spark, [("word", f"http://e/{d}", d, "o") for d in range(5)])
    meta = spark.createDataFrame([("http://e/0", "T", "S")], "url string, title string, snippet string")
    got = search.answer(post, meta, " Word ", 2, 4)
    assert (got["query"], got["count"], got["total"], got["limit"], got["offset"]) == ("Word", 1, 5, 2, 4) and got["elapsed_ms"] >= 0
    assert search.answer(post, meta, "  ") == {"query": "", "results": [], "limit": 10, "offset": 0, "count": 0, "total": 0}
    with pytest.raises(ValueError):
        search.answer(post, meta, "", 101)


def test_unvisited(spark):
    from webloom.functions.urls import url_hash

    seen = spark.createDataFrame([("http://h/1", 10.0), ("http://h/2", 99.0)], "url string, expiry double").select(url_hash(F.col("url")).alias("url_hash"), "expiry")
    found = spark.createDataFrame([("http://h/1",), ("http://h/2",)], "url string")
    assert rows(crawl.unvisited(found, seen, F.lit(50.0))) == [("http://h/1",)]


def test_crawl_two_pages(spark):
    pages = spark.createDataFrame([("http://h/", '<p>python</p><a href="/c">x</a><a href="/gone">y</a>'), ("http://h/c", '<p>python too</p><a href="/">b</a>'), ("http://o/", "z")], "url string, html string")
    got = crawl.crawl(pages, "http://h", 2, now=100.0)
    assert rows(got.pages.select("url", "depth", "place")) == [("http://h/", 0, 0), ("http://h/c", 1, 0)]
    assert got.counts == {"crawled": 2, "skipped": 0, "failed": 1, "dropped": 0}
    assert {r.expiry for r in got.visited.collect()} == {3700.0}
    assert index.exact(index.postings(got.pages), "python").count() == 2
    again = crawl.crawl(pages, "http://h", 2, visited=got.visited, now=3699.0)
    assert again.pages.count() == 0 and again.counts["skipped"] == 1
    assert crawl.crawl(pages, "http://h", 2, visited=got.visited, now=3700.0).pages.count() == 2
    assert crawl.crawl(pages, "http://h", 2, 1).pages.count() == 1 and crawl.crawl(pages, "http://nowhere/").pages.count() == 0
    assert crawl.crawl(pages, "http://localhost/").pages.count() == 0
    with pytest.raises(ValueError):
        crawl.crawl(pages, "http://h", 99)


def test_crawl_order_budget_and_capacity(spark):
    """Children of the first parent come first; a level over the capacity loses its oldest; pages that are not stored don't count."""
    link = lambda *to: "".join(f"<a href='/{x}'>x</a>" for x in to)
    pages = spark.createDataFrame([("http://h/", link("b", "a", "gone")), ("http://h/a", link("z", "y")), ("http://h/b", link("c", "z")), ("http://h/c", ""), ("http://h/y", ""), ("http://h/z", "")], "url string, html string")
    order = lambda c: [r.url.removeprefix("http://h/") for r in c.pages.orderBy("depth", "place").collect()]
    assert order(crawl.crawl(pages, "http://h/", 2)) == ["", "a", "b", "y", "z", "c"]
    assert order(crawl.crawl(pages, "http://h/", 2, 4)) == ["", "a", "b", "y"]
    small = crawl.crawl(pages, "http://h/", 1, capacity=2)
    assert order(small) == ["", "b"] and small.counts == {"crawled": 2, "skipped": 0, "failed": 1, "dropped": 1}
    assert crawl.checked({"max_depth": 2, "hit_rate": None}) == {"max_depth": 2, "hit_rate": 2.0, "max_capacity": 10_000, "max_urls": 1000}
    for bad in ({"hit_rate": 0}, {"hit_rate": 101}, {"max_depth": -1}, {"max_urls": 0}):
        with pytest.raises(ValueError):
            crawl.checked(bad)


def test_crawl_asks_only_for_the_pages_it_comes_to(spark):
    web = {"http://h/": ["a", "b"], "http://h/a": ["b", "c", "gone"], "http://h/b": [], "http://h/c": ["d"], "http://h/d": [], "http://h/far": ["/"]}
    pages = spark.createDataFrame([(u, "".join(f'<a href="{x}">x</a>' for x in to)) for u, to in web.items()], "url string, html string")
    asked = []

    def fetch(urls):
        asked.append(sorted(r["url"] for r in urls.collect()))
        return crawl.fetched(pages, urls)

    got = crawl.crawl(fetch, "http://h/", 2)
    assert asked == [["http://h/"], ["http://h/a", "http://h/b"], ["http://h/c", "http://h/gone"]]
    whole = crawl.crawl(pages, "http://h/", 2)
    assert rows(got.pages) == rows(whole.pages) and got.pages.count() == 4
    assert got.counts == whole.counts == {"crawled": 4, "skipped": 0, "failed": 1, "dropped": 0}


def test_crawl_again_has_no_capacity(spark, tmp_path):
    spark.range(10_500).selectExpr("1L as l_suppkey", "id as l_partkey").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = catalog.QUERIES["crawl_again"](spark, str(tmp_path))
    assert rows(got.groupBy("depth").count()) == [(0, 1), (1, 5250)]


def test_links_of_pages_with_one_url_come_once(spark, tmp_path):
    html = '<a href="/a">x</a><a href="/b">y</a>'
    spark.createDataFrame([(1, "http://h/", html), (2, "http://h/", html + '<a href="/c">z</a>'), (3, "http://k/", html)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = rows(catalog.QUERIES["page_links"](spark, str(tmp_path)))
    assert got == [("http://h/", "http://h/a"), ("http://h/", "http://h/b"), ("http://h/", "http://h/c"), ("http://k/", "http://k/a"), ("http://k/", "http://k/b")]


def test_bfs_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "c")], "src string, dst string")
    assert rows(crawl.bfs(edges, spark.createDataFrame([("a",)], "node string"), 9)) == [("a", 0), ("b", 1), ("c", 2)]


def test_history_keeps_the_first_place(spark):
    a = spark.createDataFrame([(1, "x", "old"), (2, "y", "done"), (3, "x", "new"), (4, "z", "done")], "seq int, job_id string, status string")
    assert rows(state.history(a, 3)) == [(1, "x", "new"), (2, "y", "done"), (4, "z", "done")]
    assert rows(state.history(a, 2)) == [(2, "y", "done"), (4, "z", "done")]


def test_history_page_counts_every_job(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.range(1200).selectExpr("id as event_id", "id % 600 as user_id", "if(id < 600, 'view', 'click') as event_type").write.parquet(path)
    got = catalog.QUERIES["history_page"](spark, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in got) == [(i, str(i), "click", 600) for i in range(593, 600)]


def test_job_archive_counts_every_job(spark, tmp_path):
    path = f"{tmp_path}/events.parquet"
    spark.range(24_000).selectExpr("id as event_id", "id % 12000 as user_id", "if(id < 12000, 'view', 'click') as event_type").write.parquet(path)
    assert rows(catalog.QUERIES["job_archive_deleted"](spark, str(tmp_path))) == [("click", 6000), ("deleted", 6000)]


def test_delete_job(spark):
    jobs = spark.createDataFrame([("j1", "http://d/", "running"), ("j2", "http://k/", "running")], "job_id string, seed_url string, status string")
    archives = spark.createDataFrame([(1, "j2", "completed")], "seq int, job_id string, status string")
    logs = spark.createDataFrame([("j1", 1.0, 1, "i", "m")], "job_id string, ts double, seq int, level string, msg string")
    meta = spark.createDataFrame([("http://d/", "http://d/")], "url string, origin string")
    visited = spark.createDataFrame([], "url_hash string, expiry double")
    left = state.delete_job("j1", jobs, archives, logs, seeded(spark, [("w", "http://d/", 0, "http://d/")]), meta, visited)
    assert left["jobs"].count() == 1 and rows(left["archives"]) == [(1, "j2", "completed"), (2, "j1", "deleted")]
    assert left["logs"].count() == left["index"].count() == left["metadata"].count() == 0
    assert left["known"] and tuple(left["removed"].first()) == (1, 1, 1, 0)
    gone = state.delete_job("nobody", jobs, archives, logs, seeded(spark, [("w", "http://d/", 0, "http://d/")]), meta, visited)
    assert not gone["known"] and gone["index"].count() == 1 and tuple(gone["removed"].first()) == (0, 0, 0, 0)
    old = state.delete_job("j1", jobs.withColumn("live", F.lit(False)), archives, logs, seeded(spark, [("w", "http://d/", 0, "http://d/")]), meta, visited)
    assert not old["known"] and old["archives"].count() == 1 and old["index"].count() == 0


def test_status_labels_and_control(spark):
    jobs = spark.createDataFrame([("a", 1.0, None), ("b", 1.0, None), ("c", 0.0, None), ("d", 1.0, 2.0), ("e", 1.0, 2.0)], "job_id string, started_at double, ended_at double")
    told = spark.createDataFrame([(1, "a", "pause"), (2, "b", "pause"), (3, "b", "stop"), (4, "e", "stop"), (5, "z", "stop"), (6, "a", "resume"), (7, "a", "pause")], "seq int, job_id string, action string")
    left, unknown = state.controlled(jobs, told)
    assert {r.job_id: r.status for r in left.collect()} == {"a": "paused", "b": "running", "c": "idle", "d": "completed", "e": "stopped"}
    assert rows(unknown) == [("z",)]


def test_history_page(spark):
    past = spark.createDataFrame([(i, f"j{i}") for i in range(5)], "place int, job_id string")
    got, count = state.history_page(past, 2)
    assert [r.place for r in got.collect()] == [4, 3] and count.first()[0] == 5
    for bad in (0, 1001):
        with pytest.raises(ValueError):
            state.history_page(past, bad)


def test_flat_files(spark, tmp_path):
    post = seeded(spark, [("apple", "http://a\t/", 1, "o\\"), ("ıbm", "http://b/", 2, "")])
    path = str(tmp_path / "s")
    assert rows(flatfile.export_postings(post, path)) == [("_misc", 1), ("a", 1)]
    assert rows(flatfile.import_postings(spark, path)) == rows(post)
    assert rows(flatfile.export_postings(post.where("word = 'apple'"), path)) == [("_misc", 0), ("a", 1)]
    assert not list((tmp_path / "s").glob("shard=_misc"))
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.data").write_text("w\tu\to\t1\t2\nw\tu\to\t1\t3\nbad\nw\tv\to\tx\t1\n\tu\to\t1\t1\nw\tz\to\t1\t0\n")
    assert rows(flatfile.import_postings(spark, str(tmp_path / "t"))) == [("w", "u", "o", 1, 3)]


def test_snapshot(spark, tmp_path):
    jobs = spark.createDataFrame([("j", 1.5)], "job_id string, ts double")
    flatfile.save_snapshot({"jobs": jobs}, str(tmp_path))
    (tmp_path / "jobs" / "version=0" / "damaged.json").write_text("{not json\n")
    (tmp_path / "jobs" / "version=1").mkdir()  # not committed
    got = flatfile.load_snapshot(spark, str(tmp_path), {"jobs": jobs.schema, "missing": jobs.schema})
    assert rows(got["jobs"]) == [("j", 1.5)] and got["missing"].count() == 0


def test_stream_counts_a_replayed_batch_once(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    corpus = spark.createDataFrame([("http://h/", "a b a", "o", 1)], "url string, text string, origin_url string, depth int")
    corpus.write.parquet(str(src))
    for check in ("c1", "c2"):  # a lost checkpoint replays batch 0
        ingest.index_stream(spark.readStream.schema(corpus.schema).parquet(str(src)), out, str(tmp_path / check)).awaitTermination()
    assert rows(ingest.read_index(spark, out)) == rows(index.postings(corpus))
    (tmp_path / "out" / "batch=7").mkdir()  # a batch whose writer has not finished
    assert rows(ingest.read_index(spark, out)) == rows(index.postings(corpus))
    ingest.compact(spark, out, str(tmp_path / "done"))
    assert index.stored(spark, str(tmp_path / "done")).count() == 2
    ingest.close_gate(spark, str(tmp_path / "shut"))
    ingest.index_stream(spark.readStream.schema(corpus.schema).parquet(str(src)), str(tmp_path / "shut"), str(tmp_path / "c3")).awaitTermination()
    assert ingest.read_index(spark, str(tmp_path / "shut")).count() == 0


def test_first_origin_is_of_the_earliest_batch(spark, tmp_path):
    for n, origin in ((2, "z"), (10, "a")):
        index.postings(spark.createDataFrame([("http://h/", "w", origin, n)], "url string, text string, origin_url string, depth int")).write.parquet(str(tmp_path / f"batch={n}"))
    assert rows(ingest.read_index(spark, str(tmp_path))) == [("w", "http://h/", "z", 2, 2)]


def drained(spark, stream, mode, n, folder):
    """All rows of a query over a source that ends."""
    got = []
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = stream.writeStream.foreachBatch(lambda batch, _: got.extend(tuple(r) for r in batch.collect())).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
        q.awaitTermination(90)
        assert q.exception() is None
        assert len(got) == n
        return sorted(got)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stateful_ttl(spark, tmp_path):
    """By the visits' own time, from batch to batch; a key whose time has passed is forgotten and accepted anew."""
    source = spark.readStream.schema("k string, at double").option("maxFilesPerTrigger", 1)
    day, got = 86_400.0, []
    for n, visits in enumerate(([("a", 0), ("a", 10), ("a", 3600), ("b", 5)], [("a", 7199), ("a", 7200), ("b", 3000)], [("c", 90_000)], [("a", 90_001)])):
        spark.createDataFrame([(k, day + t) for k, t in visits], "k string, at double").coalesce(1).write.mode("append").parquet(str(tmp_path / "v"))
        want = {0: 3, 1: 1, 2: 1, 3: 1}[n]
        got += drained(spark, ingest.ttl_stream(source.parquet(str(tmp_path / "v")), "k", "at"), "append", want, tmp_path / "c")
    assert [(k, t - day) for k, t in got] == [("a", 0.0), ("a", 3600.0), ("b", 5.0), ("a", 7200.0), ("c", 90_000.0), ("a", 90_001.0)]


def test_stateful_queue(spark, tmp_path):
    ops = spark.createDataFrame([(1, i, "push", f"u{i}", 0) for i in range(5)] + [(1, 5, "push", "u0", 0), (1, 6, "pop", "", 0)], "job_id long, seq int, op string, url string, depth int")
    ops.write.parquet(str(tmp_path / "o"))
    stream = ingest.queue_stream(spark.readStream.schema(ops.schema).parquet(str(tmp_path / "o")), 3)
    assert drained(spark, stream, "update", 1, tmp_path / "c") == [(1, 2, 3, 5, 1, 2, "Healthy", 5, 0, "u3")]


def test_stateful_queue_clears_and_remembers(spark, tmp_path):
    """Two batches: what was seen in the first stays refused after a clear in the second."""
    source = spark.readStream.schema("job_id long, seq int, op string, url string, depth int").option("maxFilesPerTrigger", 1)
    for n, ops in enumerate(([(1, 0, "push", "a", 0), (1, 1, "push", "b", 0)], [(1, 2, "clear", "", 0), (1, 3, "push", "a", 0), (1, 4, "push", "c", 1), (1, 5, "pop", "", 0), (1, 6, "pop", "", 0)])):
        spark.createDataFrame(ops, "job_id long, seq int, op string, url string, depth int").coalesce(1).write.mode("append").parquet(str(tmp_path / "o"))
        stream = ingest.queue_stream(source.parquet(str(tmp_path / "o")), 3)
        got = drained(spark, stream, "update", 1, tmp_path / "c")
    assert got == [(1, 0, 3, 3, 1, 0, "Healthy", 3, 2, None)]


def test_status_tone(spark):
    got = spark.createDataFrame([("Critical (Queue Full)",), ("paused",), ("running",), (None,)], "s string").select(state.status_tone(F.col("s"))).collect()
    assert [r[0] for r in got] == ["critical", "warn", "ok", "idle"]
