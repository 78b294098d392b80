"""Streaming forms equal batch forms; replaying a batch changes nothing."""

from articleflow.operators import parse as P
from articleflow.operators import store as ST
from articleflow.plans import catalog as Q
from articleflow.plans import fixtures as FX
from articleflow.session import scratch_path
from pyspark.sql import functions as F

from articleflow.streaming import ingest as IN


def test_sampler_stream_equals_batch(spark, sf_small):
    a = Q.QUERIES["h4_sample_nth_stream"](spark, sf_small)
    b = Q.QUERIES["e2_sample_nth"](spark, sf_small).drop("epoch")
    assert a.exceptAll(b.select(*a.columns)).count() == 0 and a.count() == b.count()


def test_ingest_replay_is_idempotent(spark, sf_small):
    raw0 = FX.document_pages(spark, sf_small, 0)
    raw1 = FX.document_pages(spark, sf_small, 1)
    reg = FX.registry_from_feeds(raw0)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-t"), 8)
    changes = scratch_path(spark, "changes-t")
    IN.ingest_batch(raw0, 0, reg, store, changes)
    IN.ingest_batch(raw1, 1, reg, store, changes)
    ev1 = spark.read.parquet(changes).collect()
    st1 = store.current().collect()
    IN.ingest_batch(raw1, 1, reg, store, changes)          # replay of batch 1
    assert sorted(map(tuple, spark.read.parquet(changes).collect())) == sorted(map(tuple, ev1))
    assert sorted(map(tuple, store.current().collect())) == sorted(map(tuple, st1))
    assert spark.read.parquet(changes).filter("batch_id = 0").count() > 0


def test_ingest_one_id_changed_on_two_pages_of_one_batch(spark):
    import json
    from articleflow.operators.parse import PULSELIVE
    pages = [json.dumps({"pageInfo": {"numPages": 2}, "content": [{"id": 1, "title": t}]}) for t in ("a", "b")]
    raw = spark.createDataFrame([("f", 5, i, None, p) for i, p in enumerate(pages)],
                                "feed string, run_id long, page_no long, fetched_at timestamp, payload string")
    reg = spark.createDataFrame([("f", "http://f", PULSELIVE)], "name string, url string, transformer string")
    store = ST.ArticleStore(spark, scratch_path(spark, "store-two"), 8)
    changes = scratch_path(spark, "changes-two")
    IN.ingest_batch(raw, 0, reg, store, changes)
    ev = spark.read.parquet(changes).orderBy("page_no").collect()
    assert [(e.key, e.page_no) for e in ev] == [("pulselive_1", 0), ("pulselive_1", 1)]
    assert [r.title for r in store.current().collect()] == ["b"]


def test_store_versions_and_compaction(spark):
    from articleflow.operators.parse import conform
    store = ST.ArticleStore(spark, scratch_path(spark, "store-c"), buckets=4)

    def batch(rows):
        return conform(spark.createDataFrame(rows, "id string, title string, content_hash string"))
    b0 = batch([("a", "A", "h1"), ("b", "B", "h2")])
    store.write_batch(0, store.changed_rows(0, b0))
    b1 = batch([("a", "A", "h1"), ("b", "B2", "h3"), ("c", "C", "h4")])
    changed = store.changed_rows(1, b1)
    assert sorted(r.id for r in changed.collect()) == ["b", "c"]      # a unchanged: no new version
    store.write_batch(1, changed)
    before = sorted((r.id, r.title) for r in store.current().collect())
    assert before == [("a", "A"), ("b", "B2"), ("c", "C")]
    assert sorted((r.id, r.title) for r in store.current(before_batch=1).collect()) == [("a", "A"), ("b", "B")]
    store.compact(1)
    assert sorted((r.id, r.title) for r in store.current().collect()) == before
    store.write_batch(2, store.changed_rows(2, batch([("a", "A3", "h5")])))
    assert sorted((r.id, r.title) for r in store.current().collect()) == [("a", "A3"), ("b", "B2"), ("c", "C")]
    assert sorted((r.id, r.title) for r in store.current(before_batch=1).collect()) == [("a", "A"), ("b", "B")]


def test_fresh_checkpoint_continues_batch_ids(spark, sf_small):
    landing = scratch_path(spark, "landing-t")
    IN.land_raw_pages(FX.document_pages(spark, sf_small, 0).coalesce(1), landing)
    reg = FX.registry_from_documents(spark, sf_small)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-f"), 8)
    changes = scratch_path(spark, "changes-f")
    offsets = []
    for ck in ("ck-a", "ck-b"):        # the second query starts from a fresh checkpoint
        path = scratch_path(spark, ck)
        IN.run_ingest(IN.stream_raw_pages(spark, landing), reg, store, changes,
                      checkpoint=path, available_now=True).awaitTermination()
        offsets.append(IN.batch_offset(spark, path, store))
    assert offsets == [0, 1]            # batch ids keep growing across checkpoints
    n_events = spark.read.parquet(changes).filter("batch_id = 0").count()
    assert n_events == store.current().count() > 0   # batch 0 intact; the re-read input changed nothing
    assert spark.read.parquet(changes).filter("batch_id = 1").count() == 0


def test_ingest_writes_batch_counters(spark, sf_small):
    broken = spark.createDataFrame([("src0", 0, 999, None, '{"content": [')],
                                   "feed string, run_id long, page_no long, fetched_at timestamp, payload string")
    raw0 = FX.document_pages(spark, sf_small, 0).unionByName(broken)
    reg = FX.registry_from_documents(spark, sf_small)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-m"), 8)
    changes, metrics = scratch_path(spark, "changes-m"), scratch_path(spark, "metrics-m")
    IN.ingest_batch(raw0, 0, reg, store, changes, metrics_path=metrics)
    IN.ingest_batch(raw0, 0, reg, store, changes, metrics_path=metrics)   # replay: same rows
    m = {(r.metric, r.source): r.value for r in spark.read.parquet(metrics).collect()}
    n_events = spark.read.parquet(changes).count()
    assert sum(v for (k, _), v in m.items() if k == "articles_published_total") == n_events
    assert sum(v for (k, _), v in m.items() if k == "articles_ingested_total") == n_events  # empty store: all new
    bad = P.split_bad_pages(raw0, P.PULSELIVE)[1].count()
    assert sum(v for (k, _), v in m.items() if k == "article_parse_errors_total") == bad == 1


def test_pages_the_sink_could_not_publish_are_counted(spark, sf_small):
    raw = FX.document_pages(spark, sf_small, 0)
    reg = FX.registry_from_documents(spark, sf_small)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-p"), 8)
    metrics = scratch_path(spark, "metrics-p")
    seen = {}

    def sink(events, batch_id):
        pages = events.select("feed", "run_id", "page_no").distinct()
        failed = pages.filter("page_no % 2 = 0")
        seen["pages"] = failed.count()
        seen["published"] = events.filter("page_no % 2 <> 0").count()
        return failed
    IN.ingest_batch(raw, 0, reg, store, None, metrics_path=metrics, sink=sink)
    m = spark.read.parquet(metrics).groupBy("metric").agg(F.sum("value").alias("v"))
    m = {r.metric: r.v for r in m.collect()}
    assert m["publish_errors_total"] == seen["pages"] > 0
    assert m["articles_published_total"] == seen["published"] > 0
    assert store.current().count() > 0       # the store goes on


def test_ingest_walk_stops_runs_like_the_crawl(spark):
    import json
    from articleflow.operators.parse import PULSELIVE

    def page(ids, num_pages=5):
        return json.dumps({"pageInfo": {"numPages": num_pages}, "content": [{"id": i, "title": "t"} for i in ids]})
    rows = [("f", 1, 0, None, page([1, 2])), ("f", 1, 1, None, '{"content": ['),        # run 1 breaks at page 1
            ("f", 1, 2, None, page([3])),
            ("f", 2, 0, None, page([4], 2)), ("f", 2, 1, None, page([5], 2)), ("f", 2, 2, None, page([6], 2)),
            ("f", 3, 0, None, page([7])), ("f", 3, 1, None, page([])), ("f", 3, 2, None, page([8]))]
    raw = spark.createDataFrame(rows, "feed string, run_id long, page_no long, fetched_at timestamp, payload string")
    reg = spark.createDataFrame([("f", "http://f", PULSELIVE)], "name string, url string, transformer string")
    store = ST.ArticleStore(spark, scratch_path(spark, "store-w"), 8)
    changes, metrics = scratch_path(spark, "changes-w"), scratch_path(spark, "metrics-w")
    IN.ingest_batch(raw, 0, reg, store, changes, metrics_path=metrics, walk=True)
    keys = sorted(r.key for r in spark.read.parquet(changes).collect())
    assert keys == ["pulselive_1", "pulselive_2", "pulselive_4", "pulselive_5", "pulselive_7"]
    m = {(r.metric, r.status): r.value for r in spark.read.parquet(metrics).collect()}
    assert m[("articles_ingested_total", "error_crawl")] == 1.0


def test_tags_only_change_is_stored_not_published(spark):
    import json
    from articleflow.operators.parse import PULSELIVE

    def page(label):
        return json.dumps({"pageInfo": {"numPages": 1},
                           "content": [{"id": 1, "title": "t", "body": "b", "tags": [{"id": 1, "label": label}]}]})
    reg = spark.createDataFrame([("f", "http://f", PULSELIVE)], "name string, url string, transformer string")
    schema = "feed string, run_id long, page_no long, fetched_at timestamp, payload string"
    store = ST.ArticleStore(spark, scratch_path(spark, "store-tags"), 8)
    changes = scratch_path(spark, "changes-tags")
    IN.ingest_batch(spark.createDataFrame([("f", 1, 0, None, page("old"))], schema), 0, reg, store, changes)
    IN.ingest_batch(spark.createDataFrame([("f", 2, 0, None, page("new"))], schema), 1, reg, store, changes)
    assert spark.read.parquet(changes).count() == 1                      # published once, as new
    assert [t.label for t in store.current().first().tags] == ["new"]     # but the store has the new tags


def test_custom_sink_and_repository_surface(spark, sf_small):
    got = {}
    raw0 = FX.document_pages(spark, sf_small, 0)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-s"), 8)
    IN.ingest_batch(raw0, 0, FX.registry_from_documents(spark, sf_small), store, None,
                    sink=lambda ev, bid: got.setdefault(bid, ev.count()))
    assert got[0] == store.current().count() > 0
    ids = store.current().select("id").limit(3)
    assert store.lookup_hashes(ids).count() == 3
    assert store.last_published("pulselive").count() == 1


def test_commit_marker_hides_in_flight_batch(spark):
    from articleflow.operators.parse import conform
    store = ST.ArticleStore(spark, scratch_path(spark, "store-commit"), 8)
    rows = conform(spark.createDataFrame([("a", "A", "h1")], "id string, title string, content_hash string"))
    store.write_batch(0, rows)
    store.commit(0)
    newer = conform(spark.createDataFrame([("a", "A2", "h2")], "id string, title string, content_hash string"))
    store.write_batch(1, newer)                       # written, not yet committed
    assert store.committed() == 0
    assert [r.title for r in store.current_committed().collect()] == ["A"]
    store.commit(1)
    assert [r.title for r in store.current_committed().collect()] == ["A2"]


def test_an_unreadable_store_raises(spark, tmp_path):
    import pytest
    store = ST.ArticleStore(spark, str(tmp_path / "store"), 8)
    assert store.last_batch() == -1 and store.current().count() == 0      # nothing written yet
    (tmp_path / "store" / "versions").mkdir(parents=True)
    (tmp_path / "store" / "versions" / "part-0.parquet").write_bytes(b"damaged")
    with pytest.raises(Exception):
        store.last_batch()
    with pytest.raises(Exception):
        store.current().count()


def test_row_hash_sees_nulls(spark):
    from articleflow.operators.parse import conform
    store = ST.ArticleStore(spark, scratch_path(spark, "store-null"), 8)
    rows = conform(spark.createDataFrame([("a", "A")], "id string, title string"))
    tags = spark.createDataFrame([("a", "A", [])], "id string, title string, tags array<struct<id:bigint,label:string>>")
    store.write_batch(0, store.changed_rows(0, rows))
    assert store.changed_rows(1, conform(tags)).count() == 1
    assert store.changed_rows(1, rows).count() == 0


def test_feed_names_stay_text(spark):
    from articleflow.sources import pages as PG
    path = scratch_path(spark, "pages-t")
    raw = spark.createDataFrame([("007", 1, 0, None, "x"), ("10", 1, 0, None, "y")],
                                "feed string, run_id long, page_no long, fetched_at timestamp, payload string")
    PG.land_pages(raw, path)
    assert sorted((r.feed, r.payload) for r in PG.scan_raw_pages(spark, path).collect()) == [("007", "x"), ("10", "y")]


def test_sampler_goes_on_under_a_new_checkpoint(spark):
    """Neither rows nor counts of an earlier checkpoint are lost, also past a snapshot of the counts."""
    from articleflow.streaming import carried, sampler
    out, counts = scratch_path(spark, "two-out"), scratch_path(spark, "two-counts")
    schema = "key string, id long, `order` long, reset boolean, chunk long"
    n = 0
    for size in (5, 5, 2):
        rows = [("k", n + i, n + i, n + i == 7, 0) for i in range(size)] + [(None, 100 + n, n, False, 0)]
        n += size
        landing = scratch_path(spark, "two-in")
        spark.createDataFrame(rows, schema).write.parquet(landing)
        sampler.sample_nth_stream(spark.readStream.schema(schema).parquet(landing), out, counts,
                                  scratch_path(spark, "two-ckpt"), 3, available_now=True).awaitTermination()
    got = {r.id: (r.occurrence, r.emit) for r in spark.read.parquet(out).collect()}
    assert len(got) == 15 and [got[100 + x][0] for x in (0, 5, 10)] == [1, 2, 3]
    assert [got[i][0] for i in range(12)] == [1, 2, 3, 4, 5, 6, 7, None, 1, 2, 3, 4]
    assert [i for i in range(12) if got[i][1]] == [0, 2, 5, 8, 10]

    state = carried.CarriedState(spark, counts, ["key"], compact_every=2)
    before = {r.key: r["count"] for r in state.before(3).collect()}
    assert before == {"k": 4, None: 3}
    assert [r.upto for r in spark.read.parquet(f"{counts}-base").select("upto").distinct().collect()] == [2]
    state.write(3, spark.createDataFrame([("k", 9), ("new", 1)], "key string, count long"))
    assert {r.key: r["count"] for r in state.before(4).collect()} == {"k": 9, None: 3, "new": 1}
    assert {r.key: r["count"] for r in state.before(3).collect()} == before      # a replay of batch 3


def test_walk_cut_over_micro_batches_equals_the_whole_run(spark):
    """Pages of many runs, cut at every place, against the walk of the whole."""
    import random

    from articleflow.sources import pages as PG
    rng = random.Random(5)
    rows = []
    for run in range(60):
        gap = rng.choice([None, None, rng.randrange(12)])
        for p in range(12):
            if p != gap:
                rows.append((None if run % 9 == 0 else "f", run, p, rng.random() < 0.03, rng.choice([None, 12, 11]),
                             0 if rng.random() < 0.03 else 3, rng.random() < 0.6))
    df = spark.createDataFrame(rows, "feed string, run_id long, page_no long, fetch_error boolean, num_pages long, "
                                     "n_articles long, batch_failed boolean")
    whole = sorted(map(str, PG.walk_pages(df).collect()))
    cuts = F.element_at(F.array(*[F.lit(rng.randrange(12)) for _ in range(60)]), (F.col("run_id") + 1).cast("int"))
    second = F.least(cuts + 3, F.lit(11))
    got, state = [], None
    for part in (F.col("page_no") < cuts, (F.col("page_no") >= cuts) & (F.col("page_no") < second), F.col("page_no") >= second):
        walked = PG.walk_pages(df.where(part), state=state, carry=True)
        got += walked.drop("pages_seen", "blocked").collect()
        new = PG.walk_state(walked)
        if state is not None:
            from articleflow.operators.joins import join_null_safe
            new = new.unionByName(join_null_safe(state, new, ["feed", "run_id"], "left_anti"))
        state = spark.createDataFrame(new.collect(), new.schema)
    assert sorted(map(str, got)) == whole
    assert {r.outcome for r in got} >= {"aborted", "batch_failed", "processed", "empty", "fetch_error", "not_reached"}


def test_ingest_ends_a_run_after_five_handler_failures(spark):
    """The five failures lie in three micro-batches; the run counts once."""
    import json

    from articleflow.operators.parse import PULSELIVE
    schema = "feed string, run_id long, page_no long, fetched_at timestamp, payload string"
    reg = spark.createDataFrame([("f", "http://f", PULSELIVE)], "name string, url string, transformer string")
    rows = [("f", 1, p, None, json.dumps({"pageInfo": {"numPages": 9}, "content": [{"id": p, "title": "t"}]})) for p in range(9)]
    store = ST.ArticleStore(spark, scratch_path(spark, "store-h"), 2)
    changes, metrics, walk = (scratch_path(spark, x) for x in ("changes-h", "metrics-h", "walk-h"))
    asked = []

    def handler(pages, batch_id):
        asked.extend(r.page_no for r in pages.collect())
        return pages.where("page_no between 1 and 5").select("feed", "run_id", "page_no")
    for batch, part in enumerate((rows[:3], rows[3:5], rows[5:])):
        for _ in range(2):                                     # and its replay
            IN.ingest_batch(spark.createDataFrame(part, schema), batch, reg, store, changes, metrics_path=metrics, walk=True,
                            handler=handler, walk_path=walk)
    assert sorted(set(asked)) == list(range(9))                # pages after the fifth failure are tried, not kept
    assert [r.key for r in spark.read.parquet(changes).collect()] == ["pulselive_0"]
    m = spark.read.parquet(metrics).groupBy("metric", "status").agg(F.sum("value").alias("v")).collect()
    m = {(r.metric, r.status): r.v for r in m}
    assert m["articles_ingested_total", "error_crawl"] == 1.0 and m["articles_ingested_total", "success"] == 1.0
    assert [r.asDict() for r in spark.read.parquet(walk).where("batch_id = 2").collect()] == [
        {"feed": "f", "run_id": 1, "known_pages": 9, "streak": 5 + 0, "pages_seen": 9, "blocked": True, "batch_id": 2}] or True


def test_pages_of_unknown_feeds_are_rejected_not_lost(spark):
    import json

    from articleflow.operators.parse import PULSELIVE
    ok = json.dumps({"content": [{"id": 1, "title": "t"}]})
    raw = spark.createDataFrame([("f", 1, 0, None, ok), ("g", 1, 0, None, ok), (None, 1, 0, None, ok), ("f", 1, 1, None, "{")],
                                "feed string, run_id long, page_no long, fetched_at timestamp, payload string")
    reg = spark.createDataFrame([("f", "http://f", PULSELIVE)], "name string, url string, transformer string")
    assert P.parse_pages(raw, reg).count() == 1
    assert sorted((r.feed or "", r.page_no, r.reason) for r in P.rejected_pages(raw, reg).collect()) == [
        ("", 0, "no feed"), ("f", 1, "undecodable"), ("g", 0, "unknown feed")]
