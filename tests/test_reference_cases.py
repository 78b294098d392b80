"""The reference's own test cases, re-expressed over DataFrames."""

import datetime as dt

from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.operators import changes as C
from articleflow.operators import store as ST
from articleflow.operators import streaks as SK
from articleflow.sources import pages as PG


def _articles(spark, rows):
    """rows: dicts of article fields; the rest zero-valued."""
    from articleflow.operators.parse import conform
    df = spark.createDataFrame(rows)
    return conform(df)


def test_new_changed_unchanged_all_upserted_two_published(spark):
    batch = C.with_content_hash(_articles(spark, [
        {"id": "1", "title": "New", "source": "test", "url": "u1"},
        {"id": "2", "title": "Changed", "source": "test", "url": "u2"},
        {"id": "3", "title": "Same", "source": "test", "url": "u3"},
    ]))
    same_hash = batch.filter("id = '3'").select("content_hash").first()[0]
    store = _articles(spark, [{"id": "2", "content_hash": "old_hash"}, {"id": "3", "content_hash": same_hash}])
    cls = C.classify_changes(batch, C.lookup_hashes(store, batch))
    published = sorted(r.id for r in cls.filter(F.col("change") != "unchanged").collect())
    assert published == ["1", "2"]
    after = ST.upsert_articles(store, batch)
    assert after.count() == 3
    assert {r.id: r.title for r in after.collect()} == {"1": "New", "2": "Changed", "3": "Same"}


def _pages(spark, rows):
    return spark.createDataFrame(rows, "feed string, run_id long, page_no long, fetch_error boolean, "
                                       "num_pages long, n_articles long, batch_failed boolean")


def test_one_bad_batch_does_not_stop_the_run(spark):
    pages = _pages(spark, [("f", 1, 0, False, 3, 1, False), ("f", 1, 1, False, 3, 1, True),
                           ("f", 1, 2, False, 3, 1, False)])
    out = {r.page_no: r.outcome for r in PG.walk_pages(pages).collect()}
    assert out == {0: "processed", 1: "batch_failed", 2: "processed"}
    assert not PG.run_status(PG.walk_pages(pages)).first().failed


def test_persistent_failure_ends_run_after_exactly_five(spark):
    pages = _pages(spark, [("f", 1, p, False, 10, 1, True) for p in range(10)])
    w = PG.walk_pages(pages)
    out = [r.outcome for r in w.orderBy("page_no").collect()]
    assert out == ["batch_failed"] * 4 + ["aborted"] + ["not_reached"] * 5
    assert PG.run_status(w).first().failed


def test_upsert_then_last_published_round_trip(spark):
    now = dt.datetime(2024, 5, 1, 12, 30, 15, 123000)
    a = spark.createDataFrame([{"id": "test-1", "source": "test-source", "title": "Integration Test",
                                "url": "http://test.com/1", "published_at": now, "content_hash": "hash123"}])
    from articleflow.operators.parse import conform
    store = ST.upsert_articles(spark.createDataFrame([], S.ARTICLE), conform(a))
    got = ST.last_published(store, "test-source").collect()
    assert len(got) == 1 and got[0].id == "test-1" and got[0].title == "Integration Test"
    assert abs((got[0].published_at - now).total_seconds()) < 0.001
    assert ST.last_published(store, "other").count() == 0


def test_bulk_upsert_and_hash_lookup_ignore_unknown_ids(spark):
    from articleflow.operators.parse import conform
    batch = conform(spark.createDataFrame([
        {"id": "b1", "source": "src1", "title": "Batch 1", "content_hash": "h1"},
        {"id": "b2", "source": "src1", "title": "Batch 2", "content_hash": "h2"}]))
    store = ST.upsert_articles(spark.createDataFrame([], S.ARTICLE), batch)
    ids = spark.createDataFrame([("b1",), ("b2",), ("non-existent",)], "id string")
    got = {r.id: r.content_hash for r in C.lookup_hashes(store, ids).collect()}
    assert got == {"b1": "h1", "b2": "h2"}


def _sampler_rows(spark, rows):
    return spark.createDataFrame(rows, "key string, seq long, reset boolean")


def test_sampler_first_and_tenth_then_reset(spark):
    rows = [("k", i, False) for i in range(1, 11)]
    s = SK.sample_nth(_sampler_rows(spark, rows), "key", ["seq"], 10, reset="reset")
    emitted = [r.seq for r in s.filter("emit").orderBy("seq").collect()]
    assert emitted == [1, 10]
    assert SK.sample_counts(s, "key").first()["count"] == 10
    s2 = SK.sample_nth(_sampler_rows(spark, rows + [("k", 11, True)]), "key", ["seq"], 10, reset="reset")
    assert SK.sample_counts(s2, "key").first()["count"] == 0


def test_sampler_keys_independent_and_reset_all(spark):
    rows = [("error_a", i, False) for i in range(1, 6)] + [("error_b", i, False) for i in range(1, 4)]
    s = SK.sample_nth(_sampler_rows(spark, rows), "key", ["seq"], 5, reset="reset")
    counts = {r.key: r["count"] for r in SK.sample_counts(s, "key").collect()}
    assert counts == {"error_a": 5, "error_b": 3}
    assert [r.seq for r in s.filter("emit AND key = 'error_a'").orderBy("seq").collect()] == [1, 5]
    # reset of every key: one reset row per key
    s2 = SK.sample_nth(_sampler_rows(spark, rows + [("error_a", 99, True), ("error_b", 99, True)]),
                       "key", ["seq"], 5, reset="reset")
    assert {r["count"] for r in SK.sample_counts(s2, "key").collect()} == {0}


def test_sampler_n_below_one_means_ten(spark):
    rows = [("k", i, False) for i in range(1, 21)]
    s = SK.sample_nth(_sampler_rows(spark, rows), "key", ["seq"], 0, reset="reset")
    assert [r.seq for r in s.filter("emit").orderBy("seq").collect()] == [1, 10, 20]


def test_route_with_python_client_batches(spark):
    from articleflow.operators.parse import conform
    from articleflow.sources import changelog as CL
    arts = conform(spark.createDataFrame([{"id": str(i), "body": "x" * i} for i in range(1, 30)]))
    routed = CL.route_with(arts, lambda pdf: pdf["body"].str.len() % 7 != 0)
    assert routed.filter("NOT synced").count() == 4       # lengths 7, 14, 21, 28


def test_sampler_reset_all_keys(spark):
    rows = [("error_a", i, False, False) for i in range(1, 6)] + [("error_b", i, False, False) for i in range(1, 4)]
    df = spark.createDataFrame(rows + [(None, 50, False, True)], "key string, seq long, reset boolean, reset_all boolean")
    s = SK.sample_nth(df, "key", ["seq"], 5, reset="reset", reset_all="reset_all")
    counts = {r.key: r["count"] for r in SK.sample_counts(s, "key").collect()}
    assert counts == {"error_a": 0, "error_b": 0}
    more = spark.createDataFrame(rows + [(None, 50, False, True), ("error_a", 60, False, False)],
                                 "key string, seq long, reset boolean, reset_all boolean")
    s2 = SK.sample_nth(more, "key", ["seq"], 5, reset="reset", reset_all="reset_all")
    got = {r.seq: (r.occurrence, r.emit) for r in s2.filter("key = 'error_a'").collect()}
    assert got[60] == (1, True) and got[5] == (5, True)
    counts2 = {r.key: r["count"] for r in SK.sample_counts(s2, "key").collect()}
    assert counts2 == {"error_a": 1, "error_b": 0}


def test_write_changes_keeps_each_key_in_one_file(spark, tmp_path):
    from articleflow.operators.parse import conform
    from articleflow.sources import changelog as CL
    arts = conform(spark.createDataFrame([{"id": f"k{i % 7}", "title": str(i)} for i in range(70)]))
    path = str(tmp_path / "changes")
    CL.write_changes(CL.to_change_events(arts), path, partitions=4)
    per_key = (spark.read.parquet(path).withColumn("f", F.input_file_name())
                    .groupBy("key").agg(F.countDistinct("f").alias("files"), F.count(F.lit(1)).alias("n")))
    rows = per_key.collect()
    assert len(rows) == 7 and all(r.files == 1 and r.n == 10 for r in rows)
