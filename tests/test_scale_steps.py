"""Steps whose cost must follow the input: what they move, against plain loops."""

import json
import random

import pytest
from pyspark.sql import functions as F

from articleflow.operators import changes as C
from articleflow.operators import series as SR
from articleflow.operators import store as ST
from articleflow.operators.parse import PULSELIVE
from articleflow.plans import fixtures as FX
from articleflow.session import scratch_path
from articleflow.sources import changelog as CL
from articleflow.streaming import ingest as IN

RAW = "feed string, run_id long, page_no long, fetched_at timestamp, payload string"


def _registry(spark, *feeds):
    return spark.createDataFrame([(f, f"http://{f}", PULSELIVE) for f in feeds], "name string, url string, transformer string")


def _page(feed, run, no, items):
    content = [{"id": i, "title": t, "tags": [{"id": 1, "label": tag}]} for i, t, tag in items]
    return feed, run, no, None, json.dumps({"pageInfo": {"numPages": 9}, "content": content})


def test_only_narrow_rows_are_ordered_and_compared(spark, monkeypatch):
    """The article bodies take no part in the change feed of a batch."""
    seen, feed = [], C.change_feed
    monkeypatch.setattr(C, "change_feed", lambda pages, *a, **k: seen.append(pages.columns) or feed(pages, *a, **k))
    store = ST.ArticleStore(spark, scratch_path(spark, "store-narrow"), 4)
    changes = scratch_path(spark, "changes-narrow")
    IN.ingest_batch(spark.createDataFrame([_page("f", 1, 0, [(1, "a", "x")])], RAW), 0, _registry(spark, "f"), store, changes)
    assert len(seen) == 1 and not {"body", "title", "summary", "content"} & set(seen[0])
    assert [json.loads(r.value)["title"] for r in spark.read.parquet(changes).collect()] == ["a"]
    assert [r.title for r in store.current().collect()] == ["a"]


def test_article_rows_are_shuffled_once(spark):
    store = ST.ArticleStore(spark, scratch_path(spark, "store-once"), 4)
    raw = spark.createDataFrame([_page("f", 1, p, [(p, "a", "x")]) for p in range(3)], RAW).withColumn("parser", F.lit(PULSELIVE))
    arts = IN.article_rows(IN.P.decode_pages(raw, "parser"))
    marks = spark.createDataFrame([("pulselive_1", 1, "f", 1, 0, 0, 1, 1)],
                                  "id string, run_id long, feed string, page_no long, pos long, row_hash long, n_emit long, n_store long")
    marked = IN.marked_rows(arts, marks, store)
    plan = marked._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_batches_equal_the_sequential_loop(spark):
    """Random batches with pages that landed twice, ids on many pages, edits of
    the hashed and of the other fields; null feeds and page numbers."""
    rnd = random.Random(3)
    store = ST.ArticleStore(spark, scratch_path(spark, "store-loop"), 4)
    changes, metrics = scratch_path(spark, "changes-loop"), scratch_path(spark, "metrics-loop")
    state, events, published = {}, [], 0
    for batch in range(3):
        pages = {}
        for run in (2 * batch, 2 * batch + 1):
            for feed in ("f", "g"):
                for no in (None, 0, 1, 2):
                    items = {i: (i, rnd.choice("ab"), rnd.choice("xy")) for i in rnd.sample(range(9), rnd.randrange(5))}
                    pages[run, feed, no] = list(items.values())
        copies = [(k, rnd.choice([1, 1, 1, 3])) for k in pages]
        rows = [_page(feed, run, no, pages[run, feed, no]) for (run, feed, no), n in copies for _ in range(n)]
        rnd.shuffle(rows)
        raw = spark.createDataFrame(rows, RAW)
        for _ in range(2):                                    # and its replay
            IN.ingest_batch(raw, batch, _registry(spark, "f", "g"), store, changes, metrics_path=metrics)
        for (run, feed, no), _ in sorted(copies, key=lambda c: (c[0][0], c[0][1], -1 if c[0][2] is None else c[0][2])):
            for i, title, tag in pages[run, feed, no]:
                if state.get(i, ("", ""))[0] != title:
                    events.append((batch, f"pulselive_{i}", title, feed, run, no))
                state[i] = (title, tag)
        got = [(r.batch_id, r.key, json.loads(r.value)["title"], r.feed, r.run_id, r.page_no)
               for r in spark.read.parquet(changes).collect()]
        assert sorted(map(str, got)) == sorted(map(str, events))
        assert {r.id: (r.title, r.tags[0].label) for r in store.current().collect()} == {
            f"pulselive_{i}": v for i, v in state.items()}
        published = spark.read.parquet(metrics).where("metric = 'articles_published_total'").agg(F.sum("value")).first()[0]
        # pages without a number have no page to be counted under
        assert published == sum(e[5] is not None for e in events)


@pytest.mark.parametrize("run", [0, 1])
def test_pages_of_gathered_documents_equal_grouped_items(spark, sf_small, run):
    a = FX.document_pages(spark, sf_small, run)
    b = FX.pages_from_items(FX.document_items(spark, sf_small, run))
    assert a.columns == b.columns and a.count() == b.count() > 0
    assert a.exceptAll(b).count() == 0
    c = FX.document_pages(spark, sf_small, run, FX.documents_by_page(spark, sf_small))
    assert c.exceptAll(a).count() == 0


def test_a_column_outcome_is_not_written_twice(spark, monkeypatch):
    """Only a client's outcomes need a table of their own."""
    store = ST.ArticleStore(spark, scratch_path(spark, "store-out"), 2)
    changes = scratch_path(spark, "changes-out")
    pages = [_page("f", 1, 0, [(i, "ab"[i % 2], "x") for i in range(6)])]
    IN.ingest_batch(spark.createDataFrame(pages, RAW), 0, _registry(spark, "f"), store, changes)
    table, used = CL.outcome_table, []
    monkeypatch.setattr(CL, "outcome_table", lambda *a: used.append(1) or table(*a))
    results = []
    for outcome in (F.col("title") == "a", lambda pdf: pdf["title"] == "a"):
        synced, dead, metrics = (scratch_path(spark, x) for x in ("synced-o", "dead-o", "metrics-o"))
        IN.sync_batch(spark.read.parquet(changes), 0, outcome, synced, dead, metrics)
        results.append((sorted(r.id for r in spark.read.parquet(synced).collect()),
                        sorted(r.key for r in spark.read.parquet(dead).collect()),
                        sorted((r.metric, r.value) for r in spark.read.parquet(metrics).collect())))
        assert used == [1] * (len(results) - 1)
    assert results[0] == results[1] and len(results[0][0]) == len(results[0][1]) == 3


def test_gauge_intervals_need_two_shuffles_at_most(spark):
    """One by chunk of a series and a narrow one of its edges, besides the scalar end."""
    s = spark.createDataFrame([("g", "a", 1.0)], "metric string, source string, value double").withColumn(
        "ts", F.lit("2024-03-01 00:00:00").cast("timestamp"))
    iv = SR.gauge_alert_intervals(s, ["metric", "source"], 30, "==", 2.0, 120, end_us=1_800_000_000_000_000)
    plan = iv._jdf.queryExecution().executedPlan().toString()
    assert 1 <= plan.count("Exchange hashpartitioning") <= 2, plan


def test_condition_spans_equal_a_loop(spark):
    """Runs inside chunks, over their borders, over whole chunks and at the end."""
    rnd = random.Random(9)
    rows, expected = [], []
    for key, p in (("a", 0.5), ("b", 0.9), (None, 0.1), ("d", 1.0), ("e", 0.0)):
        times = sorted(rnd.sample(range(300), 90))
        held = [rnd.random() < p for _ in times]
        rows += [(key, t, c, t // 10) for t, c in zip(times, held)]
        for i, (t, c) in enumerate(zip(times, held)):
            if c and (i == 0 or not held[i - 1]):
                expected.append((key, t, next((u for u, d in zip(times[i:], held[i:]) if not d), None)))
    df = spark.createDataFrame(rows, "k string, t long, c boolean, _chunk long").repartition(3)
    got = [tuple(r) for r in SR.condition_spans(df, ["k"], ["t"], "t", F.col("c")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, expected)) and len(got) > 30
