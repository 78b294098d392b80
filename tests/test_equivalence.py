"""Set-based operators against plain sequential loops (seeded random data)."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from articleflow.operators import changes as C
from articleflow.operators.skew import chunked_lag, chunked_running
from articleflow.sources import pages as PG


def test_change_feed_equals_sequential_loop(spark):
    rnd = random.Random(7)
    ids = [f"a{i}" for i in range(25)]
    rows = []
    for run in range(3):
        for feed in ("f1", "f2"):
            for page in range(4):
                for _ in range(rnd.randint(0, 8)):
                    rows.append((feed, run, page, rnd.choice(ids), rnd.choice(["h1", "h2", "h3"])))
    # unique per page: first occurrence wins
    seen, pages = set(), []
    for r in rows:
        if (r[0], r[1], r[2], r[3]) not in seen:
            seen.add((r[0], r[1], r[2], r[3]))
            pages.append(r)
    store0 = {i: rnd.choice(["h1", "h2", ""]) for i in rnd.sample(ids, 10)}
    # sequential loop: pages applied in (run, feed, page) order
    state, expected = dict(store0), {}
    for key in sorted({(r[1], r[0], r[2]) for r in pages}):
        run, feed, page = key
        for r in [p for p in pages if (p[1], p[0], p[2]) == key]:
            old = state.get(r[3])
            expected[(feed, run, page, r[3])] = "new" if old is None else ("changed" if old != r[4] else "unchanged")
        for r in [p for p in pages if (p[1], p[0], p[2]) == key]:
            state[r[3]] = r[4]
    df = spark.createDataFrame(pages, "feed string, run_id long, page_no long, id string, content_hash string")
    store = spark.createDataFrame(list(store0.items()), "id string, content_hash string")
    got = {(r.feed, r.run_id, r.page_no, r.id): r.change for r in C.change_feed(df, store).collect()}
    assert got == expected


def _crawl_loop(pages):
    """The crawl loop, page by page."""
    out, num_pages, consecutive, page = {}, -1, 0, 0
    by_no = {p["page_no"]: p for p in pages}
    while page < 1000:
        if num_pages != -1 and page >= num_pages:
            break
        p = by_no.get(page)
        if p is None:
            break
        if p["fetch_error"]:
            out[page] = "fetch_error"
            break
        if p["n_articles"] == 0:
            out[page] = "empty"
            break
        if p["batch_failed"]:
            consecutive += 1
            if consecutive >= 5:
                out[page] = "aborted"
                break
            out[page] = "batch_failed"
        else:
            consecutive = 0
            out[page] = "processed"
        if p["num_pages"] is not None:
            num_pages = p["num_pages"]
        page += 1
    return out


def test_walk_pages_equals_crawl_loop(spark):
    rnd = random.Random(11)
    rows, expected = [], {}
    for run in range(200):
        n = rnd.randint(1, 14)
        pages = []
        for p in range(n):
            pages.append({"page_no": p, "fetch_error": rnd.random() < 0.04, "n_articles": 0 if rnd.random() < 0.04 else 3,
                          "batch_failed": rnd.random() < 0.45,
                          "num_pages": None if rnd.random() < 0.2 else rnd.choice([-1, n, n - 2, 20])})
        for p in pages:
            rows.append(("f", run, p["page_no"], p["fetch_error"], p["num_pages"], p["n_articles"], p["batch_failed"]))
        loop = _crawl_loop(pages)
        for p in pages:
            expected[(run, p["page_no"])] = loop.get(p["page_no"], "not_reached")
    df = spark.createDataFrame(rows, "feed string, run_id long, page_no long, fetch_error boolean, "
                                     "num_pages long, n_articles long, batch_failed boolean")
    got = {(r.run_id, r.page_no): r.outcome for r in PG.walk_pages(df).collect()}
    assert got == expected


def test_chunked_windows_equal_plain_windows(spark):
    rnd = random.Random(3)
    rows = [(rnd.choice("abc"), i, i // 17, float(rnd.randint(-5, 9))) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t long, chunk long, v double")
    w = Window.partitionBy("k").orderBy("t")
    plain = (df.withColumn("p_lag", F.lag("v").over(w))
               .withColumn("p_sum", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)))
               .withColumn("p_max", F.max("v").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    ch = chunked_lag(df, ["k"], ["t"], "chunk", "v", "c_lag")
    ch = chunked_running(ch, ["k"], ["t"], "chunk", {"c_sum": ("sum", F.col("v")), "c_max": ("max", F.col("v"))})
    a = {r.t: (r.p_lag, r.p_sum, r.p_max) for r in plain.collect()}
    b = {r.t: (r.c_lag, r.c_sum, r.c_max) for r in ch.collect()}
    assert a == b


def test_dedup_in_array_equals_dedup_over_rows(spark, sf_small):
    from articleflow.operators import parse as P
    from articleflow.plans import fixtures as FX
    raw = FX.document_pages(spark, sf_small, 0)
    a = P.parse_pulselive(raw, dedup=True)
    b = C.dedup_batch(P.parse_pulselive(raw))
    assert a.exceptAll(b.select(*a.columns)).count() == 0
    assert b.select(*a.columns).exceptAll(a).count() == 0
