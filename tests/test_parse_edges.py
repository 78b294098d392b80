"""Payload edge cases for the two page formats and the registry."""

import json


from articleflow.operators import parse as P
from articleflow.sources import registry as RG


def _raw(spark, payloads, feed="f"):
    return spark.createDataFrame([(feed, 1, i, None, p) for i, p in enumerate(payloads)],
                                 "feed string, run_id long, page_no long, fetched_at timestamp, payload string")


def test_first_feed_fields_and_fallbacks(spark):
    page = {"pageInfo": {"page": 0, "numPages": -1, "pageSize": 2, "numEntries": 5}, "content": [
        {"id": 1, "title": "t", "summary": "s", "description": "", "date": "2024-01-02T03:04:05Z",
         "lastModified": 1704164645999, "canonicalUrl": "u?x=1", "tags": [{"id": 7, "label": "L"}],
         "leadMedia": {"imageUrl": "i"}},
        {"id": 2, "date": "2024-01-02", "lastModified": 1500},          # date only -> lastModified
        {"id": 3, "date": "2024-01-02T03:04:05"},                        # zone-less, no lastModified -> 1970
        {"id": 4, "date": "2024-01-02T03:04:05.5+01:00"},
        {"id": 1, "title": "repeat"},                                    # repeated id in the page
    ]}
    arts = P.parse_pulselive(_raw(spark, [json.dumps(page)]), dedup=True)
    r = {x.id: x for x in arts.collect()}
    assert set(r) == {"pulselive_1", "pulselive_2", "pulselive_3", "pulselive_4"}
    a = r["pulselive_1"]
    assert (a.title, a.description, a.summary, a.url, a.image_url, a.source, a.external_id) == \
        ("t", "s", "s", "u?x=1", "i", "pulselive", "1")
    assert [(t.id, t.label) for t in a.tags] == [(7, "L")]
    assert str(a.published_at) == "2024-01-02 03:04:05"
    assert str(a.updated_at) == "2024-01-02 03:04:05"          # ms truncated to seconds
    assert str(r["pulselive_2"].published_at) == "1970-01-01 00:00:01"
    assert str(r["pulselive_3"].published_at) == "1970-01-01 00:00:00"
    assert str(r["pulselive_4"].published_at) == "2024-01-02 02:04:05.500000"
    assert r["pulselive_2"].tags == [] and r["pulselive_2"].content == ""
    info = P.page_info(_raw(spark, [json.dumps(page), '{"content": [{"id": 1}]}']), P.PULSELIVE).collect()
    assert sorted((i.num_pages, i.n_articles) for i in info) == [(-1, 5), (0, 1)]  # missing pageInfo -> 0


def test_bad_pages_fail_whole(spark):
    good = json.dumps({"content": [{"id": 1, "title": "a"}]})
    payloads = [good, good[:-3], json.dumps({"content": [{"id": 1, "title": 5}]}),
                json.dumps({"content": [{"id": "x"}]}), good + " trailing text", "null", "", "[1, 2]"]
    ok, bad = P.split_bad_pages(_raw(spark, payloads), P.PULSELIVE)
    assert sorted(r.page_no for r in ok.collect()) == [0, 4, 5]
    assert sorted(r.page_no for r in bad.collect()) == [1, 2, 3, 6, 7]
    assert P.parse_pulselive(_raw(spark, payloads)).count() == 2     # pages 0 and 4; 'null' is empty


def test_second_feed_summary_and_zero_time(spark):
    page = {"items": [{"id": "a", "headline": "h", "content": "héllo wörld, long", "timestamp": "2024-01-01T00:00:00Z"},
                      {"id": "b", "content": "short", "timestamp": "bad"}]}
    r = {x.id: x for x in P.parse_items(_raw(spark, [json.dumps(page)])).collect()}
    assert r["dummy_a"].summary == "héllo wörl..." and r["dummy_a"].url == "http://dummy/a"
    assert r["dummy_b"].summary == "short..." and r["dummy_b"].published_at is None
    assert r["dummy_b"].tags is None and r["dummy_b"].type == ""


def test_hash_has_no_separator(spark):
    from articleflow.operators.changes import with_content_hash
    from articleflow.operators.parse import conform
    df = conform(spark.createDataFrame([{"id": "1", "title": "ab", "summary": "c"},
                                        {"id": "2", "title": "a", "summary": "bc"}]))
    hs = [r.content_hash for r in with_content_hash(df).collect()]
    assert hs[0] == hs[1] and len(hs[0]) == 64


def test_registry_rules_and_broken_file(spark):
    doc = json.dumps([{"name": "a", "url": "http://x", "transformer": "pulselive"},
                      {"name": "", "url": "http://x", "transformer": "pulselive"},
                      {"name": "b", "url": "ftp://x", "transformer": "pulselive"},
                      {"name": "c", "url": "http://x", "transformer": "rss"},
                      {"name": "d", "url": "http://x", "transformer": "dummy",
                       "pagination": {"type": "offset", "default_limit": 5}}])
    files = spark.createDataFrame([(doc,), (doc[:-5],), ('[{"name": 5, "url": "http://x"}]',)], "value string")
    out = {r.pos: r.reject_reason for r in RG.parse_sources(files).collect()}
    assert out == {0: None, 1: "name is required", 2: "url must start with http", 3: "unknown transformer", 4: None}
    plan = RG.plan_pages(RG.parse_sources(files).filter("valid"), 2)
    urls = sorted(r.request_url for r in plan.collect())
    assert urls == ["http://x?page=0&pageSize=20", "http://x?page=0&pageSize=5",
                    "http://x?page=1&pageSize=20", "http://x?page=5&pageSize=5"]


def test_missing_registry_file_gives_default(spark, tmp_path):
    valid, rejected = RG.load_sources(spark, str(tmp_path / "none.json"),
                                      default={"name": "default", "url": "https://feed.example/", "transformer": "pulselive"})
    assert [r.name for r in valid.collect()] == ["default"]


def test_read_changes_drops_undecodable_messages(spark):
    from articleflow.sources import changelog as CL
    good = '{"id":"a","title":"t","published_at":"2024-01-02T03:04:05Z","fetched_at":null,"tags":null}'
    msgs = [("a", good), ("b", '{"id":"b","title":5}'), ("c", '{"id":"c","published_at":"yesterday"}'),
            ("d", '{"id":"d"'), ("e", '{"id":"e","tags":[{"id":1,"label":2}]}'), ("f", '{"id":"f"}')]
    out = {r.key: r for r in CL.read_changes(spark.createDataFrame(msgs, "key string, value string")).collect()}
    assert sorted(out) == ["a", "f"]
    assert str(out["a"].published_at) == "2024-01-02 03:04:05" and out["a"].fetched_at is None
    assert out["f"].title == "" and out["f"].published_at is None


def test_large_page_dedup_keeps_first_of_each_id(spark):
    import time
    items = [{"id": i % 1700, "title": f"t{i}"} for i in range(5000)]
    raw = _raw(spark, [json.dumps({"content": items})])
    t0 = time.time()
    rows = P.parse_pulselive(raw, dedup=True).select("pos", "id", "title").collect()
    assert time.time() - t0 < 60
    assert len(rows) == 1700
    assert all(r.title == f"t{r.pos}" and r.pos < 1700 for r in rows)
    assert [r.pos for r in sorted(rows, key=lambda r: r.pos)] == list(range(1700))


def test_no_valid_source_is_an_error_when_required(spark, tmp_path):
    import pytest
    f = tmp_path / "sources.json"
    f.write_text(json.dumps([{"name": "x", "url": "ftp://x", "transformer": "pulselive"}]))
    valid, rejected = RG.load_sources(spark, str(f))
    assert valid.count() == 0 and rejected.count() == 1
    with pytest.raises(ValueError):
        RG.load_sources(spark, str(f), require=True)


def test_plan_pages_without_a_cap_and_offset(spark):
    src = spark.createDataFrame([("s", "http://x/feed?a=1", ("offset", "", "", 100))],
                                "name string, url string, pagination struct<type:string, page_param:string, "
                                "limit_param:string, default_limit:bigint>")
    plan = RG.plan_pages(src, 5000)
    assert plan.count() == 5000
    assert RG.plan_pages(src, 0).count() == 0
    last = plan.orderBy(plan.page_no.desc()).first()
    assert last.request_url == "http://x/feed?a=1&page=499900&pageSize=100"


def test_age_tier_boundaries(spark):
    import datetime as dt
    from articleflow.operators import retention as RT
    now = dt.datetime(2024, 6, 1)
    ages = {"hot": dt.timedelta(days=7) - dt.timedelta(microseconds=1), "warm": dt.timedelta(days=7),
            "cold": dt.timedelta(days=30), "delete": dt.timedelta(days=90)}
    df = spark.createDataFrame([(k, now - v) for k, v in ages.items()], "want string, ts timestamp")
    got = {r.want: r.tier for r in RT.age_tier(df, "ts", "2024-06-01 00:00:00").collect()}
    assert got == {k: k for k in ages}
    kept = [r.want for r in RT.expire(df, "ts", "2024-06-01 00:00:00", 15).collect()]
    assert sorted(kept) == ["hot", "warm"]


def test_log_records_of_all_keys(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from articleflow.sources import logs as LG
    rows = ['{"k":null,"level":"warn","@timestamp":"2024-01-02T03:04:05Z"}', '{"k":9,"o":{"a":[1]}}', "x", "[1]", None, '{"k":1,"k":2}',
            "{}", '{"@timestamp":5}', '{"message":"own","error":"e"}']
    df = spark.createDataFrame([(7, r) for r in rows], "k long, message string")
    out = LG.ingest_objects(df, constants={"env": "x"})
    got = {r.message: ({k: v for k, v in r.m.items() if k not in ("message", "env")}, str(r.ts), r.k) for r in out.select(
        "message", "k", F.col("ts"), F.transform_values("record", lambda k, v: F.to_json(v)).alias("m")).collect()}
    error = {"k": "7", "error": f'"{LG.DECODE_ERROR}"'}
    assert got[rows[0]] == ({"k": "null", "level": '"warn"', "@timestamp": '"2024-01-02T03:04:05Z"'}, "2024-01-02 03:04:05", 7)
    assert got[rows[1]] == ({"k": "9", "o": '{"a":[1]}'}, "None", 7)
    assert all(got[r] == (error, "None", 7) for r in ("x", "[1]", None, rows[5]))
    assert got["{}"][0] == {"k": "7"} and got[rows[7]] == ({"k": "7", "@timestamp": "5"}, "None", 7)
    assert got[rows[8]][0] == {"k": "7", "error": '"e"'}
    declared = LG.ingest_logs(df, T.StructType([T.StructField("k", T.LongType())])).collect()
    assert [r.k for r in declared][:5] == [None, 9, 7, 7, 7] and declared[6].k == 7


def test_days_expire_and_move_without_touching_others(spark):
    import os
    from datetime import date, datetime, timedelta

    from articleflow.operators import retention as RT
    from articleflow.session import scratch_path
    rows = [(i, datetime(2024, 1, 1) + timedelta(hours=7 * i)) for i in range(100)] + [(100, None)]
    df = spark.createDataFrame(rows, "id long, ts timestamp")
    path = scratch_path(spark, "by-day")
    RT.land_by_day(df, "ts", path)
    files = lambda: {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet")}
    before = files()
    assert RT.drop_expired(spark, path, datetime(2024, 1, 20, 5)) == [date(2024, 1, d) for d in range(1, 5)]
    assert RT.drop_expired(spark, path, datetime(2024, 1, 20, 5)) == []
    assert files().items() <= before.items()              # no file of a kept day was written again
    kept = spark.read.parquet(path)
    assert kept.where("ts is null").count() == 1 and kept.agg({"day": "min"}).first()[0] == date(2024, 1, 5)
    exact = {r.id for r in RT.expire(kept, "ts", "2024-01-20 05:00:00").collect()}
    assert exact == {i for i, t in rows if t and datetime(2024, 1, 20, 5) - t < timedelta(days=15)}

    roots = {"hot": path, "warm": scratch_path(spark, "warm"), "cold": scratch_path(spark, "cold")}
    RT.land_by_day(df.where("id = 20"), "ts", roots["warm"])            # the day is already there
    went = RT.move_tiers(spark, roots, datetime(2024, 1, 20))
    assert set(went.values()) == {"warm"} and max(went) == date(2024, 1, 12)
    assert RT.move_tiers(spark, roots, datetime(2024, 1, 20)) == {}
    warm = spark.read.parquet(roots["warm"])
    assert warm.where("id = 20").count() == 2 and warm.where("id = 21").count() == 1
    assert set(RT.move_tiers(spark, roots, datetime(2025, 1, 1)).values()) == {"delete"}
    assert [r.id for r in spark.read.parquet(path).collect()] == [100]
