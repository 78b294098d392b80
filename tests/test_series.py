"""Alert rules, quantiles and grids on small synthetic series."""

import datetime as dt

from pyspark.sql import functions as F

from articleflow.operators import series as SR

T0 = dt.datetime(2024, 3, 1, 0, 0, 0)


def _samples(spark, rows):
    """rows: (metric, source, status, seconds after T0, value[, le])"""
    data = [(m, src, st, T0 + dt.timedelta(seconds=s), float(v), le) for m, src, st, s, v, *rest in rows
            for le in [rest[0] if rest else None]]
    return spark.createDataFrame(data, "metric string, source string, status string, ts timestamp, value double, le string")


def test_rate_rule_fires_after_hold(spark):
    rows = [("articles_ingested_total", "a", "error_crawl", 30 * i, 100 * i) for i in range(21)]
    rows += [("articles_ingested_total", "b", "error_crawl", 30 * i, 1) for i in range(21)]       # flat
    rows += [("articles_ingested_total", "a", "success", 30 * i, 1000 * i) for i in range(21)]    # not matched
    iv = SR.evaluate_rule(_samples(spark, rows), SR.ALERT_PRESETS["HighErrorRate"], ["metric", "source", "status"])
    got = iv.collect()
    assert [r.source for r in got] == ["a"] and got[0].status == "error_crawl"
    assert got[0].fire_us is not None and got[0].fire_us - got[0].start_us >= 120 * 1_000_000


def test_gauge_rule_open_breaker(spark):
    rows = [("circuit_breaker_state", "a", "", 30 * i, 2 if 2 <= i <= 9 else 0) for i in range(16)]
    rows += [("circuit_breaker_state", "b", "", 30 * i, 2 if i == 3 else 0) for i in range(16)]   # too short
    iv = SR.evaluate_rule(_samples(spark, rows), SR.ALERT_PRESETS["CircuitBreakerOpen"], ["metric", "source"])
    got = {r.source: r for r in iv.collect()}
    assert got["a"].fire_us is not None and got["b"].fire_us is None
    assert got["a"].end_us - got["a"].start_us == 7 * 30 * 1_000_000


def test_p95_rule_from_bucket_counters(spark):
    rows = []
    for i in range(21):  # 10 observations per 30 s, all between 1 s and 20 s
        for le, v in (("1", 0), ("20", 10 * i), ("+Inf", 10 * i)):
            rows.append(("provider_fetch_duration_seconds", "a", "", 30 * i, v, le))
    rule = SR.ALERT_PRESETS["SlowProviderFetch"]
    iv = SR.evaluate_rule(_samples(spark, rows), rule, ["metric", "source"])
    got = iv.collect()
    assert len(got) == 1 and got[0].fire_us is not None


def test_histogram_quantile_edges(spark):
    h = spark.createDataFrame([("a", 1.0, 0), ("a", 2.0, 0), ("a", float("inf"), 0),
                               ("b", 1.0, 1), ("b", 2.0, 1), ("b", float("inf"), 4)],
                              "k string, le_value double, cumulative_count long")
    q = {r.k: r.value for r in SR.histogram_quantile(h, 0.95, ["k"]).collect()}
    assert q["a"] != q["a"]          # NaN when there are no observations
    assert q["b"] == 2.0             # rank falls in +Inf: the largest finite bound


def test_gauge_grid_carries_values_across_chunks(spark):
    rows = [("g", "a", "", 0, 5), ("g", "a", "", 3 * 86400 + 10, 7)]
    g = SR.gauge_grid(_samples(spark, rows), ["metric", "source"], 3600)
    vals = [r.value for r in g.orderBy("eval_us").collect()]
    assert len(vals) == 3 * 24 + 1 and set(vals[:-1]) == {5.0} and vals[-1] == 7.0


def test_change_point_intervals_equal_dense_grid(spark):
    import random
    rnd = random.Random(5)
    rows = []
    for src in ("a", "b", "c"):
        t, v = 0, 0
        for _ in range(60):
            t += rnd.choice([5, 20, 30, 90, 400, 1300])
            v = 0 if rnd.random() < 0.05 else v + rnd.choice([0, 1, 1, 3])
            rows.append(("articles_ingested_total", src, "success", t, v))
    s = _samples(spark, rows)
    keys = ["metric", "source", "status"]
    for op, thr in ((">", 0.004), ("==", 0.0)):
        dense = SR.alert_intervals(SR.evaluation_grid(s, keys, 30, 300), keys,
                                   SR.compare(F.col("rate"), op, thr), 120)
        sparse = SR.rate_alert_intervals(s, keys, 30, 300, op, thr, 120)
        cols = [*keys, "start_us", "end_us", "fire_us"]
        a, b = sorted(map(tuple, dense.select(*cols).collect())), sorted(map(tuple, sparse.select(*cols).collect()))
        assert a == b and len(a) > 0, (op, len(a), len(b))


def test_histogram_then_quantile_exact(spark):
    from articleflow.operators import metrics as M
    df = spark.createDataFrame([("a", float(v)) for v in (0.5, 1.5, 1.5, 3.0, 9.0)], "k string, v double")
    h = M.histogram(df, "v", (1, 2, 4), ["k"])
    cum = {r.le: r.cumulative_count for r in h.collect()}
    assert cum == {"1": 1, "2": 3, "4": 4, "+Inf": 5}
    q = {r.q: r.value for r in SR.histogram_quantile(h, 0.5, ["k"]).unionByName(
        SR.histogram_quantile(h, 0.9, ["k"])).collect()}
    assert abs(q[0.5] - (1 + (2.5 - 1) / 2 * 1)) < 1e-9     # rank 2.5 inside (1, 2]: 1.75
    assert q[0.9] == 4.0                                      # rank 4.5 falls in +Inf: largest finite bound


def test_firing_now_and_latest_value(spark):
    ev = spark.createDataFrame([("a", 1, True), ("a", 2, True), ("a", 3, True), ("b", 1, True), ("b", 2, False),
                                ("b", 3, False)], "source string, eval_us long, c boolean")
    iv = SR.alert_intervals(ev, ["source"], F.col("c"), 0)
    assert [r.source for r in SR.firing_now(iv, ev, ["source"]).collect()] == ["a"]
    rows = [("g", "a", "", 0, 1), ("g", "a", "", 100, 2), ("g", "a", "", 5000, 3)]
    v = SR.latest_value(_samples(spark, rows), ["metric", "source"], T0 + dt.timedelta(seconds=200), lookback_s=300)
    assert v.first().value == 2.0
    v2 = SR.latest_value(_samples(spark, rows), ["metric", "source"], T0 + dt.timedelta(seconds=4000), lookback_s=300)
    assert v2.count() == 0                                  # stale: no sample in the lookback window


def test_null_labels_and_silent_series(spark):
    """A NULL label counts like any other, and a series that stops is
    evaluated to the end of the others."""
    rows = [("articles_ingested_total", s, None, 30 * i, i) for s in ("a", "b") for i in range(80 if s == "a" else 10)]
    df = _samples(spark, rows)
    key = ["metric", "source", "status"]
    inc = SR.counter_increase(df, key, 300).groupBy("source").max("increase").collect()
    assert all(r[1] > 0 for r in inc)
    grid = SR.evaluation_grid(df, key, 30, 300)
    ends = {r["source"]: r[1] for r in grid.groupBy("source").max("eval_us").collect()}
    assert ends["a"] == ends["b"]
    iv = SR.evaluate_rule(df, SR.ALERT_PRESETS["NoArticlesProcessed"], key)
    assert [r.source for r in iv.where("fire_us is not null").collect()] == ["b"]


def test_ties_do_not_count_as_resets(spark):
    rows = [("m", "a", "", 0, 1), ("m", "a", "", 30, 3), ("m", "a", "", 30, 2), ("m", "a", "", 60, 4)]
    for r in (rows, rows[::-1]):
        total = SR.counter_deltas(_samples(spark, r), ["metric", "source"]).groupBy().sum("delta").first()[0]
        assert total == 3


def test_empty_windows_never_fire_a_quantile_rule(spark):
    """After the last fast observation every window is empty (NaN): silence is not slowness."""
    rows = [("provider_fetch_duration_seconds", "a", "", 30 * i, v, le) for i in range(60)
            for le, v in (("1", min(i, 5)), ("20", min(i, 5)), ("+Inf", min(i, 5)))]
    iv = SR.evaluate_rule(_samples(spark, rows), SR.ALERT_PRESETS["SlowProviderFetch"], ["metric", "source"])
    assert iv.count() == 0


def test_gauge_change_points_equal_dense_grid(spark):
    import random
    rnd = random.Random(7)
    rows = []
    for src in ("a", "b", None):
        t = 0
        for _ in range(80):
            t += rnd.choice([0, 5, 20, 30, 90, 400, 9000])
            rows.append(("circuit_breaker_state", src, "", t, rnd.choice([0, 1, 2, 2])))
    s = _samples(spark, rows)
    keys, cols = ["metric", "source"], ["source", "start_us", "end_us", "fire_us"]
    for end_us in (None, int(T0.replace(tzinfo=dt.timezone.utc).timestamp()) * 1_000_000 + 20_000 * 1_000_000):
        dense = SR.alert_intervals(SR.gauge_grid(s, keys, 30, end_us=end_us), keys, F.col("value") == 2, 120)
        sparse = SR.gauge_alert_intervals(s, keys, 30, "==", 2.0, 120, end_us=end_us)
        a, b = (sorted(map(repr, x.select(*cols).collect())) for x in (dense, sparse))
        assert a == b and a


def test_sum_increase_of_a_window(spark):
    rows = [("m", "a", "x", t, v) for t, v in ((0, 1), (100, 5), (200, 9), (300, 2))] + [("m", "b", "y", 0, 7)]
    at = T0 + dt.timedelta(seconds=300)
    out = {r.status: (r.increase, r.rate) for r in SR.sum_increase(
        _samples(spark, rows), ["metric", "source", "status"], at, 150, by=["status"]).collect()}
    assert out == {"x": (6.0, 6.0 / 150), "y": (0.0, 0.0)}
