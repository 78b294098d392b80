"""Registered queries: one per inventory item, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver tables (or data Spark derives from them) in
full.  Output columns are flat and typed so an SQL engine can produce the
same rows: timestamps as epoch microseconds, tag arrays as text, doubles
rounded to 6 places.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.functions import epoch_us
from articleflow.operators import changes as C
from articleflow.operators import metrics as M
from articleflow.operators import parse as P
from articleflow.operators import retention as RT
from articleflow.operators import series as SR
from articleflow.operators import store as ST
from articleflow.operators import streaks as SK
from articleflow.plans import fixtures as FX
from articleflow.session import read_if_written, scratch_path
from articleflow.sources import changelog as CL
from articleflow.sources import logs as LG
from articleflow.sources import pages as PG
from articleflow.sources import registry as RG
from articleflow.streaming import ingest as IN
from articleflow.streaming import sampler as SM

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


def tags_text(c: str = "tags") -> Column:
    return F.array_join(F.transform(F.col(c), lambda t: F.concat(t["id"].cast("string"), F.lit(":"), t["label"])), ",")


def flat_articles(df: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Article rows with comparable scalar columns."""
    cols = list(extra or [])
    for f in S.ARTICLE.fields:
        if f.name not in df.columns:
            continue
        if f.name == "tags":
            cols.append(tags_text().alias("tags_text"))
        elif f.name.endswith("_at"):
            cols.append(epoch_us(f.name).alias(f.name.replace("_at", "_us")))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# ----------------------------------------------------------------- shared plans
def parsed_run(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Raw document pages of one crawl -> articles (B1)."""
    return P.parse_pulselive(FX.document_pages(spark, sf_dir, run))


def unique_hashed(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """B1 with E1 fused into the page projection -> B7: unique, hashed page
    rows of one crawl, without any shuffle."""
    return C.with_content_hash(P.parse_pulselive(FX.document_pages(spark, sf_dir, run), dedup=True))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1 -> E1 -> B7 -> C1 -> C2 against the stored state."""
    batch = unique_hashed(spark, sf_dir, 0)
    store = FX.stored_articles(spark, sf_dir)
    return C.classify_changes(batch, C.lookup_hashes(store, batch))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The minimum slice end to end: changes per feed and class."""
    return (classified(spark, sf_dir).groupBy("feed", "change")
            .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------ parsing
@query("b1_parse_pulselive")
def q_b1(spark, sf_dir):
    return flat_articles(parsed_run(spark, sf_dir, 0), ["feed", "run_id", "page_no", "pos"])


@query("b2_parse_items")
def q_b2(spark, sf_dir):
    arts = P.parse_items(FX.conversation_pages(spark, sf_dir))
    return flat_articles(arts, ["feed", "run_id", "page_no", "pos"]).withColumn(
        "tags_is_null", F.col("tags_text").isNull()).drop("tags_text")


@query("b3_page_info")
def q_b3(spark, sf_dir):
    raw = FX.document_pages(spark, sf_dir, 0).unionByName(FX.document_pages(spark, sf_dir, 1))
    return P.page_info(raw, P.PULSELIVE).drop("bad")


@query("b4_parse_pages")
def q_b4(spark, sf_dir):
    """The registry lacks two feeds and some pages carry no feed: these come
    back as rejected pages (without an id)."""
    raw = FX.stray_pages(FX.document_pages(spark, sf_dir, 0)).unionByName(FX.conversation_pages(spark, sf_dir))
    registry = FX.registry_from_documents(spark, sf_dir).where(~F.col("name").isin(*FX.UNKNOWN_FEEDS))
    arts = P.parse_pages(raw, registry).select("feed", "run_id", "page_no", "pos", "id", "source", "title",
                                               epoch_us("published_at").alias("published_us"), F.lit("").alias("rejected"))
    bad = P.rejected_pages(raw, registry).select("feed", "run_id", "page_no", F.col("reason").alias("rejected"))
    return arts.unionByName(bad, allowMissingColumns=True)


@query("b5_split_bad_pages")
def q_b5(spark, sf_dir):
    raw = FX.damaged_pages(FX.document_pages(spark, sf_dir, 0))
    good, bad = P.split_bad_pages(raw, P.PULSELIVE)
    return (good.select(*S.PAGE_KEY, F.lit(False).alias("bad"))
                .unionByName(bad.select(*S.PAGE_KEY, F.lit(True).alias("bad"))))


@query("b6_conform")
def q_b6(spark, sf_dir):
    d = FX.table(spark, sf_dir, "documents")
    partial = d.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"),
                       F.col("source"), F.col("text").alias("body"),
                       F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"),
                       F.col("n_chars").alias("external_id"))
    return flat_articles(P.conform(partial)).withColumn("tags_is_null", F.col("tags_text").isNull()).drop("tags_text")


@query("b7_content_hash")
def q_b7(spark, sf_dir):
    return unique_hashed(spark, sf_dir, 0).select("feed", "page_no", "id", "content_hash")


# ---------------------------------------------------------- changes (E1, C*)
@query("e1_dedup_batch")
def q_e1(spark, sf_dir):
    return C.dedup_batch(parsed_run(spark, sf_dir, 0)).select("feed", "run_id", "page_no", "pos", "id", "title")


@query("c1_lookup_hashes")
def q_c1(spark, sf_dir):
    batch = unique_hashed(spark, sf_dir, 0)
    return C.lookup_hashes(FX.stored_articles(spark, sf_dir), batch)


@query("c2_classify_changes")
def q_c2(spark, sf_dir):
    return classified(spark, sf_dir).select("feed", "page_no", "id", "content_hash", "change")


@query("c2_change_counts")
def q_c2_counts(spark, sf_dir):
    return flagship(spark, sf_dir)


@query("c3_change_feed")
def q_c3(spark, sf_dir):
    pages = unique_hashed(spark, sf_dir, 0).unionByName(unique_hashed(spark, sf_dir, 1))
    feed = C.change_feed(pages, FX.stored_articles(spark, sf_dir))
    return feed.select("feed", "run_id", "page_no", "id", "content_hash", "change")


@query("a9_upsert_articles")
def q_a9(spark, sf_dir):
    store = FX.stored_articles(spark, sf_dir)
    batch = unique_hashed(spark, sf_dir, 1)  # one page per id in a crawl of all documents
    return flat_articles(ST.upsert_articles(store, batch)).select(
        "id", "title", "content_hash", "tags_text", "published_us")


@query("c3_state_after")
def q_c3_state(spark, sf_dir):
    pages = unique_hashed(spark, sf_dir, 0).unionByName(unique_hashed(spark, sf_dir, 1))
    state = C.state_after(pages, FX.stored_articles(spark, sf_dir))
    return flat_articles(state).select("id", "title", "content_hash", "tags_text")


@query("f1_last_published")
def q_f1(spark, sf_dir):
    store = ST.upsert_articles(
        FX.stored_articles(spark, sf_dir),
        C.with_content_hash(P.parse_items(FX.conversation_pages(spark, sf_dir), dedup=True)).drop(
            "feed", "run_id", "page_no", "pos"))
    return flat_articles(ST.last_published(store)).select("source", "id", "published_us")


@query("f1_last_published_source")
def q_f1_source(spark, sf_dir):
    chat = C.with_content_hash(P.parse_items(FX.conversation_pages(spark, sf_dir), dedup=True))
    store = FX.stored_articles(spark, sf_dir).unionByName(chat.select(*S.ARTICLE_COLS))
    return flat_articles(ST.last_published(store, "dummy")).select("source", "id", "published_us")


@query("f1_last_published_by_type")
def q_f1_type(spark, sf_dir):
    store = FX.stored_articles(spark, sf_dir)
    return flat_articles(ST.last_published(store, by="type")).select("type", "id", "published_us")


# ------------------------------------------------------- change log
def emitted_changes(spark, sf_dir) -> DataFrame:
    return classified(spark, sf_dir).filter(F.col("change") != C.UNCHANGED)


@query("a6_change_events")
def q_a6(spark, sf_dir):
    return CL.to_change_events(emitted_changes(spark, sf_dir))


@query("a7_read_changes")
def q_a7(spark, sf_dir):
    ev = FX.with_damaged_messages(CL.to_change_events(emitted_changes(spark, sf_dir)))
    return flat_articles(CL.read_changes(ev), ["key"]).select(
        "key", "id", "title", "content_hash", "tags_text", "published_us", "updated_us", "fetched_us")


def sync_outcome() -> Column:
    """Downstream outcome used by the fixtures: bodies whose length is a
    multiple of 7 fail to sync."""
    return F.length("body") % 7 != 0


@query("a8_sync_and_route")
def q_a8(spark, sf_dir):
    arts = CL.read_changes(CL.to_change_events(emitted_changes(spark, sf_dir)))
    synced, dead = CL.sync_and_route(arts, sync_outcome())
    return (synced.select(F.col("id").alias("key"), F.lit("synced").alias("route"))
                  .unionByName(dead.select("key", F.lit("dead_letter").alias("route"))))


# -------------------------------------------------------- sources (A1-A3, A5, A10)


@query("a1_load_sources")
def q_a1(spark, sf_dir):
    out = RG.parse_sources(FX.registry_files(spark, sf_dir))
    return out.select("file_no", "pos", "name", "url", "transformer", "valid", "reject_reason")


@query("a2_plan_pages")
def q_a2(spark, sf_dir):
    src = FX.source_entries(spark, sf_dir).withColumn("name", F.concat(F.lit("p"), F.col("page_id").cast("string")))
    src = src.select("name", "url", "pagination", (F.col("page_id") % 7).alias("n_pages"))
    return RG.plan_pages(src, F.col("n_pages")).select("name", "page_no", "request_url")


@query("a3_scan_raw_pages")
def q_a3(spark, sf_dir):
    from articleflow.session import scratch_path
    path = scratch_path(spark, "landed-pages")
    PG.land_pages(FX.document_pages(spark, sf_dir, 0), path)
    arts = P.parse_pulselive(PG.scan_raw_pages(spark, path))
    return arts.select("feed", "run_id", "page_no", "pos", "id")


@query("a5_walk_pages")
def q_a5(spark, sf_dir):
    walked = PG.walk_pages(FX.fetch_log(spark, sf_dir))
    return walked.select("feed", "run_id", "page_no", "known_pages", "streak", "reached", "outcome")


@query("a10_ingest_logs")
def q_a10(spark, sf_dir):
    from pyspark.sql import types as T
    ev = FX.table(spark, sf_dir, "events")
    lines = ev.select("event_id", F.col("user_id").alias("k"),
                      F.when(F.col("event_id") % 17 == 0, F.concat(F.lit("not json "), F.col("props")))
                       .otherwise(F.col("props")).alias("message"))
    out = LG.ingest_logs(lines, T.StructType([T.StructField("k", T.LongType())]), "message",
                         {"environment": "local", "application": "articleflow"})
    return out.select("event_id", "k", "error", "environment", "application")


@query("a10_ingest_objects")
def q_a10_objects(spark, sf_dir):
    """Every key of every record: undeclared keys, explicit nulls over a
    column, objects, the time field, lines that do not decode."""
    lines = FX.object_lines(spark, sf_dir)
    out = LG.ingest_objects(lines, "message", {"environment": "local"})
    each = out.select("event_id", epoch_us("ts").alias("ts_us"), F.explode("record").alias("key", "value"))
    return each.where("key <> 'message'").select("event_id", "ts_us", "key", F.to_json("value").alias("value"))


# ----------------------------------------------------- streaks & sampling
def by_hour(ev: DataFrame) -> DataFrame:
    """``events`` plus ``hour``, the chunk of the skew-split windows: a key's
    rows of an hour are one window partition."""
    return ev.withColumn("hour", F.floor(epoch_us("ts") / F.lit(3_600_000_000)).cast("long"))


@query("e2_sample_nth")
def q_e2(spark, sf_dir):
    ev = by_hour(FX.table(spark, sf_dir, "events")).withColumn("reset", F.col("value") < 0.5)
    s = SK.sample_nth(ev, "event_type", ["ts", "event_id"], 10, reset="reset", chunk="hour")
    return s.select("event_id", "event_type", "epoch", "occurrence", "emit")


@query("e2_sample_counts")
def q_e2_counts(spark, sf_dir):
    ev = by_hour(FX.table(spark, sf_dir, "events")).withColumn("reset", F.col("value") < 0.5)
    return SK.sample_counts(SK.sample_nth(ev, "event_type", ["ts", "event_id"], 10, reset="reset", chunk="hour"),
                            "event_type")


@query("e2_reset_all")
def q_e2_all(spark, sf_dir):
    """Purchases above 400 restart every key."""
    ev = by_hour(FX.table(spark, sf_dir, "events")).withColumn(
        "all", (F.col("event_type") == "purchase") & (F.col("value") > 400))
    s = SK.sample_nth(ev, "event_type", ["ts", "event_id"], 10, reset_all="all", chunk="hour")
    return s.select("event_id", "event_type", "epoch_all", "occurrence", "emit")


@query("e3_failure_streaks")
def q_e3(spark, sf_dir):
    ev = by_hour(FX.table(spark, sf_dir, "events"))
    s = SK.failure_streaks(ev, ["user_id"], ["ts", "event_id"], F.col("event_type") == "error", 3, chunk="hour")
    return s.select("event_id", "user_id", "streak", "tripped")


# ------------------------------------------------------ counters

HIST_BOUNDS = (1, 2.5, 5, 10, 25, 50, 100, 250)
SERIES = ["metric", "source", "status"]
EVAL_AT = "2024-01-20 00:00:00"


def r6(c: str) -> Column:
    return F.round(F.col(c), 6).alias(c)


@query("d1_ingest_counters")
def q_d1(spark, sf_dir):
    runs = PG.run_status(PG.walk_pages(FX.fetch_log(spark, sf_dir)))
    return M.ingest_counters(classified(spark, sf_dir), runs)


@query("d2_duplicate_counters")
def q_d2(spark, sf_dir):
    return M.duplicate_counters(classified(spark, sf_dir))


@query("d3_publish_counters")
def q_d3(spark, sf_dir):
    return M.publish_counters(classified(spark, sf_dir), F.col("page_no") % 7 != 3)


@query("d4_sync_counters")
def q_d4(spark, sf_dir):
    chat = C.with_content_hash(P.parse_items(FX.conversation_pages(spark, sf_dir), dedup=True))
    arts = CL.read_changes(CL.to_change_events(emitted_changes(spark, sf_dir).select(*S.ARTICLE_COLS)
                                               .unionByName(chat.select(*S.ARTICLE_COLS))))
    return M.sync_counters(CL.route(arts, sync_outcome()))


@query("d5_parse_error_counters")
def q_d5(spark, sf_dir):
    _, bad = P.split_bad_pages(FX.damaged_pages(FX.document_pages(spark, sf_dir, 0)), P.PULSELIVE)
    return M.parse_error_counters(bad)


def value_histogram(spark, sf_dir):
    return M.histogram(FX.table(spark, sf_dir, "events"), "value", HIST_BOUNDS, ["event_type"])


@query("d6_histogram")
def q_d6(spark, sf_dir):
    return value_histogram(spark, sf_dir).select("event_type", "le", "cumulative_count", r6("sum"), "count")


@query("d7_freshness")
def q_d7(spark, sf_dir):
    f = M.freshness(FX.order_articles(spark, sf_dir))
    h = M.histogram(f, "freshness_s", M.FRESHNESS_BOUNDS, ["feed"])
    return h.select("feed", "le", "cumulative_count", r6("sum"), "count")


@query("d8_histogram_quantile")
def q_d8(spark, sf_dir):
    h = value_histogram(spark, sf_dir)
    out = SR.histogram_quantile(h, 0.5, ["event_type"]).unionByName(SR.histogram_quantile(h, 0.95, ["event_type"]))
    return out.select("event_type", "q", r6("value"))


@query("d9_sum_by_status")
def q_d9(spark, sf_dir):
    return SR.sum_counter(FX.counter_samples(spark, sf_dir), SERIES, EVAL_AT, by=["status"]).select("status", r6("value"))


@query("d9_sum_total")
def q_d9_total(spark, sf_dir):
    return SR.sum_counter(FX.counter_samples(spark, sf_dir), SERIES, EVAL_AT).select(r6("value"))


@query("d9_increase_by_status")
def q_d9_increase(spark, sf_dir):
    out = SR.sum_increase(FX.counter_samples(spark, sf_dir), SERIES, EVAL_AT, 3600, by=["status"])
    return out.select("status", r6("increase"), F.round(F.col("rate") * 60, 6).alias("per_minute"))


@query("d8_rate_quantile")
def q_d8_rate(spark, sf_dir):
    """Windows with an observation only."""
    s = FX.duration_samples(spark, sf_dir, HIST_BOUNDS)
    rates = SR.evaluation_grid(s, ["source", "le"], 3600, 10800).withColumn(
        "le_value", SR.bucket_bound(F.col("le"))).withColumn("cumulative_count", F.col("rate"))
    out = SR.histogram_quantile(rates, [0.5, 0.95], ["source", "eval_us"])
    return out.where(~F.isnan("value")).select("source", "eval_us", "q", r6("value"))


# ------------------------------------------------------ series
@query("e4_counter_rate")
def q_e4(spark, sf_dir):
    inc = SR.counter_increase(FX.counter_samples(spark, sf_dir), SERIES, 3600)
    return inc.select("source", "status", "ts_us", r6("increase"), r6("rate"))


@query("e5_latest_value")
def q_e5(spark, sf_dir):
    from articleflow.functions import BREAKER_STATE_TEXT, code_text
    v = SR.latest_value(FX.gauge_samples(spark, sf_dir), ["metric", "source"], EVAL_AT, lookback_s=86400)
    return v.select("source", "value", code_text("value", BREAKER_STATE_TEXT).alias("state"), "ts_us")


def error_grid(spark, sf_dir):
    s = SR.select_series(FX.counter_samples(spark, sf_dir), "articles_ingested_total", status="~error.*")
    return SR.evaluation_grid(s, SERIES, 3600, 10800)


@query("e4_null_labels")
def q_e4_null(spark, sf_dir):
    """The status label is absent on successes, and each sample comes twice
    (equal times)."""
    s = FX.counter_samples(spark, sf_dir).withColumn("status", F.when(F.col("status") != "success", F.col("status")))
    inc = SR.counter_increase(s.unionByName(s.withColumn("value", F.col("value") + 0.5)), SERIES, 3600)
    return inc.groupBy("source", "status").agg(F.round(F.sum("delta"), 6).alias("total"), F.count(F.lit(1)).alias("n"))


@query("e7_evaluation_grid")
def q_e7(spark, sf_dir):
    return error_grid(spark, sf_dir).select("source", "status", "eval_us", r6("increase"), r6("rate"))


@query("e6_alert_intervals")
def q_e6(spark, sf_dir):
    iv = SR.alert_intervals(error_grid(spark, sf_dir), SERIES, F.col("increase") >= 1, 7200)
    return iv.select("source", "status", "start_us", "end_us", "fire_us")


@query("e6_alert_intervals_sparse")
def q_e6_sparse(spark, sf_dir):
    s = SR.select_series(FX.counter_samples(spark, sf_dir), "articles_ingested_total", status="~error.*")
    iv = SR.rate_alert_intervals(s, SERIES, 3600, 10800, ">=", 1.0, 7200, measure="increase")
    return iv.select("source", "status", "start_us", "end_us", "fire_us")


def rule_samples(spark, sf_dir, rule) -> tuple[DataFrame, list[str]]:
    """Samples and series of a rule's metric; an ingest counts for 60, so that
    rates reach the rule's threshold."""
    if rule.metric == "up":
        return FX.up_samples(spark, sf_dir), ["metric", "job", "source"]
    if rule.metric == "circuit_breaker_state":
        return FX.gauge_samples(spark, sf_dir), ["metric", "source"]
    if rule.metric == "provider_fetch_duration_seconds":
        return FX.duration_samples(spark, sf_dir, HIST_BOUNDS), ["metric", "source"]
    return FX.counter_samples(spark, sf_dir).withColumn("value", F.col("value") * 60), SERIES


@query("e6_rules")
def q_e6_rules(spark, sf_dir):
    """The six alert rules at their own step: intervals per rule and series."""
    out = None
    for rule in [*SR.ALERT_PRESETS.values(), SR.service_down("crawler")]:
        samples, series = rule_samples(spark, sf_dir, rule)
        iv = SR.evaluate_rule(samples, rule, series)
        status = F.col("status") if "status" in series else F.lit("")
        iv = iv.select(F.lit(rule.name).alias("rule"), "source", status.alias("status"), "start_us", "end_us", "fire_us")
        out = iv if out is None else out.unionByName(iv)
    return out


# ------------------------------------------------------ retention
@query("i1_age_tier")
def q_i1(spark, sf_dir):
    li = FX.table(spark, sf_dir, "lineitem")
    return RT.age_tier(li, "l_shipdate", "1999-01-01 00:00:00").select("l_orderkey", "l_linenumber", "tier")


@query("i1_expire_samples")
def q_i1_expire(spark, sf_dir):
    return RT.expire(FX.table(spark, sf_dir, "events"), "ts", "2024-01-31 00:00:00").select("event_id")


@query("i1_expire_days")
def q_i1_days(spark, sf_dir):
    """``events`` landed by day, expired days removed, the rest read back."""
    path, now = scratch_path(spark, "events-by-day"), datetime(2024, 1, 24)
    RT.land_by_day(FX.table(spark, sf_dir, "events").select("event_id", "ts"), "ts", path)
    RT.drop_expired(spark, path, now)
    return spark.read.parquet(path).select("event_id", F.col("day").cast("string").alias("day"))


@query("i1_tier_days")
def q_i1_tier_days(spark, sf_dir):
    """``events`` landed by day in the hot table, aged twice."""
    roots = {t: scratch_path(spark, f"tier-{t}") for t in ("hot", "warm", "cold")}
    RT.land_by_day(FX.table(spark, sf_dir, "events").select("event_id", "ts"), "ts", roots["hot"])
    for now in (datetime(2024, 1, 20), datetime(2024, 2, 5)):
        RT.move_tiers(spark, roots, now)
    parts = [read_if_written(spark, p) for p in roots.values()]
    parts = [d.select("event_id", F.lit(t).alias("tier")) for t, d in zip(roots, parts) if d is not None]
    return reduce(DataFrame.unionByName, parts)


# ------------------------------------------------------ streaming (A4, H1-H4)


CRAWLED_AT = "2024-01-15 12:00:00"


def _crawls(spark, sf_dir, docs: DataFrame | None = None) -> list[DataFrame]:
    """Raw pages of two crawls of the document feeds, the chat feed with the
    second; each is landed and drained before the next."""
    crawls = [FX.document_pages(spark, sf_dir, 0, docs),
              FX.document_pages(spark, sf_dir, 1, docs).unionByName(FX.conversation_pages(spark, sf_dir))]
    return [c.withColumn("fetched_at", F.lit(CRAWLED_AT).cast("timestamp")) for c in crawls]


def _ingest(spark, sf_dir, metrics: str | None = None) -> str:
    landing, checkpoint = scratch_path(spark, "landing"), scratch_path(spark, "ckpt-ingest")
    registry = FX.registry_from_documents(spark, sf_dir)
    store = ST.ArticleStore(spark, scratch_path(spark, "store"), 8)
    changes = scratch_path(spark, "changes")
    docs = FX.documents_by_page(spark, sf_dir).persist()     # both crawls are made of them: shuffled once
    try:
        for raw in _crawls(spark, sf_dir, docs):
            IN.land_raw_pages(raw, landing)
            IN.run_ingest(IN.stream_raw_pages(spark, landing), registry, store, changes, checkpoint=checkpoint,
                          available_now=True, metrics_path=metrics).awaitTermination()
    finally:
        docs.unpersist()
    return changes


@query("a4_stream_raw_pages")
def q_a4(spark, sf_dir):
    landing, out, checkpoint = (scratch_path(spark, x) for x in ("landing", "a4-out", "ckpt-a4"))
    for raw in _crawls(spark, sf_dir):
        IN.land_raw_pages(raw, landing)
        (IN.stream_raw_pages(spark, landing).select(*S.PAGE_KEY)
           .writeStream.format("parquet").option("checkpointLocation", checkpoint)
           .trigger(availableNow=True).start(out).awaitTermination())
    return spark.read.parquet(out)


@query("h1_run_ingest")
def q_h1(spark, sf_dir):
    ev = spark.read.parquet(_ingest(spark, sf_dir))
    return ev.select("key", "feed", "run_id", "page_no",
                     F.get_json_object("value", "$.content_hash").alias("content_hash"))


@query("h1_ingest_counters")
def q_h1_counters(spark, sf_dir):
    metrics = scratch_path(spark, "metrics")
    _ingest(spark, sf_dir, metrics)
    return (spark.read.parquet(metrics).groupBy("metric", "source", "status", "le")
                 .agg(F.round(F.sum("value"), 3).alias("value")))


@query("h1_walk_counters")
def q_h1_walk(spark, sf_dir):
    """One crawl whose runs are cut over three micro-batches, with damaged and
    empty pages and a handler that fails some pages, up to six in a row."""
    docs = FX.documents_by_page(spark, sf_dir).persist()     # all three parts are made of them: shuffled once
    raw = FX.walked_pages(FX.document_pages(spark, sf_dir, 0, docs)).withColumn("fetched_at", F.lit(CRAWLED_AT).cast("timestamp"))
    landing, metrics, changes, checkpoint = (scratch_path(spark, x) for x in ("landing", "metrics", "changes", "ckpt-walk"))
    store = ST.ArticleStore(spark, scratch_path(spark, "store"), 8)
    pages = docs.select((F.max("page_no") + 1)).scalar()
    try:
        for part in range(3):
            IN.land_raw_pages(raw.where(F.floor(F.col("page_no") * 3 / pages) == part), landing)
            IN.run_ingest(IN.stream_raw_pages(spark, landing), FX.registry_from_documents(spark, sf_dir), store, changes,
                          checkpoint=checkpoint, available_now=True, metrics_path=metrics, walk=True,
                          handler=lambda p, _: p.where(FX.handler_fails()).select(*S.PAGE_KEY)).awaitTermination()
    finally:
        docs.unpersist()
    kinds = ["articles_ingested_total", "articles_published_total", "article_parse_errors_total"]
    return (spark.read.parquet(metrics).where(F.col("metric").isin(*kinds)).groupBy("metric", "source", "status")
                 .agg(F.sum("value").alias("value")).where("value > 0"))


@query("h3_run_sync")
def q_h3(spark, sf_dir):
    changes = _ingest(spark, sf_dir)
    synced, dead = scratch_path(spark, "synced"), scratch_path(spark, "dead")
    q = IN.run_sync(spark, changes, synced, dead, sync_outcome(), checkpoint=scratch_path(spark, "ckpt-sync"),
                    available_now=True)
    q.awaitTermination()
    return (spark.read.parquet(synced).select(F.col("id").alias("key"), F.lit("synced").alias("route"))
            .unionByName(spark.read.parquet(dead).select("key", F.lit("dead_letter").alias("route"))))


@query("h3_counters")
def q_h3_counters(spark, sf_dir):
    metrics = scratch_path(spark, "sync-metrics")
    IN.run_sync(spark, _ingest(spark, sf_dir), scratch_path(spark, "synced"), scratch_path(spark, "dead"),
                sync_outcome(), checkpoint=scratch_path(spark, "ckpt-sync"), available_now=True,
                metrics_path=metrics).awaitTermination()
    return spark.read.parquet(metrics).groupBy("metric", "source").agg(F.sum("value").alias("value"))


@query("h4_sample_nth_stream")
def q_h4(spark, sf_dir):
    """``events`` land week by week, oldest first, each drained on landing;
    rows without a time come before all others.  From the third week on
    another checkpoint (and landing folder) goes on over the same outputs."""
    ev = by_hour(FX.table(spark, sf_dir, "events")).select(
        F.col("event_type").alias("key"), F.col("event_id").alias("id"), epoch_us("ts").alias("order"),
        (F.col("value") < 0.5).alias("reset"), F.col("hour").alias("chunk"))
    first, last = ev.select(F.min("chunk"), F.max("chunk")).first()
    out, counts = scratch_path(spark, "sampler"), scratch_path(spark, "counts")
    stages = [(scratch_path(spark, "sample-rows"), scratch_path(spark, "ckpt-h4")) for _ in range(2)]
    week = 7 * 24
    for i, lo in enumerate(range(first or 0, (last or 0) + 1, week)):
        landing, checkpoint = stages[i >= 2]
        at = F.coalesce("chunk", F.lit(first or 0))
        ev.where((at >= lo) & (at < lo + week)).write.mode("append").parquet(landing)
        SM.sample_nth_stream(spark.readStream.schema(ev.schema).parquet(landing), out, counts, checkpoint, 10,
                             available_now=True).awaitTermination()
    return spark.read.parquet(out).select(F.col("id").alias("event_id"), F.col("key").alias("event_type"),
                                          "occurrence", "emit")
