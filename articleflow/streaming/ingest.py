"""Continuous ingest (A4, H1) and downstream sync (H3) on Structured Streaming.

Both run the batch operators inside ``foreachBatch``; every output is written
with a dynamic-partition ``overwrite`` of its own ``batch_id`` partition, so a
micro-batch replayed after a failure recomputes and replaces the same rows
(exactly-once output on the file sinks).  Change events are written before
the store's versions, so a crash between the two writes loses no event (the
replay recomputes the same events against the same store state).
"""

from __future__ import annotations

from functools import reduce
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow import schema as S
from articleflow.operators import changes as C
from articleflow.operators import metrics as M
from articleflow.operators import parse as P
from articleflow.operators.joins import join_null_safe
from articleflow.operators.store import ArticleStore, row_hash
from articleflow.session import checkpoint_root, read_if_written
from articleflow.sources import changelog as CL
from articleflow.sources import pages as PG
from articleflow.streaming.carried import CarriedState, overwrite_partition

CHANGE_EVENT_COLS = ["key", "value", "feed", "run_id", "page_no"]
# A change-events sink: called once per micro-batch with the events and the
# batch id; it must be idempotent per batch id (a replay calls it again).  It
# may return the pages (feed, run_id, page_no) it could not publish; they are
# counted and the ingest goes on.  If it raises, the batch is run again.
Sink = Callable[[DataFrame, int], DataFrame | None]
# A page handler: called once per micro-batch with the decoded pages that the
# walk would reach; returns the pages (feed, run_id, page_no) it could not
# process.  The same rules hold as for a sink.
Handler = Callable[[DataFrame, int], DataFrame | None]


def parquet_sink(path: str) -> Sink:
    """Default sink: dynamic-partition overwrite of ``batch_id=N`` under ``path``."""
    return lambda events, batch_id: overwrite_partition(events, batch_id, path)


def land_raw_pages(raw: DataFrame, path: str) -> None:
    """Append raw pages to the landing table the ingest stream reads."""
    raw.select(*[f.name for f in S.RAW_PAGES.fields]).write.mode("append").option("compression", "zstd").parquet(path)


def stream_raw_pages(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """A4: the landing table as a stream (fixed schema, never inferred).
    ``max_files_per_trigger`` bounds each micro-batch (back-pressure)."""
    r = spark.readStream.schema(S.RAW_PAGES)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.parquet(path)


def walk_inputs(decoded: DataFrame) -> DataFrame:
    """The narrow rows the walk reads of decoded pages; a bad page is the
    run's fetch/decode error."""
    return decoded.select(*S.PAGE_KEY, F.col("bad").alias("fetch_error"), F.col("page_info.numPages").alias("num_pages"),
                          F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_articles"))


def walk_batch(inputs: DataFrame, failed_pages: DataFrame | None = None, state: DataFrame | None = None) -> DataFrame:
    """A5 over the pages of a micro-batch (narrow rows, see
    :func:`walk_inputs`); ``failed_pages`` are those whose handler failed,
    ``state`` is what earlier micro-batches of the same runs left."""
    if failed_pages is None:
        flagged = inputs.withColumn("batch_failed", F.lit(False))
    else:
        marks = failed_pages.select(*S.PAGE_KEY).distinct().withColumn("batch_failed", F.lit(True))
        flagged = join_null_safe(inputs, marks, S.PAGE_KEY, "left")
    return PG.walk_pages(flagged, state=state, carry=True)


def _long(df: DataFrame, key: str, metric: str, value: str, status: str = "", le: str = "''") -> DataFrame:
    """Rows ``(metric, source, status, le, value)``."""
    return df.select(F.lit(metric).alias("metric"), F.col(key).alias("source"), F.lit(status).alias("status"),
                     F.expr(le).alias("le"), F.col(value).cast("double").alias("value"))


def batch_counters(feed: DataFrame, pages: DataFrame, failed_runs: DataFrame | None = None,
                   failed_pages: DataFrame | None = None) -> DataFrame:
    """Increments of one batch in long form ``(metric, source, status, le,
    value)``, per feed: unique articles ingested (D1), duplicates skipped
    (D2), articles published and pages that could not be (D3), undecodable
    pages (D5) and the freshness histogram (D7: age when the page was
    fetched).  ``pages``: the batch's pages with ``bad`` and ``fetched_at``.

    The feed is read once: conditional aggregates by page, summed by feed,
    turned into rows at the end (the same rules as D1-D3 and D7 apply)."""
    ok = F.lit(True)
    if failed_pages is not None:
        flags = failed_pages.select(*S.PAGE_KEY).distinct().withColumn("_failed", F.lit(True))
        feed, ok = feed.join(flags, S.PAGE_KEY, "left"), F.col("_failed").isNull()
    seen = pages.groupBy(*S.PAGE_KEY).agg(F.max("fetched_at").alias("_seen"))
    rows = feed.select(*S.PAGE_KEY, "change", "published_at", ok.alias("_ok")).join(seen, S.PAGE_KEY)
    published, age = F.col("published_at").isNotNull(), M.age_s("_seen", "published_at")
    bounds = sorted(float(b) for b in M.FRESHNESS_BOUNDS)
    changed = F.count_if(F.col("change") != C.UNCHANGED)
    per_page = rows.groupBy(*S.PAGE_KEY).agg(
        F.count(F.lit(1)).alias("n"), changed.alias("changed"), F.first("_ok").alias("ok"),
        F.count_if(published).alias("dated"), F.count(age).alias("aged"), F.sum(age).alias("age"),
        *[F.count_if(age <= b).alias(f"_b{i}") for i, b in enumerate(bounds)])
    counts = per_page.groupBy("feed").agg(
        F.sum("n").alias("n"), F.sum(F.col("n") - F.col("changed")).alias("same"),
        F.sum(F.when(F.col("ok"), F.col("changed")).otherwise(0)).alias("published"),
        F.count_if(~F.col("ok") & (F.col("changed") > 0)).alias("errors"),
        *[F.sum(c).alias(c) for c in ("dated", "aged", "age", *[f"_b{i}" for i in range(len(bounds))])])

    def row(metric: str, value: str, status: str = "", le: str = "", present: str = "true"):
        return F.when(F.expr(present), F.struct(F.lit(metric).alias("metric"), F.lit(status).alias("status"),
                                                F.lit(le).alias("le"), F.col(value).cast("double").alias("value")))
    each = [row("articles_ingested_total", "n", "success"),
            row("articles_duplicates_skipped_total", "same", present="same > 0"),
            row("articles_published_total", "published"), row("publish_errors_total", "errors"),
            *[row("article_freshness_seconds_bucket", f"_b{i}", le=M.le_text(b), present="dated > 0")
              for i, b in enumerate(bounds)],
            row("article_freshness_seconds_bucket", "aged", le=M.INF, present="dated > 0"),
            row("article_freshness_seconds_sum", "age", present="dated > 0"),
            row("article_freshness_seconds_count", "aged", present="dated > 0")]
    out = (counts.select(F.col("feed").alias("source"), F.inline(F.filter(F.array(*each), lambda x: x.isNotNull())))
                 .select("metric", "source", "status", "le", "value"))
    out = out.unionByName(_long(M.parse_error_counters(pages.filter("bad")), "feed", "article_parse_errors_total",
                                "parse_errors"))
    if failed_runs is not None:
        ended = failed_runs.groupBy("feed").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(_long(ended, "feed", "articles_ingested_total", "n", "error_crawl"))
    return out


def sync_increments(routed: DataFrame) -> DataFrame:
    """D4 increments of one batch in the same long form, per article source;
    a counter appears once it has counted something."""
    c = M.sync_counters(routed)
    parts = [_long(c, "source", metric, value) for metric, value in (
        ("cms_articles_processed_total", "processed"), ("cms_sync_errors_total", "errors"),
        ("dlq_messages_published_total", "dead_lettered"))]
    return reduce(DataFrame.unionByName, parts).filter("value > 0")


def without_good_payloads(decoded: DataFrame) -> DataFrame:
    """Decoded pages whose payload is kept only where it did not decode: a
    good page's text is in its items."""
    return decoded.withColumn("payload", F.when(F.col("bad"), F.col("payload")))


def article_rows(decoded: DataFrame) -> DataFrame:
    """The unique, hashed article rows of decoded pages (E1, B7), with the
    ``row_hash`` by which the store tells versions apart."""
    return C.with_content_hash(P.explode_articles(decoded, dedup=True)).withColumn("row_hash", row_hash())


# The order in which a batch's rows apply; the last two only order a page that
# landed twice.  With the id these columns name a row, copies of a page apart.
ROW_ORDER = ["run_id", "feed", "page_no", "pos", "row_hash"]
ROW_KEY = ["id", *ROW_ORDER]


def row_marks(rows: DataFrame, feed: DataFrame, current: DataFrame) -> DataFrame:
    """What becomes of the rows of a batch, one narrow row per ``ROW_KEY`` with
    anything to do: ``n_emit``, how many of its copies are published, and
    ``n_store``, 1 if it is the last of its id and differs from the stored row
    in any field but ``fetched_at``."""
    latest = rows.groupBy("id").agg(F.max(F.struct(*ROW_ORDER)).alias("_l")).select("id", "_l.*")
    stored = latest.join(current.select("id", "row_hash"), ["id", "row_hash"], "left_anti")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    emitted = feed.filter(F.col("change") != C.UNCHANGED).select(*ROW_KEY, one.alias("n_emit"), none.alias("n_store"))
    return (emitted.unionByName(stored.select(*ROW_KEY, none.alias("n_emit"), one.alias("n_store")))
                   .groupBy(*ROW_KEY).agg(F.sum("n_emit").alias("n_emit"), F.max("n_store").alias("n_store")))


def marked_rows(articles: DataFrame, marks: DataFrame, store: ArticleStore) -> DataFrame:
    """The article rows that ``marks`` names, with ``emitted`` and ``stored``,
    dealt out by the store's buckets.

    Rows and marks go through one shuffle together and meet in a window of
    one ``ROW_KEY``, the mark first: the article bodies move once, for the
    join with what is to be done and for the store's layout alike.  A key is
    one row of one page, so no id can fill a task."""
    todo = ["n_emit", "n_store"]
    both = (articles.withColumns({c: F.lit(None).cast("long") for c in todo})
                    .unionByName(marks, allowMissingColumns=True)
                    .withColumn("bucket", store.bucket()).withColumn("_spread", F.xxhash64(*ROW_KEY))
                    .repartitionByRange("bucket", "_spread"))
    w = Window.partitionBy("bucket", "_spread", *ROW_KEY).orderBy(F.col("n_emit").isNull())
    copy = F.row_number().over(w) - 1
    return (both.withColumns({"_copy": copy, "_row": F.col("n_emit").isNull(), **{f"_{c}": F.first(c).over(w) for c in todo}})
                .filter("_row and (_copy <= _n_emit or _copy <= _n_store)")
                .withColumns({"emitted": F.col("_copy") <= F.col("_n_emit"), "stored": F.col("_copy") <= F.col("_n_store")})
                .drop("_spread", "_copy", "_row", "bucket", *todo, *[f"_{c}" for c in todo]))


def ingest_batch(raw: DataFrame, batch_id: int, registry: DataFrame, store: ArticleStore,
                 changes_path: str | None, quarantine_path: str | None = None,
                 metrics_path: str | None = None, walk: bool = False, sink: Sink | None = None,
                 handler: Handler | None = None, walk_path: str | None = None) -> None:
    """H1 body for one micro-batch of raw pages (B5 -> B4 -> E1 -> B7 -> C3 ->
    A6 -> A9, plus the batch's counter increments when ``metrics_path`` is
    given).  ``walk=True`` first applies the crawl's stop rule (A5) to each
    run -- pages after a bad or empty page, past the known page count, after a
    gap or after five pages in a row whose ``handler`` failed are dropped, as
    the crawl never fetched them; a page whose handler failed is not ingested.
    With ``walk_path`` each run's walk is carried over its micro-batches;
    without it runs must land whole.  Reads only store versions of
    earlier batches.  Change events go to ``sink`` when given (e.g. a broker
    writer), else to the Parquet table at ``changes_path``."""
    if (handler is not None or walk_path) and not walk:
        raise ValueError("handler and walk_path need walk=True")
    decoded = P.decode_pages(P.with_parser(raw, registry), "parser")
    if handler is None:
        decoded = without_good_payloads(decoded)
    failed_runs = walked = runs = None
    held = []
    if walk:
        decoded = decoded.persist()
        inputs = walk_inputs(decoded).persist()
        held = [decoded, inputs]
        runs = CarriedState(raw.sparkSession, walk_path, ["feed", "run_id"]) if walk_path else None
        state = runs.before(batch_id) if runs else None
        failed = None
        if handler is not None:
            # failures only end a walk earlier: without them it reaches all pages it can reach
            reach = (walk_batch(inputs, None, state).filter("reached and not fetch_error and n_articles > 0")
                     .select(*S.PAGE_KEY))
            failed = handler(join_null_safe(decoded, reach, S.PAGE_KEY, "left_semi"), batch_id)
        walked = walk_batch(inputs, failed, state).persist()
        held.append(walked)
        failed_runs = (walked.filter(F.col("reached") & F.col("outcome").isin("fetch_error", "aborted"))
                             .select("feed", "run_id").distinct())
        kept = walked.filter(F.col("reached") & ~F.col("outcome").isin("batch_failed", "aborted")).select(*S.PAGE_KEY)
        decoded = join_null_safe(without_good_payloads(decoded), kept, S.PAGE_KEY, "left_semi")
    decoded = decoded.persist()
    held.append(decoded)
    try:
        if quarantine_path:
            overwrite_partition(decoded.filter("bad").select(*[f.name for f in S.RAW_PAGES.fields]),
                                 batch_id, quarantine_path)
        # all that is ordered, compared and counted are narrow rows; the store is
        # read as three columns, the article bodies only to be written
        rows = article_rows(decoded).select(*S.PAGE_KEY, "pos", "id", "published_at", "content_hash", "row_hash").persist()
        current = store.current(before_batch=batch_id, columns=["content_hash", "row_hash"])
        feed = C.change_feed(rows, current, ROW_ORDER).persist()
        held += [rows, feed]
        marked = marked_rows(article_rows(decoded), row_marks(rows, feed, current), store).persist()
        held.append(marked)
        emitted = marked.filter("emitted")
        # one event per emitted page row, with its page coordinates so a
        # consumer can order several changes of one id within a batch
        events = emitted.select(F.col("id").alias("key"), CL.article_json(emitted).alias("value"),
                                "feed", "run_id", "page_no")
        failed_pages = (sink or parquet_sink(changes_path))(events, batch_id)
        if metrics_path:
            overwrite_partition(batch_counters(feed, decoded, failed_runs, failed_pages), batch_id, metrics_path)
        store.write_batch(batch_id, marked.filter("stored"), dealt=True)
        if runs:
            runs.write(batch_id, PG.walk_state(walked))
        store.commit(batch_id)
    finally:
        for df in reversed(held):
            df.unpersist()


def _last_partition(spark: SparkSession, *paths: str) -> int:
    best = -1
    for p in paths:
        rows = read_if_written(spark, p)
        if rows is None:
            continue
        m = rows.agg(F.max("batch_id")).first()[0]
        best = max(best, -1 if m is None else int(m))
    return best


def batch_offset(spark: SparkSession, checkpoint: str, store: ArticleStore | None = None,
                 outputs: tuple[str, ...] = ()) -> int:
    """Offset added to the stream's batch ids for this checkpoint.

    A fresh checkpoint numbers its micro-batches from 0 again; the store's
    batch ids must keep growing, so the first start of a checkpoint records
    ``store.last_batch() + 1`` in a marker table beside it and every restart
    reads it back (a replayed batch keeps its id and overwrites its own
    partitions)."""
    marker = f"{checkpoint.rstrip('/')}-articleflow-offset"
    written = read_if_written(spark, marker)
    if written is not None:
        return int(written.first()["offset"])
    last = store.last_batch() if store is not None else -1   # first start of this checkpoint
    offset = max(last, _last_partition(spark, *outputs)) + 1
    spark.createDataFrame([(offset,)], "offset long").coalesce(1).write.mode("overwrite").parquet(marker)
    return offset


def run_ingest(stream: DataFrame, registry: DataFrame, store: ArticleStore, changes_path: str,
               checkpoint: str | None = None, quarantine_path: str | None = None,
               available_now: bool = False, interval: str = "1 minute",
               metrics_path: str | None = None, walk: bool = False, sink: Sink | None = None,
               handler: Handler | None = None, walk_path: str | None = None) -> StreamingQuery:
    """H1: crawl pages as they land; one micro-batch per trigger (default
    every minute; ``available_now`` drains what is landed and stops).
    ``walk`` applies the crawl's stop rule over as many micro-batches as a run
    takes (its state is kept at ``walk_path``, default beside the store),
    ``handler`` tells which pages fail, ``sink`` takes the change events (see
    :func:`ingest_batch`)."""
    spark = stream.sparkSession
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/ingest-stream"
    reg = registry.persist()
    reg.count()     # its size is known from here on: a small one is broadcast, the pages are not shuffled by feed
    if walk:
        walk_path = walk_path or f"{store.root}-walk"
    offset = batch_offset(spark, checkpoint, store, tuple(p for p in (changes_path, walk_path) if p))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
               .foreachBatch(lambda df, bid: ingest_batch(df, offset + bid, reg, store, changes_path,
                                                          quarantine_path, metrics_path, walk, sink, handler, walk_path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def sync_batch(events: DataFrame, batch_id: int, outcome, synced_path: str, dead_path: str,
               metrics_path: str | None = None) -> None:
    """H3 body: decode (A7), call downstream once (A8), route failures to the
    dead-letter table with the same key, then count (D4).  A client's outcomes
    are written before they are used; a column sends nothing, its outcomes are
    only kept."""
    articles = CL.read_changes(events)
    kept = isinstance(outcome, Column)
    marked = CL.route(articles, outcome).persist() if kept else CL.outcome_table(articles, outcome)
    try:
        synced, dead = CL.sides(marked)
        overwrite_partition(synced.select(*S.ARTICLE_COLS), batch_id, synced_path)
        overwrite_partition(dead, batch_id, dead_path)
        if metrics_path:
            overwrite_partition(sync_increments(marked), batch_id, metrics_path)
    finally:
        if kept:
            marked.unpersist()


def run_sync(spark: SparkSession, changes_path: str, synced_path: str, dead_path: str,
             outcome=None, checkpoint: str | None = None,
             available_now: bool = False, interval: str = "1 minute",
             metrics_path: str | None = None, stream: DataFrame | None = None) -> StreamingQuery:
    """H3: consume the change log continuously.  ``outcome`` is a bool column
    (deterministic) or a Python client (see ``changelog.sync_and_route``).  ``stream``: any
    stream with ``key`` and ``value`` text columns (a broker's topic) in
    place of the Parquet change log; ``metrics_path``: table of the D4
    increments."""
    from pyspark.sql import types as T
    schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType()),
                           T.StructField("feed", T.StringType()), T.StructField("run_id", T.LongType()),
                           T.StructField("page_no", T.LongType()), T.StructField("batch_id", T.LongType())])
    checkpoint = checkpoint or f"{checkpoint_root(spark)}/sync-stream"
    outcome = outcome if outcome is not None else F.lit(True)
    if stream is None:
        stream = spark.readStream.schema(schema).parquet(changes_path)
    offset = batch_offset(spark, checkpoint, outputs=(synced_path, dead_path))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
               .foreachBatch(lambda df, bid: sync_batch(df, offset + bid, outcome, synced_path, dead_path,
                                                        metrics_path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
