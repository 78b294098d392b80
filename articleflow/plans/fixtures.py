"""Adapters from the driver tables to the pipeline's inputs.

Every input the registered queries use is derived by Spark from the given
tables, so the work grows with them:

* ``documents`` -> first-feed page payloads (one JSON document per page) and
  the article store; ``conversations`` -> second-feed pages;
* ``events`` -> fetch logs, metric samples and log lines;
* ``orders`` / ``lineitem`` -> ages for freshness and retention.

The same derivations are written as SQL in :mod:`articleflow.plans.oracle`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.functions import content_hash, epoch_ms_to_ts, epoch_us, rfc3339

# Fixed fixture parameters (shared with the SQL oracle).
DOCS_PER_PAGE = 50           # doc ids per page number
BASE_MS = 1704067200000      # 2024-01-01T00:00:00Z in epoch ms
MS_STEP = 61003              # lastModified = BASE_MS + doc_id * MS_STEP
RUN1_BASE = 1000             # second crawl's page numbers start here


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pad2(c: Column) -> Column:
    return F.lpad(c.cast("string"), 2, "0")


def doc_date_text(doc_id: Column) -> Column:
    """The ``date`` text of a document's item: RFC 3339 mostly, with the edge
    shapes a feed sends (empty, date only, zone-less, offset, fraction)."""
    day = _pad2(F.lit(1) + doc_id % 28)
    hh, mm, ss = _pad2(doc_id % 24), _pad2(doc_id % 60), _pad2((doc_id * 7) % 60)
    base = F.concat(F.lit("2024-01-"), day, F.lit("T"), hh, F.lit(":"), mm, F.lit(":"), ss)
    k = doc_id % 8
    return (F.when(k == 3, F.lit(""))
             .when(k == 5, F.concat(F.lit("2024-01-"), day))
             .when(k == 6, base)
             .when(k == 7, F.concat(base, F.lit("+02:00")))
             .when(k == 4, F.concat(base, F.lit(".250Z")))
             .otherwise(F.concat(base, F.lit("Z"))))


def _doc_item(d: DataFrame, run: int) -> Column:
    """One first-feed content item per document (JSON field names)."""
    doc_id = F.col("doc_id")
    text = F.col("text")
    if run == 1:  # the second crawl edits some bodies and some tags
        text = F.when(doc_id % 5 == 0, F.concat(text, F.lit(" [updated]"))).otherwise(text)
    tag2 = F.lit(100) + doc_id % 3 + (F.lit(run) * (doc_id % 2))
    return F.struct(
        doc_id.alias("id"),
        F.col("lang").alias("type"),
        F.substring(text, 1, 40).alias("title"),
        F.when(doc_id % 4 == 0, F.lit("")).otherwise(F.concat_ws("/", "lang", "source")).alias("description"),
        F.substring(text, 1, 60).alias("summary"),
        text.alias("body"),
        doc_date_text(doc_id).alias("date"),
        F.when(doc_id % 13 != 0, F.lit(BASE_MS) + doc_id * MS_STEP).alias("lastModified"),
        F.concat(F.lit("https://news.example/"), F.col("source"), F.lit("/"), doc_id.cast("string")).alias("canonicalUrl"),
        F.array(F.struct((F.col("n_chars") % 7).alias("id"), F.col("lang").alias("label")),
                F.struct(tag2.alias("id"), F.col("source").alias("label"))).alias("tags"),
        F.struct(F.concat(F.lit("https://img.example/"), doc_id.cast("string"), F.lit(".jpg")).alias("imageUrl")).alias("leadMedia"),
    )


def document_items(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Items of crawl ``run`` with their page coordinates and payload order.

    Run 0 repeats every document with ``doc_id % 10 = 7`` later in the same
    page under a changed title (a repeat inside one page); run 1 is a second
    crawl of all documents with some edits.
    """
    d = table(spark, sf_dir, "documents")
    item = _doc_item(d, run)
    page = (F.col("doc_id") / DOCS_PER_PAGE).cast("long") + F.lit(RUN1_BASE * run)
    base = d.select(F.col("source").alias("feed"), F.lit(run).cast("long").alias("run_id"),
                    page.alias("page_no"), F.col("doc_id").alias("ord"), item.alias("item"))
    if run == 0:
        copies = (d.filter(F.col("doc_id") % 10 == 7)
                   .select(F.col("source").alias("feed"), F.lit(run).cast("long").alias("run_id"),
                           page.alias("page_no"), (F.col("doc_id") + F.lit(10**12)).alias("ord"),
                           item.withField("title", F.lit("(copy)")).alias("item")))
        base = base.unionByName(copies)
    return base


def pages_from_items(items: DataFrame, page_size: int = DOCS_PER_PAGE) -> DataFrame:
    """Group items into one JSON payload per page (pages are bounded by
    ``page_size`` ids, so ``collect_list`` per page is bounded).  The page
    count is a scalar subquery (one aggregate value), not a join."""
    num_pages = items.select((F.max("page_no") + 1).alias("num_pages")).scalar()
    return _page_payloads(_gathered(items), num_pages, page_size)


def _gathered(items: DataFrame) -> DataFrame:
    return items.groupBy(*S.PAGE_KEY).agg(F.array_sort(F.collect_list(F.struct("ord", "item"))).alias("its"))


def _page_payloads(grouped: DataFrame, num_pages: Column, page_size: int) -> DataFrame:
    payload = F.to_json(F.struct(
        F.struct(F.col("page_no").alias("page"), num_pages.alias("numPages"),
                 F.lit(page_size).cast("long").alias("pageSize"),
                 F.size("its").cast("long").alias("numEntries")).alias("pageInfo"),
        F.transform("its", lambda e: e["item"]).alias("content")))
    return grouped.select(*S.PAGE_KEY, F.lit(None).cast("timestamp").alias("fetched_at"), payload.alias("payload"))


def documents_by_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, those of a page brought together: what the pages of every
    crawl are made of."""
    return (table(spark, sf_dir, "documents")
            .select("doc_id", "source", "lang", "n_chars", "text", (F.col("doc_id") / DOCS_PER_PAGE).cast("long").alias("page_no"))
            .repartition("source", "page_no"))


def document_pages(spark: SparkSession, sf_dir: str, run: int = 0, docs: DataFrame | None = None) -> DataFrame:
    """First-feed raw pages of one crawl, derived from ``documents``: the pages
    of :func:`document_items`.

    The documents of a page become items only once they lie together (``docs``,
    see :func:`documents_by_page`), so the shuffle moves each text once, not
    the fields cut from it nor the repeats."""
    docs = documents_by_page(spark, sf_dir) if docs is None else docs
    item = _doc_item(docs, run)
    each = F.array(F.struct(F.col("doc_id").alias("ord"), item.alias("item")))
    if run == 0:
        copy = F.struct((F.col("doc_id") + F.lit(10**12)).alias("ord"), item.withField("title", F.lit("(copy)")).alias("item"))
        each = F.when(F.col("doc_id") % 10 == 7, F.concat(each, F.array(copy))).otherwise(each)
    items = docs.select(F.col("source").alias("feed"), F.lit(run).cast("long").alias("run_id"), "page_no", F.inline(each))
    first = F.lit(RUN1_BASE * run)
    num_pages = docs.select((F.max("page_no") + first + 1).alias("num_pages")).scalar()
    return _page_payloads(_gathered(items).withColumn("page_no", F.col("page_no") + first), num_pages, DOCS_PER_PAGE)


CHAT_PAGE_TURNS = 20  # turns per second-feed page


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-feed raw pages: up to 20 turns of one conversation per page
    (page ``conv_id * 1000 + turn div 20``), one item per turn."""
    c = table(spark, sf_dir, "conversations")
    ts_text = F.when(F.col("turn") % 5 == 4, F.lit("not a time")).otherwise(
        F.concat(F.lit("2024-02-"), _pad2(F.lit(1) + F.col("conv_id") % 28), F.lit("T"),
                 _pad2(F.col("turn") % 24), F.lit(":00:00Z")))
    item = F.struct(F.concat(F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string")).alias("id"),
                    F.col("role").alias("headline"), F.col("text").alias("content"), ts_text.alias("timestamp"))
    its = F.array_sort(F.collect_list(F.struct("turn", item.alias("item"))))
    page = F.col("conv_id") * 1000 + (F.col("turn") / CHAT_PAGE_TURNS).cast("long")
    pages = (c.withColumn("page_no", page)
              .groupBy("page_no").agg(F.to_json(F.struct(F.transform(its, lambda e: e["item"]).alias("items")))
                                      .alias("payload")))
    return pages.select(F.lit("chat").alias("feed"), F.lit(0).cast("long").alias("run_id"),
                        F.col("page_no").cast("long"), F.lit(None).cast("timestamp").alias("fetched_at"),
                        "payload")


def articles_from_documents(spark: SparkSession, sf_dir: str, run: int = 0) -> DataFrame:
    """Expected first-feed articles of a crawl, built directly (no JSON round
    trip): the parsed pages must equal this after de-duplication."""
    it = document_items(spark, sf_dir, run)
    x = F.col("item")
    ext = x["id"].cast("string")
    updated = epoch_ms_to_ts(x["lastModified"])
    published = F.coalesce(F.when(x["date"] != "", rfc3339(x["date"])), updated)
    return it.select(
        *S.PAGE_KEY, F.col("ord"),
        F.concat(F.lit("pulselive_"), ext).alias("id"), F.lit("pulselive").alias("source"),
        ext.alias("external_id"), x["type"].alias("type"), x["title"].alias("title"),
        F.when(x["description"] == "", x["summary"]).otherwise(x["description"]).alias("description"),
        x["summary"].alias("summary"), x["body"].alias("body"), F.lit("").alias("content"),
        x["canonicalUrl"].alias("url"), x["leadMedia"]["imageUrl"].alias("image_url"),
        F.transform(x["tags"], lambda t: F.struct(t["id"].cast("long").alias("id"), t["label"].alias("label"))).alias("tags"),
        published.alias("published_at"), updated.alias("updated_at"),
        F.lit(None).cast("timestamp").alias("fetched_at"))


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article store before the crawl: documents with ``doc_id % 3 <> 0``
    (so a third of the crawl is new); of those, ``doc_id % 3 = 1`` hold an
    outdated hash (changed), the rest the current one (unchanged).  Articles
    that no crawl has any more (ids ending in ``_gone``) are stored too."""
    a = articles_from_documents(spark, sf_dir, 0).filter(F.col("ord") < 10**12)
    doc_id = F.col("external_id").cast("long")
    a = a.filter((doc_id % 3 != 0) | (doc_id % 9 == 0))
    return (a.withColumn("content_hash", F.when(doc_id % 3 == 1, F.lit("old")).otherwise(content_hash()))
             .withColumn("id", F.when(doc_id % 9 == 0, F.concat("id", F.lit("_gone"))).otherwise(F.col("id")))
             .select(*S.ARTICLE_COLS))


def registry_from_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The source registry of the fixture feeds: every ``documents`` source
    (first parser) plus the chat feed (item-list parser)."""
    feeds = (table(spark, sf_dir, "documents").select(F.col("source").alias("feed")).distinct()
             .unionByName(spark.range(1).select(F.lit("chat").alias("feed"))))
    return registry_from_feeds(feeds)


def registry_from_feeds(raw: DataFrame) -> DataFrame:
    """A source registry for the feeds present in ``raw``: the chat feed uses
    the item-list parser, every other feed the first parser."""
    feeds = raw.select("feed").distinct()
    return feeds.select(
        F.col("feed").alias("name"),
        F.concat(F.lit("https://feeds.example/"), F.col("feed")).alias("url"),
        F.when(F.col("feed") == "chat", F.lit("dummy")).otherwise(F.lit("pulselive")).alias("transformer"),
        F.struct(F.lit("page").alias("type"), F.lit("page").alias("page_param"),
                 F.lit("pageSize").alias("limit_param"),
                 F.lit(DOCS_PER_PAGE).cast("long").alias("default_limit")).alias("pagination"))


def damaged_pages(raw: DataFrame) -> DataFrame:
    """Edge payloads, chosen by page number: JSON ``null`` (a good, empty
    page), a truncated document, a number in a text field, trailing text
    after the document (ignored)."""
    p, pay = F.col("page_no"), F.col("payload")
    damaged = (F.when(p % 19 == 2, F.lit("null"))
                .when(p % 9 == 4, F.substring(pay, 1, (F.length(pay) / 2).cast("int")))
                .when(p % 13 == 6, F.regexp_replace(pay, '"title":', '"title":123,"x":'))
                .when(p % 17 == 8, F.concat(pay, F.lit(" trailing text")))
                .otherwise(pay))
    return raw.withColumn("payload", damaged)


def object_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as log lines: a JSON object with a key per event type, ``k``
    over the line's own column (null in every fifth), an object, a time field
    in two of three; every 17th does not decode."""
    ev = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = F.concat(F.lit('{"seen_'), F.col("event_type"), F.lit('": '), F.col("user_id").cast("string"),
                    F.when(i % 5 == 0, F.lit(', "k": null')).when(i % 5 == 1, F.lit("")).otherwise(
                        F.concat(F.lit(', "k": "'), F.col("event_type"), F.lit('"'))),
                    F.when(i % 3 != 0, F.concat(F.lit(', "@timestamp": "2024-03-'), _pad2(1 + i % 28), F.lit('T'),
                                                _pad2(i % 24), F.lit(':00:00Z"'))).otherwise(F.lit("")),
                    F.lit(', "o": {"a": ['), i.cast("string"), F.lit(", true]}}"))
    return ev.select("event_id", F.col("user_id").alias("k"),
                     F.when(i % 17 == 0, F.substring(text, 1, 12)).otherwise(text).alias("message"))


UNKNOWN_FEEDS = ["src3", "src11"]     # feeds that a fixture registry lacks


def stray_pages(raw: DataFrame) -> DataFrame:
    """Every seventh page carries no feed."""
    return raw.withColumn("feed", F.when(F.col("page_no") % 7 != 5, F.col("feed")))


def _feed_number() -> Column:
    return F.regexp_extract("feed", "([0-9]+)$", 1).try_cast("long")


def walked_pages(raw: DataFrame) -> DataFrame:
    """Feeds whose number leaves 4 by 5 have page 9 cut short, those that
    leave 3 have an empty page 11."""
    p, f = F.col("page_no"), _feed_number()
    return raw.withColumn("payload", F.when((f % 5 == 4) & (p == 9), F.substring("payload", 1, 40))
                          .when((f % 5 == 3) & (p == 11), F.lit("null")).otherwise(F.col("payload")))


def handler_fails() -> Column:
    """The pages that the fixture's page handler fails: up to six in a row."""
    f = _feed_number()
    return F.coalesce((F.col("page_no") + f) % 13 < f % 7, F.lit(False))


def with_damaged_messages(events: DataFrame) -> DataFrame:
    """Add an undecodable copy (truncated JSON) of every event whose key ends
    in 1; the reader must drop exactly those."""
    bad = (events.filter(F.col("key").endswith("1"))
                 .select(F.concat(F.col("key"), F.lit("#bad")).alias("key"),
                         F.substring("value", 1, 25).alias("value")))
    return events.unionByName(bad)


# ------------------------------------------------------------- registry files
def source_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One registry entry per row of ``pages``, with the invalid shapes a
    hand-written registry has (missing name / url / parser, wrong scheme,
    unknown parser) and every pagination variant."""
    p = table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    host = F.regexp_extract("url", r"^[a-z]+://([^/#?]+)", 1)
    return p.select(
        (pid / 50).cast("long").alias("file_no"), pid,
        F.when(pid % 11 == 0, F.lit("")).otherwise(F.concat(host, F.lit("-"), pid.cast("string"))).alias("name"),
        F.when(pid % 13 == 0, F.lit("")).when(pid % 7 == 0, F.replace(F.col("url"), F.lit("http"), F.lit("ftp")))
         .otherwise(F.col("url")).alias("url"),
        F.when(pid % 5 == 0, F.lit("pulselive")).when(pid % 5 == 1, F.lit("dummy")).when(pid % 5 == 2, F.lit("rss"))
         .when(pid % 5 == 3, F.lit("")).otherwise(F.lit("pulselive")).alias("transformer"),
        F.struct(F.when(pid % 2 == 0, F.lit("offset")).otherwise(F.lit("page")).alias("type"),
                 F.when(pid % 4 == 1, F.lit("")).otherwise(F.lit("p")).alias("page_param"),
                 F.when(pid % 4 == 2, F.lit("")).otherwise(F.lit("limit")).alias("limit_param"),
                 F.when(pid % 3 == 0, F.lit(0)).otherwise(F.lit(10) + pid % 50).cast("long").alias("default_limit"))
         .alias("pagination"))


def registry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registry documents (JSON arrays of 50 entries); every 4th file is cut
    short and every 5th (from the 2nd) has numbers for names, so both fail
    to decode as a whole."""
    e = source_entries(spark, sf_dir)
    doc = (e.groupBy("file_no")
            .agg(F.array_sort(F.collect_list(F.struct("page_id", F.struct("name", "url", "transformer", "pagination").alias("s"))))
                 .alias("its"))
            .select("file_no", F.to_json(F.transform("its", lambda x: x["s"])).alias("value")))
    v = F.col("value")
    return doc.withColumn("value", F.when(F.col("file_no") % 4 == 3, F.substring(v, 1, (F.length(v) / 2).cast("int")))
                                    .when(F.col("file_no") % 5 == 1, F.regexp_replace(v, '"name":"', '"name":7,"alias":"'))
                                    .otherwise(v))


# ---------------------------------------------------------------- event logs
def fetch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a page fetch log: feed = user, run = week of January,
    pages numbered by time within the run; purchases above 300 fail to
    fetch, low-value signups are empty pages, errors and clicks fail the
    page handler, low-value clicks carry no page info."""
    from articleflow.operators.skew import chunked_row_number
    ev = table(spark, sf_dir, "events")
    run = ((F.dayofmonth("ts") - 1) / 7).cast("long")
    ev = chunked_row_number(ev.withColumn("run_id", run).withColumn("day", F.to_date("ts")),
                            ["user_id", "run_id"], ["ts", "event_id"], "day", "rn")
    return (ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("feed"), "run_id",
                      (F.col("rn") - 1).cast("long").alias("page_no"),
                      ((F.col("event_type") == "purchase") & (F.col("value") > 300)).alias("fetch_error"),
                      F.when((F.col("event_type") == "click") & (F.col("value") < 5), F.lit(None))
                       .otherwise(F.lit(10) + F.col("user_id") % 60).cast("long").alias("num_pages"),
                      F.when((F.col("event_type") == "signup") & (F.col("value") < 1), F.lit(0))
                       .otherwise(F.lit(1) + F.floor("value") % 20).cast("long").alias("n_articles"),
                      F.col("event_type").isin("error", "click").alias("batch_failed")))


def events_with_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` plus ``day`` (the chunk column of skew-split windows)."""
    return table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples of an ingest counter per (user, outcome): the
    value is the running count of that user's events of that outcome within
    the day (the counter restarts each day, like a process restart)."""
    from articleflow.operators.skew import chunked_row_number
    ev = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", F.lit("error_crawl")).otherwise(F.lit("success"))
    ev = (ev.withColumn("status", status).withColumn("day", F.to_date("ts"))
            .withColumn("hour", F.date_trunc("hour", F.col("ts").cast("timestamp"))))
    ev = chunked_row_number(ev, ["user_id", "status", "day"], ["ts", "event_id"], "hour", "n")
    return ev.select(F.lit("articles_ingested_total").alias("metric"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), "status",
                     F.col("ts").cast("timestamp").alias("ts"), F.col("n").cast("double").alias("value"))


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples of a per-user breaker-state gauge (0, 1, 2)."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.lit("circuit_breaker_state").alias("metric"),
                     F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                     F.lit("").alias("status"), F.col("ts").cast("timestamp").alias("ts"),
                     (F.floor("value") % 3).cast("double").alias("value"))


def up_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples of ``up`` per instance (user) of two jobs: 0 at
    an error, else 1."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.lit("up").alias("metric"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"),
                     F.when(F.col("user_id") % 2 == 0, F.lit("kafka")).otherwise(F.lit("crawler")).alias("job"),
                     F.col("ts").cast("timestamp").alias("ts"),
                     (F.col("event_type") != "error").cast("double").alias("value"))


def duration_samples(spark: SparkSession, sf_dir: str, bounds) -> DataFrame:
    """``events`` as samples of cumulative duration buckets per event type:
    one sample of every bucket in each minute with an event."""
    from articleflow.operators.skew import chunked_running
    ev = table(spark, sf_dir, "events").where("ts is not null")
    les = [(format(float(b), "g"), F.col("value") <= b) for b in bounds] + [("+Inf", F.col("value").isNotNull())]
    per = (ev.groupBy(F.col("event_type").alias("source"), F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("ts"))
             .agg(*[F.count_if(c).alias(le) for le, c in les])
             .select("source", "ts", F.to_date("ts").alias("day"),
                     F.explode(F.map_from_arrays(F.array(*[F.lit(le) for le, _ in les]),
                                                 F.array(*[F.col(f"`{le}`") for le, _ in les]))).alias("le", "n")))
    run = chunked_running(per, ["source", "le"], ["ts"], "day", {"total": ("sum", F.col("n"))})
    return run.select(F.lit("provider_fetch_duration_seconds").alias("metric"), "source", "le", "ts",
                      F.col("total").cast("double").alias("value"))


def order_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as articles for freshness: published at the order date,
    fetched ``o_totalprice`` seconds later, per order priority."""
    o = table(spark, sf_dir, "orders")
    pub = F.col("o_orderdate").cast("timestamp")
    fetched = F.timestamp_micros(epoch_us(pub) + F.round(F.col("o_totalprice") * 1e6).cast("long"))
    return o.select(F.col("o_orderpriority").alias("feed"), pub.alias("published_at"), fetched.alias("fetched_at"))
