"""Landed page payloads (A3) and the crawl's page walk (A5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.operators.joins import join_null_safe
from articleflow.operators.streaks import failure_streaks

MAX_CONSECUTIVE_BATCH_FAILURES = 5


def land_pages(raw: DataFrame, path: str) -> None:
    """Append raw pages the way a fetcher lands them: a table with ``feed=``
    and ``run_id=`` folders, many pages to a file.  The rebalance splits a
    feed that holds most pages."""
    (raw.select(*S.RAW_PAGES.names).hint("rebalance", "feed", "run_id")
        .write.mode("append").partitionBy("feed", "run_id").parquet(path))


def scan_raw_pages(spark: SparkSession, path: str) -> DataFrame:
    """A3: landed pages -> ``raw_pages``.

    The schema is declared, the folder columns included, so a feed named
    ``007`` stays text; a filter on feed or run prunes folders before any
    file is opened.
    """
    return spark.read.schema(S.RAW_PAGES).parquet(path).select(*S.RAW_PAGES.names)


# What a run carries from one micro-batch of its pages to the next.
WALK_STATE = ["known_pages", "streak", "pages_seen", "blocked"]


def walk_pages(pages: DataFrame, run_key: list[str] | None = None, max_pages: int | None = None,
               state: DataFrame | None = None, carry: bool = False) -> DataFrame:
    """A5: which landed pages the crawl loop reaches, and their outcome.

    Input: one row per page of a run with ``page_no``, ``fetch_error``
    (fetch or decode failed), ``num_pages`` (page info, NULL if none),
    ``n_articles`` and ``batch_failed`` (the page handler failed).  The loop
    stops before page p when p >= the last known page count (-1 = unknown),
    at ``max_pages`` where a crawl sets one (off by default), or at a gap; and after page p on a fetch error, an empty
    page, or the 5th consecutive handler failure.  Adds ``known_pages``,
    ``streak``, ``reached`` and ``outcome``
    (processed / batch_failed / aborted / fetch_error / empty / not_reached).

    ``state`` (``run_key`` and :data:`WALK_STATE`, see :func:`walk_state`) is
    what earlier parts of the same runs left: the walk goes on from there, so
    a run cut into parts by ascending ``page_no`` gives the rows of the whole
    run.  ``carry=True`` keeps the columns that :func:`walk_state` reads.

    Windows are per run (``feed, run_id``): one crawl of one feed.
    """
    run_key = run_key or ["feed", "run_id"]
    w = Window.partitionBy(*run_key).orderBy("page_no")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen, known, streak, blocked = F.lit(0), F.lit(-1).cast("long"), F.lit(0), F.lit(False)
    if state is not None:
        earlier = state.select(*run_key, *[F.col(c).alias(f"_{c}") for c in WALK_STATE])
        pages = join_null_safe(pages, earlier, run_key, "left")
        seen, known, streak, blocked = (F.coalesce(f"_{c}", x) for c, x in (
            ("pages_seen", seen), ("known_pages", known), ("streak", streak), ("blocked", blocked)))
    df = (pages.withColumn("_rn", F.row_number().over(w) + seen)
               .withColumn("known_pages", F.coalesce(F.last("num_pages", ignorenulls=True).over(before), known)))
    failed = F.coalesce(F.col("batch_failed"), F.lit(False))
    df = failure_streaks(df, run_key, ["page_no"], failed, MAX_CONSECUTIVE_BATCH_FAILURES)
    if state is not None:
        # without a success in this part the earlier failures count too
        none_yet = F.coalesce(F.max(F.when(~failed, True)).over(upto), F.lit(False)) == F.lit(False)
        df = (df.withColumn("streak", F.col("streak") + F.when(none_yet, streak).otherwise(0))
                .withColumn("tripped", F.col("streak") >= MAX_CONSECUTIVE_BATCH_FAILURES))
    fetch_error = F.coalesce(F.col("fetch_error"), F.lit(False))
    empty = F.coalesce(F.col("n_articles"), F.lit(0)) == 0
    too_far = F.lit(False) if max_pages is None else F.col("page_no") >= max_pages
    pre_block = ((F.col("page_no") != F.col("_rn") - 1) | too_far
                 | ((F.col("known_pages") != -1) & (F.col("page_no") >= F.col("known_pages"))))
    post_stop = fetch_error | (~fetch_error & empty) | (~fetch_error & ~empty & failed & F.col("tripped"))
    df = (df.withColumn("_pre", pre_block.cast("int"))
            .withColumn("_post", post_stop.cast("int"))
            .withColumn("reached", ~blocked & (F.max("_pre").over(upto) == 0)
                        & (F.coalesce(F.max("_post").over(before), F.lit(0)) == 0)))
    outcome = (F.when(~F.col("reached"), F.lit("not_reached"))
                .when(fetch_error, F.lit("fetch_error"))
                .when(empty, F.lit("empty"))
                .when(failed & F.col("tripped"), F.lit("aborted"))
                .when(failed, F.lit("batch_failed"))
                .otherwise(F.lit("processed")))
    if carry:
        df = (df.withColumn("pages_seen", F.col("_rn").cast("long"))
                .withColumn("blocked", blocked | (F.greatest(F.max("_pre").over(upto), F.max("_post").over(upto)) == 1)))
    extra = [f"_{c}" for c in WALK_STATE] if state is not None else []
    return df.withColumn("outcome", outcome).drop("_rn", "_pre", "_post", "tripped", *extra)


def walk_state(walked: DataFrame, run_key: list[str] | None = None) -> DataFrame:
    """What the walked pages (``carry=True``) leave for the next part of their
    runs: ``run_key`` and :data:`WALK_STATE`, one row per run."""
    run_key = run_key or ["feed", "run_id"]
    last = F.struct(F.coalesce("num_pages", "known_pages").alias("known_pages"), F.col("streak").cast("long").alias("streak"),
                    "pages_seen", "blocked")
    return (walked.groupBy(*run_key).agg(F.max_by(last, F.struct("page_no", "pages_seen")).alias("_s"))
                  .select(*run_key, "_s.*"))


def run_status(walked: DataFrame, run_key: list[str] | None = None) -> DataFrame:
    """Per run: ``failed`` when a reached page ended it with an error
    (fetch / decode error or too many consecutive handler failures)."""
    run_key = run_key or ["feed", "run_id"]
    return walked.groupBy(*run_key).agg(
        F.max(F.col("outcome").isin("fetch_error", "aborted").cast("int")).cast("boolean").alias("failed"),
        F.count_if(F.col("reached")).alias("pages_reached"))
