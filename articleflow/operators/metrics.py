"""Pipeline counters and histograms as table operators.

All are grouped aggregations (partial aggregation before the shuffle, so a
feed holding most rows costs one row per map task), never per-row loops.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.functions import epoch_us

# Bucket bounds of the freshness histogram (seconds) and the
# client default bounds of the duration histograms (seconds).
FRESHNESS_BOUNDS = (60, 300, 600, 1800, 3600, 7200, 21600, 86400)
DEFAULT_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1, 2.5, 5, 10)
INF = "+Inf"


def ingest_counters(classified: DataFrame, runs: DataFrame, feed: str = "feed") -> DataFrame:
    """``success`` = unique articles of processed pages per feed;
    ``error_crawl`` = failed runs per feed (``runs`` has a ``failed`` flag)."""
    ok = classified.groupBy(feed).agg(F.count(F.lit(1)).alias("n")).withColumn("status", F.lit("success"))
    err = (runs.filter(F.col("failed")).groupBy(feed).agg(F.count(F.lit(1)).alias("n"))
               .withColumn("status", F.lit("error_crawl")))
    return ok.unionByName(err).select(feed, "status", "n")


def duplicate_counters(classified: DataFrame, feed: str = "feed") -> DataFrame:
    """Rows already stored unchanged, per feed (a feed only appears once
    it has skipped something; repeats inside a page are not counted)."""
    return (classified.groupBy(feed).agg(F.count_if(F.col("change") == "unchanged").alias("skipped"))
                      .filter(F.col("skipped") > 0))


def publish_counters(classified: DataFrame, publish_ok: Column, page_key: list[str] | None = None,
                     feed: str = "feed") -> DataFrame:
    """D3: per feed, ``published`` = changed rows of pages whose publish
    succeeded; ``publish_errors`` = pages whose publish failed (one per
    page, and only pages with something to publish).  Both are present,
    as 0, for every feed with a processed page."""
    page_key = page_key or ["feed", "run_id", "page_no"]
    pages = (classified.groupBy(*page_key)
                       .agg(F.count_if(F.col("change") != "unchanged").alias("n_changed"),
                            F.first(publish_ok).alias("ok")))
    return pages.groupBy(feed).agg(
        F.sum(F.when(F.col("ok"), F.col("n_changed")).otherwise(0)).cast("long").alias("published"),
        F.count_if(~F.col("ok") & (F.col("n_changed") > 0)).alias("publish_errors"))


def sync_counters(routed: DataFrame, dead_letter_ok: Column | None = None,
                  source: str = "source") -> DataFrame:
    """Per article source, ``processed`` (synced), ``errors`` (failed
    syncs) and ``dead_lettered`` (failed ones re-published; all of them
    unless ``dead_letter_ok`` says the dead-letter write failed).  One
    aggregation over the routed outcomes (``changelog.route``)."""
    ok = F.col("synced")
    dl = dead_letter_ok if dead_letter_ok is not None else F.lit(True)
    return routed.groupBy(source).agg(F.count_if(ok).alias("processed"), F.count_if(~ok).alias("errors"),
                                      F.count_if(~ok & dl).alias("dead_lettered"))


def parse_error_counters(bad_pages: DataFrame, feed: str = "feed") -> DataFrame:
    """Undecodable pages per feed."""
    return bad_pages.groupBy(feed).agg(F.count(F.lit(1)).alias("parse_errors"))


def le_text(b: float) -> str:
    return format(float(b), "g")


def histogram(df: DataFrame, value: str | Column, bounds: Sequence[float] = DEFAULT_BOUNDS,
              by: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram in long form: one row per group and bucket
    ``le`` (upper bound as text, ``+Inf`` last) with ``cumulative_count``,
    plus the group's ``sum`` and ``count``.  One aggregation pass, then an
    ``unpivot`` (``stack``), no join."""
    v = F.col(value) if isinstance(value, str) else value
    bounds = sorted(float(b) for b in bounds)
    aggs = [F.count_if(v <= F.lit(b)).alias(f"_b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(v).alias("count"), F.sum(v).alias("sum")]
    wide = df.groupBy(*by).agg(*aggs)
    pairs = ", ".join(f"'{le_text(b)}', CAST({b!r} AS DOUBLE), _b{i}" for i, b in enumerate(bounds))
    stack = F.expr(f"stack({len(bounds) + 1}, {pairs}, '{INF}', CAST('Infinity' AS DOUBLE), count)"
                   ).alias("le", "le_value", "cumulative_count")
    return wide.select(*by, stack, "sum", "count")


def freshness(articles: DataFrame, now: str | Column = "fetched_at",
              published: str = "published_at") -> DataFrame:
    """Age of each article at ``now`` in seconds (``freshness_s``);
    rows without a publication time (zero time) are skipped.  ``now`` is a
    column -- the page's fetch time -- never the wall clock."""
    return articles.filter(F.col(published).isNotNull()).withColumn("freshness_s", age_s(now, published))


def age_s(now: str | Column, published: str) -> Column:
    """Age in seconds at ``now``, NULL without a publication time."""
    now_c = F.col(now) if isinstance(now, str) else now
    return (epoch_us(now_c) - epoch_us(published)) / F.lit(1e6)
