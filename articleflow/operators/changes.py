"""De-duplication, hashing and change detection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.functions import content_hash
from articleflow.operators.skew import chunked_lag

NEW, CHANGED, UNCHANGED = "new", "changed", "unchanged"


def dedup_items(items: Column) -> Column:
    """E1 inside one page's item array: keep the first item of every id, in
    payload order, tagging each with its original position ``pos``.

    Runs in the parsing projection, so de-duplication costs no shuffle.
    O(n log n) per page: sort by (id asc, position desc), pair every element
    with its successor (``zip_with`` on the array and its one-step shift), keep
    the last of each id run (its first occurrence), sort back by position.
    Every array expression is evaluated a constant number of times per page.
    """
    indexed = F.transform(items, lambda x, i: F.struct(i.cast("long").alias("pos"), x.alias("a")))

    def id_then_pos_desc(left: Column, right: Column) -> Column:
        li, ri = left["a"]["id"], right["a"]["id"]
        return (F.when(li < ri, F.lit(-1)).when(li > ri, F.lit(1))
                 .otherwise(F.signum(right["pos"] - left["pos"]).cast("int")))
    ordered = F.array_sort(indexed, id_then_pos_desc)
    nxt = F.slice(ordered, 2, F.size(ordered))
    kept = F.zip_with(ordered, nxt, lambda cur, n: F.when(n.isNull() | (n["a"]["id"] != cur["a"]["id"]), cur))
    return F.array_sort(F.filter(kept, lambda e: e.isNotNull()))  # natural struct order: by pos


def dedup_batch(articles: DataFrame, page_key: list[str] | None = None) -> DataFrame:
    """E1 over exploded rows: first occurrence (lowest ``pos``) of an id per page.

    A grouped ``min_by`` rather than ``row_number``: it aggregates map-side
    before the shuffle, so a page full of copies of one id costs one row per
    task and never a sorted window partition.
    """
    page_key = page_key or S.PAGE_KEY
    rest = [c for c in articles.columns if c not in (*page_key, "id")]
    return (articles.groupBy(*page_key, "id")
                    .agg(F.min_by(F.struct(*rest), F.col("pos")).alias("_r"))
                    .select(*page_key, "id", "_r.*")
                    .select(*articles.columns))


def with_content_hash(df: DataFrame) -> DataFrame:
    """``content_hash`` = sha256 hex of source, url, title, summary, body."""
    return df.withColumn("content_hash", content_hash())


def lookup_hashes(store: DataFrame, ids: DataFrame) -> DataFrame:
    """``(id, content_hash)`` of the stored articles among ``ids``.

    Only two columns are read from the store (pruned at the scan); absent ids
    are simply missing; a stored row without a hash reads as ''.  The id list
    is a de-duplicated batch: AQE broadcasts it when its measured size is
    under the broadcast threshold (the store is then filtered in place,
    never shuffled), else the join stays a shuffle join.
    """
    keys = ids.select("id").distinct()
    return (store.select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
                 .join(keys, "id", "left_semi"))


def classify_changes(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Tag each (unique) batch row new / changed / unchanged against the
    stored hashes ``(id, content_hash)`` of C1."""
    st = stored.select("id", F.col("content_hash").alias("_stored"))
    return (batch.join(st, "id", "left")
                 .withColumn("change",
                             F.when(F.col("_stored").isNull(), F.lit(NEW))
                              .when(F.col("_stored") != F.col("content_hash"), F.lit(CHANGED))
                              .otherwise(F.lit(UNCHANGED)))
                 .drop("_stored"))


def change_feed(pages: DataFrame, store: DataFrame, order: list[str] | None = None,
                chunk: str = "run_id") -> DataFrame:
    """Apply many pages in order, each seeing the upserts of the previous.

    ``pages``: unique-per-page article rows with ``feed, run_id, page_no`` and
    ``content_hash``; ``store``: current state ``(id, content_hash, ...)``.
    Returns every page row with ``prev_hash`` and ``change``; emitted rows are
    ``change <> 'unchanged'``.  Equal to the sequential loop: the previous hash
    of a row is the one of the last earlier page holding that id, else the
    stored one.  Order within an id is ``(run_id, feed, page_no)``; the lag is
    split by ``run_id`` so one id seen in every page of every run never forms
    a single window task.
    """
    order = order or ["run_id", "feed", "page_no"]
    stored = (store.select("id", F.coalesce("content_hash", F.lit("")).alias("content_hash"))
                   .join(pages.select("id").distinct(), "id", "left_semi")
                   .select("id", F.lit(True).alias("_stored_row"),
                           *[F.lit(None).cast(pages.schema[c].dataType).alias(c) for c in order],
                           "content_hash"))
    stored = stored.withColumn(chunk, F.lit(-1).cast("long"))
    rows = pages.withColumn("_stored_row", F.lit(False))
    both = rows.unionByName(stored, allowMissingColumns=True)
    # Stored rows sort before every page: they sit alone in chunk -1 (run ids
    # are crawl start times, never negative).
    lagged = chunked_lag(both, ["id"], order, chunk, "content_hash", "prev_hash")
    return (lagged.filter(~F.col("_stored_row")).drop("_stored_row")
                  .withColumn("change",
                              F.when(F.col("prev_hash").isNull(), F.lit(NEW))
                               .when(F.col("prev_hash") != F.col("content_hash"), F.lit(CHANGED))
                               .otherwise(F.lit(UNCHANGED))))


def latest_rows(pages: DataFrame, order: list[str] | None = None) -> DataFrame:
    """The last row per id of many pages in order (grouped ``max_by``)."""
    order = order or ["run_id", "feed", "page_no"]
    return (pages.groupBy("id")
                 .agg(F.max_by(F.struct(*[c for c in S.ARTICLE_COLS if c != "id"]), F.struct(*order)).alias("_a"))
                 .select("id", "_a.*"))


def state_after(pages: DataFrame, store: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Store state after applying ``pages`` in order: the last row per id
    (grouped ``max_by``, map-side combined), else the stored row."""
    latest = latest_rows(pages, order)
    return store.select(*S.ARTICLE_COLS).join(latest.select("id"), "id", "left_anti").unionByName(latest)
