"""Article store operations (A9, F1) and the versioned store (section 7.3).

The store is a keyed table of articles.  Without a MERGE-capable table format
the upsert is expressed as ``anti join + union`` (replace every batch row,
keep the rest), and the persistent store is an append-only table of versions
(:class:`ArticleStore`) whose current view is the last version per id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.session import read_if_written


def upsert_articles(store: DataFrame, batch: DataFrame) -> DataFrame:
    """Set every field of each batch row by id, inserting absent ids.

    ``batch`` must be unique by id (one page after E1, or the last row per id
    of many pages, see ``changes.state_after``).  An empty batch is a no-op.
    """
    b = batch.select(*S.ARTICLE_COLS)
    return store.select(*S.ARTICLE_COLS).join(b.select("id"), "id", "left_anti").unionByName(b)


def last_published(store: DataFrame, source: str | None = None, by: str = "source") -> DataFrame:
    """the article with the greatest ``published_at`` of one source (one
    row or none), or of every value of ``by`` when ``source`` is None.

    Ties on ``published_at`` go to the greatest id.  The all-sources form is a
    grouped ``max_by`` -- partial aggregation before the shuffle, so a source
    holding most of the store costs one row per map task.
    """
    cols = S.ARTICLE_COLS
    if source is not None:
        return (store.filter(F.col(by) == source)
                     .orderBy(F.col("published_at").desc_nulls_last(), F.col("id").desc())
                     .limit(1).select(*cols))
    key = F.struct(F.col("published_at"), F.col("id"))
    return store.groupBy(by).agg(F.max_by(F.struct(*cols), key).alias("_a")).select("_a.*")


def row_hash(exclude: tuple[str, ...] = ("fetched_at",)):
    """64-bit hash of every article field except ``exclude`` (a version is
    written only when this changes).  Whether a field is NULL is hashed too:
    the hash function itself skips NULLs, so a value moving from one column
    to the next, or NULL becoming empty, would go unseen."""
    return F.xxhash64(*[x for c in S.ARTICLE_COLS if c not in exclude for x in (F.col(c).isNull(), F.col(c))])


def buckets_for(articles: int, rows_per_bucket: int = 1_000_000) -> int:
    """Buckets of a store expected to hold ``articles`` articles."""
    return max(1, -(-articles // rows_per_bucket))


class ArticleStore:
    """Append-only, versioned article table under one root folder.

    ``<root>/versions/batch_id=N/bucket=B/`` holds the rows batch N changed
    (any field except ``fetched_at``, not only the hashed ones), with their
    ``row_hash``; ``<root>/base/`` is an optional compacted snapshot (the
    current view up to a batch).  The current view is the row of the highest
    batch id per id over base + later versions (``max_by``, partial
    aggregation).  A batch writes its change events first, then its versions,
    both as ``overwrite`` of its own ``batch_id`` partition, so a replayed
    batch recomputes and rewrites the same rows (idempotent) and a crash
    between the two writes loses nothing.  Readers of batch N see only
    versions of batches below N.  Rows are bucketed by ``xxhash64(id)`` and
    sorted by id inside a file, so a lookup by id reads few row groups.
    ``buckets`` is set from the store's size (:func:`buckets_for`) and kept
    for its life; a bucket's rows of a batch are dealt to as many writers as
    their size asks for, so it does not bound a batch's parallelism.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark = spark
        self.root = root.rstrip("/")
        self.buckets = buckets

    @property
    def versions_path(self) -> str:
        return f"{self.root}/versions"

    @property
    def base_path(self) -> str:
        return f"{self.root}/base"

    @property
    def commits_path(self) -> str:
        return f"{self.root}/commits"

    def commit(self, batch_id: int) -> None:
        """Mark ``batch_id`` complete (after its events and versions are
        written); idempotent."""
        (self.spark.createDataFrame([(batch_id,)], "batch long").withColumn("batch_id", F.col("batch"))
             .coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(self.commits_path))

    def committed(self) -> int:
        """Highest committed batch id, -1 when none."""
        c = self._read(self.commits_path)
        m = None if c is None else c.agg(F.max("batch_id")).first()[0]
        return -1 if m is None else int(m)

    def current_committed(self, columns: list[str] | None = None) -> DataFrame:
        """Consistent view for outside readers: committed batches only (an
        in-flight batch's versions are not visible)."""
        return self.current(before_batch=self.committed() + 1, columns=columns)

    def _read(self, path: str) -> DataFrame | None:
        return read_if_written(self.spark, path)

    def current(self, before_batch: int | None = None, columns: list[str] | None = None) -> DataFrame:
        """Current state: last version per id (optionally only batches < N),
        from the newest usable snapshot plus the versions after it.

        ``columns`` limits the view to ``id`` plus those fields, and the Parquet
        scan to them: the per-batch lookups need ``content_hash`` and
        ``row_hash`` only, never the article bodies.
        """
        fields = [c for c in [*S.ARTICLE_COLS, "row_hash"] if columns is None or c == "id" or c in columns]
        cols = [*fields, "batch_id"]
        parts, upto = [], -1
        base = self._read(self.base_path)
        if base is not None:
            usable = base if before_batch is None else base.filter(F.col("upto_batch") < before_batch)
            best = usable.agg(F.max("upto_batch")).first()[0]
            if best is not None:
                upto = int(best)
                parts.append(base.filter(F.col("upto_batch") == upto)
                                 .withColumnRenamed("upto_batch", "batch_id").select(*cols))
        v = self._read(self.versions_path)
        if v is not None:
            v = v.filter(F.col("batch_id") > upto)  # partition pruning
            if before_batch is not None:
                v = v.filter(F.col("batch_id") < before_batch)
            parts.append(v.select(*cols))
        if not parts:
            empty = self.spark.createDataFrame([], S.ARTICLE).withColumn("row_hash", F.lit(None).cast("long"))
            return empty.select(*fields)
        allv = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        rest = [c for c in fields if c != "id"]
        return (allv.groupBy("id")
                    .agg(F.max_by(F.struct(*rest), F.col("batch_id")).alias("_a"))
                    .select("id", "_a.*"))

    def last_batch(self) -> int:
        """Highest batch id written (versions or snapshot), -1 when empty."""
        best = -1
        v = self._read(self.versions_path)
        if v is not None:
            m = v.agg(F.max("batch_id")).first()[0]
            best = max(best, -1 if m is None else int(m))
        b = self._read(self.base_path)
        if b is not None:
            m = b.agg(F.max("upto_batch")).first()[0]
            best = max(best, -1 if m is None else int(m))
        return best

    def bucket(self) -> Column:
        """The bucket of an article id."""
        return F.pmod(F.xxhash64("id"), F.lit(self.buckets))

    def write_batch(self, batch_id: int, rows: DataFrame, dealt: bool = False) -> None:
        """Write the changed rows of ``batch_id`` (overwrite of its partition).
        ``dealt``: the rows lie by bucket already, so they are not shuffled."""
        rows = (rows.select(*S.ARTICLE_COLS)
                    .withColumn("row_hash", row_hash())
                    .withColumn("bucket", self.bucket())
                    .withColumn("batch_id", F.lit(batch_id).cast("long")))
        ((rows if dealt else rows.hint("rebalance", "bucket"))
             .sortWithinPartitions("bucket", "id")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy("batch_id", "bucket")
             .parquet(self.versions_path))

    def changed_rows(self, batch_id: int, latest: DataFrame) -> DataFrame:
        """Rows of ``latest`` (unique by id) that differ from the current view
        in any field but ``fetched_at``: an anti join on ``(id, row_hash)``,
        so only two columns of the store take part."""
        cur = (self.current(before_batch=batch_id, columns=["row_hash"])
                   .join(latest.select("id"), "id", "left_semi"))
        return (latest.select(*S.ARTICLE_COLS).withColumn("row_hash", row_hash())
                      .join(cur, ["id", "row_hash"], "left_anti").drop("row_hash"))

    # Repository surface: writer, reader and hash reader over the current view.
    def upsert(self, batch_id: int, batch: DataFrame) -> None:
        """A9 on the versioned table: write the rows of ``batch`` (unique by
        id) that differ from the current view as batch ``batch_id``."""
        self.write_batch(batch_id, self.changed_rows(batch_id, batch))

    def lookup_hashes(self, ids: DataFrame, before_batch: int | None = None) -> DataFrame:
        """C1 against the current view (two narrow columns read)."""
        from articleflow.operators.changes import lookup_hashes
        return lookup_hashes(self.current(before_batch, columns=["content_hash"]), ids)

    def last_published(self, source: str | None = None) -> DataFrame:
        """F1 against the current view."""
        return last_published(self.current().select(*S.ARTICLE_COLS), source)

    def compact(self, upto_batch: int) -> None:
        """Write the current view up to ``upto_batch`` as snapshot
        ``base/upto_batch=N`` (a new partition; older snapshots and versions
        stay readable until removed), so later reads aggregate only the
        versions after it."""
        snap = self.current(before_batch=upto_batch + 1).withColumn("upto_batch", F.lit(upto_batch).cast("long"))
        (snap.withColumn("bucket", self.bucket())
             .hint("rebalance", "bucket").sortWithinPartitions("bucket", "id")
             .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
             .partitionBy("upto_batch", "bucket").parquet(self.base_path))
