"""Sampler over a stream (H4): the batch windows of E2 per micro-batch, with
the counts carried in a table.  No Python runs on the rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from articleflow.operators.joins import join_null_safe
from articleflow.operators.streaks import DEFAULT_SAMPLE_EVERY, sample_nth
from articleflow.streaming.carried import CarriedState, overwrite_partition
from articleflow.streaming.ingest import batch_offset


def sample_batch(rows: DataFrame, batch_id: int, n: int, out_path: str, counts_path: str) -> None:
    """One micro-batch of ``(key, id, order, reset, chunk)``: occurrences are
    numbered within the batch, split by ``chunk``; those before the key's
    first reset go on from the carried count.  Both writes replace the
    batch's own partition, so a replay changes nothing."""
    n = n if n >= 1 else DEFAULT_SAMPLE_EVERY
    counts = CarriedState(rows.sparkSession, counts_path, ["key"])
    state = counts.before(batch_id)
    if state is None:
        carried = rows.select("key", F.lit(0).cast("long").alias("carried")).limit(0)
    else:
        carried = state.select("key", F.col("count").alias("carried"))
    local = sample_nth(rows, "key", ["order", "id"], n, reset="reset", chunk="chunk").select(
        "key", "id", "epoch", F.col("occurrence").alias("_occ"))
    before = F.when(F.col("epoch") == 0, F.coalesce("carried", F.lit(0))).otherwise(F.lit(0))
    full = (join_null_safe(local, carried, ["key"], "left").withColumn("occurrence", F.col("_occ") + before)
            .withColumn("emit", F.coalesce((F.col("occurrence") == 1) | (F.col("occurrence") % n == 0), F.lit(False)))
            .withColumn("_before", before).persist())
    try:
        overwrite_partition(full.select("key", "id", "occurrence", "emit"), batch_id, out_path)
        # the last epoch's highest occurrence; a reset that ends the batch leaves 0
        ends = full.groupBy("key", "epoch").agg(F.max(F.coalesce("occurrence", F.col("_before"))).alias("count"))
        counts.write(batch_id, ends.groupBy("key").agg(F.max_by("count", "epoch").alias("count")))
    finally:
        full.unpersist()


def sample_nth_stream(stream: DataFrame, out_path: str, counts_path: str, checkpoint: str,
                      n: int = DEFAULT_SAMPLE_EVERY, available_now: bool = False,
                      interval: str = "1 minute") -> StreamingQuery:
    """H4 on a stream of ``(key, id, order, reset, chunk)`` whose micro-batches
    come in order; ``chunk`` does not decrease with ``order``.  Counts and rows
    outlive the checkpoint: a new one goes on numbering its batches after the
    last partition of either table, so no earlier row is replaced and every
    key goes on counting."""
    offset = batch_offset(stream.sparkSession, checkpoint, outputs=(out_path, counts_path))
    w = (stream.writeStream.option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, bid: sample_batch(df, offset + bid, n, out_path, counts_path)))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()
