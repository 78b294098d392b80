"""Keyed state of a stream that outlives its checkpoint.

A batch writes a row for every key it changed, as its own ``batch_id``
partition, so a replay replaces its rows.  Every ``compact_every`` batches the
state so far becomes one snapshot partition; a reader takes the newest
snapshot below its batch and the batches after it, so what it reads follows
the keys, not the number of batches.  Batch ids come from
:func:`articleflow.streaming.ingest.batch_offset`, which goes on where the last
checkpoint ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from articleflow.session import read_if_written


def overwrite_partition(df: DataFrame, value: int, path: str, column: str = "batch_id") -> None:
    """Replace the partition ``column=value`` of the table at ``path``."""
    (df.withColumn(column, F.lit(value).cast("long"))
       .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
       .partitionBy(column).parquet(path))


class CarriedState:
    """State by ``keys`` in a table of changes at ``path`` and its snapshots
    beside it (``<path>-base``)."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], compact_every: int = 50):
        self.spark, self.path, self.keys, self.compact_every = spark, path.rstrip("/"), keys, compact_every

    def _merged(self, batch_id: int, upto: int, base: DataFrame | None) -> DataFrame | None:
        parts = [] if base is None else [base.where(F.col("upto") == upto).withColumnRenamed("upto", "batch_id")]
        changes = read_if_written(self.spark, self.path)
        if changes is not None:
            parts.append(changes.where((F.col("batch_id") > upto) & (F.col("batch_id") < batch_id)))
        if not parts:
            return None
        rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        values = [c for c in rows.columns if c not in (*self.keys, "batch_id")]
        return (rows.groupBy(*self.keys).agg(F.max_by(F.struct(*values), "batch_id").alias("_v"))
                    .select(*self.keys, "_v.*"))

    def before(self, batch_id: int) -> DataFrame | None:
        """The state that batch ``batch_id`` starts from; None before the first."""
        base, upto = read_if_written(self.spark, f"{self.path}-base"), None
        if base is not None:
            upto = base.where(F.col("upto") < batch_id).agg(F.max("upto")).first()[0]
        if upto is None:
            base = None
        state = self._merged(batch_id, -1 if upto is None else upto, base)
        if state is not None and batch_id - 1 - (-1 if upto is None else upto) >= self.compact_every:
            overwrite_partition(state, batch_id - 1, f"{self.path}-base", "upto")
            base = self.spark.read.parquet(f"{self.path}-base")
            state = self._merged(batch_id, batch_id - 1, base)
        return state

    def write(self, batch_id: int, rows: DataFrame) -> None:
        """What batch ``batch_id`` leaves for the keys it saw."""
        overwrite_partition(rows, batch_id, self.path)
