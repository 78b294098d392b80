"""Helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from articleflow.session import checkpoint_root, scratch_path, ship_package

# Rows of one Arrow batch.  Texts go through Python whole, so a batch is kept
# small: its memory is this many texts, whatever the table's size.
ARROW_ROWS = 512

NARROW_ROWS = 16_384
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"

# Rows of many KB: a row group, which is written and read as one, is closed by
# its bytes, looked at after every row instead of every hundredth.
LARGE_ROWS = {"parquet.block.size": str(8 << 20), "parquet.page.size.row.check.min": "1",
              "parquet.page.size.row.check.max": "1"}

# Proven size bound of a broadcast side, in bytes of its fixed-width rows.
BROADCAST_BYTES = 32 << 20


def ready(spark: SparkSession) -> SparkSession:
    """Shared folder known, package on the Python workers, small Arrow batches."""
    checkpoint_root(spark)
    ship_package(spark)
    spark.conf.set(_BATCH, str(ARROW_ROWS))
    # a phase's shuffle files go when its table is written
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    return spark


def written(df: DataFrame, name: str, arrow_rows: int = ARROW_ROWS, options: dict[str, str] | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder of
    ``spark.checkpoint.dir``: cuts the lineage, survives lost executors, and
    its file size tells Catalyst how large a join side really is.
    ``arrow_rows``: rows of an Arrow batch meanwhile (more for narrow rows);
    ``options``: the writer's, as :data:`LARGE_ROWS`."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(arrow_rows))
    try:
        df.write.options(**(options or {})).parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, row_bytes: int, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if ``rows * row_bytes`` (fixed-width rows,
    counted over the whole side) is at most ``max_bytes``; otherwise unhinted,
    so that Spark joins by shuffle.  ``df`` should be a written table."""
    return F.broadcast(df) if df.count() * row_bytes <= max_bytes else df


def append_columns(df: DataFrame, inputs: list[str], make: Callable[[], Callable],
                   fields: list[StructField]) -> DataFrame:
    """``df`` with the columns ``fields``, computed batch by batch in Python.

    ``make()`` runs once per task and returns a function that takes the input
    columns of a batch (Arrow arrays) and returns the new columns as Arrow
    arrays.  No shuffle; a batch holds at most :data:`ARROW_ROWS` rows.
    """
    schema = StructType([*df.schema.fields, *fields])
    names = schema.names
    at = [df.columns.index(c) for c in inputs]
    types = [f.dataType for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type
        fn, arrow = make(), [to_arrow_type(t) for t in types]
        for b in batches:
            new = fn(*[b.column(i) for i in at])
            new = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(new, arrow, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *new], names=names)

    return df.mapInArrow(run, schema)


def field(name: str, ddl: str) -> StructField:
    from pyspark.sql.types import _parse_datatype_string
    return StructField(name, _parse_datatype_string(ddl), True)
