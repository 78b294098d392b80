"""Join helpers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Join on equal ``on`` columns, NULL equal to NULL; keeps left's keys.

    ``<=>`` is a hashable join key, so this is an ordinary equi join (AQE
    picks broadcast or shuffle from measured sizes and splits skew)."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def fence(df: DataFrame, *cols: str) -> DataFrame:
    """Re-emit ``cols`` through a one-element generator.

    A later filter on a fenced column cannot be pushed below the generator,
    so an expensive expression behind the column (a JSON decode) is evaluated
    once per row instead of once in the pushed filter and again in the
    projection.
    """
    packed = F.struct(*[F.col(c).alias(c) for c in cols])
    out = df.withColumn("_fence", F.explode(F.array(packed)))
    for c in cols:
        out = out.withColumn(c, F.col(f"_fence.{c}"))
    return out.drop("_fence")
