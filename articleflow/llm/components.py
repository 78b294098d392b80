"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join; the
links of each round are a written table, so no lineage grows, nothing is
collected, and a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import written


def _signature(e: DataFrame):
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``links`` (a, b) -> (node, root): the smallest node of its component,
    for each node that has a link and is not the smallest itself."""
    e = written(links.where("a <> b")
                .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    sign = _signature(e)
    while sign[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.where("v > u").join(low, "u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u")
                 .select(F.inline(F.array(F.struct(F.col("u"), F.col("m").alias("v")),
                                          F.struct(F.col("v").alias("u"), F.col("m").alias("v")))))
                 .where("u <> v").distinct())
        e = written(small, "links")
        before, sign = sign, _signature(e)
        if sign == before:
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
