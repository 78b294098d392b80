"""Skew-safe ordered window primitives.

A window ``partitionBy(key)`` puts every row of one key into one task; with a
key holding a third of the data that task is the job.  These helpers split a
key's ordered rows into chunks (``chunk`` must be non-decreasing in the
order, e.g. a run id or a time bucket), run the window per ``(key, chunk)``
and carry the state across chunks from a per-chunk aggregate, which is one row
per chunk and is computed with a partial (map-side) aggregation.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(xs):
    return [F.col(x) if isinstance(x, str) else x for x in xs]


def chunked_lag(df: DataFrame, keys: list[str], order: list[str], chunk: str,
                value: str, out: str) -> DataFrame:
    """``out`` = ``value`` of the previous row of the same key in ``order``
    (NULL for the key's first row).  ``value`` must not be NULL.

    What a chunk takes over from the one before is a row of its own, ahead of
    the chunk's rows in the window: no join shuffles and sorts them again."""
    last = (df.groupBy(*keys, chunk)
              .agg(F.max_by(F.col(value), F.struct(*_cols(order))).alias("_last")))
    carry = (last.withColumn("_carry", F.lag("_last").over(Window.partitionBy(*keys).orderBy(chunk)))
                 .drop("_last").where("_carry is not null"))
    own = F.col("_carry").isNull()
    w = Window.partitionBy(*keys, chunk).orderBy(own, *_cols(order))
    return (df.unionByName(carry, allowMissingColumns=True)
              .withColumn(out, F.lag(F.coalesce("_carry", value)).over(w)).where(own).drop("_carry"))


_COMBINE = {
    "sum": lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
    "count": lambda carry, local: F.coalesce(carry, F.lit(0)) + local,
    "max": lambda carry, local: F.greatest(carry, local),
    "min": lambda carry, local: F.least(carry, local),
    "last": lambda carry, local: F.coalesce(local, carry),
}
_AGG = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min,
        "last": lambda e: F.last(e, ignorenulls=True)}


def chunked_running(df: DataFrame, keys: list[str], order: list[str], chunk: str,
                    specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates over rows ``unbounded preceding .. current row``.

    ``specs`` maps an output name to ``(kind, expr)`` with kind in
    sum/count/max/min/last (last = last non-NULL value).  Equal to
    ``agg(expr).over(partitionBy(keys).orderBy(order)
    .rowsBetween(unboundedPreceding, currentRow))``.
    """
    def chunk_total(kind, e, n):
        if kind == "last":  # the chunk's last non-NULL value
            return F.max_by(e, F.when(e.isNotNull(), F.struct(*_cols(order)))).alias(f"_t_{n}")
        return _AGG[kind](e).alias(f"_t_{n}")
    tot = df.groupBy(*keys, chunk).agg(*[chunk_total(k, e, n) for n, (k, e) in specs.items()])
    wc = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carry_kind = {"count": "sum"}
    for name, (kind, _) in specs.items():
        tot = tot.withColumn(f"_c_{name}", _AGG[carry_kind.get(kind, kind)](f"_t_{name}").over(wc))
    carried = [f"_c_{n}" for n in specs]
    some = reduce(lambda x, y: x | y, [F.col(c).isNotNull() for c in carried])
    tot = tot.select(*keys, chunk, *carried, F.lit(True).alias("_carry")).where(some)
    # a chunk's carry is a row ahead of its rows, so nothing is joined back
    own = F.col("_carry").isNull()
    w = (Window.partitionBy(*keys, chunk).orderBy(own, *_cols(order))
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    res = df.unionByName(tot, allowMissingColumns=True)
    res = res.withColumns({**{f"_l_{n}": _AGG[k](F.when(own, e)).over(w) for n, (k, e) in specs.items()},
                           **{f"_f_{n}": F.first(f"_c_{n}").over(w) for n in specs}}).where(own)
    for name, (kind, _) in specs.items():
        res = res.withColumn(name, _COMBINE[kind](F.col(f"_f_{name}"), F.col(f"_l_{name}")))
    return res.drop("_carry", *[f"{x}{n}" for n in specs for x in ("_l_", "_f_", "_c_")])


def chunked_row_number(df: DataFrame, keys: list[str], order: list[str], chunk: str,
                       out: str = "rn") -> DataFrame:
    """``row_number()`` over ``partitionBy(keys).orderBy(order)``, split by chunk."""
    return chunked_running(df, keys, order, chunk, {out: ("count", F.lit(1))})
