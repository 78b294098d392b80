"""Ordered per-key counters: log sampling (E2) and failure streaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.operators.skew import chunked_running

DEFAULT_SAMPLE_EVERY = 10


def _running(df: DataFrame, keys: list[str], order: list[str], chunk: str | None,
             specs: dict[str, tuple[str, Column]]) -> DataFrame:
    """Running aggregates per key; split by ``chunk`` when given (skew-safe)."""
    if chunk is not None:
        return chunked_running(df, keys, order, chunk, specs)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    agg = {"sum": F.sum, "count": F.count, "max": F.max, "min": F.min}
    for name, (kind, expr) in specs.items():
        df = df.withColumn(name, agg[kind](expr).over(w))
    return df


def failure_streaks(df: DataFrame, keys: list[str], order: list[str], failed: str | Column,
                    threshold: int, chunk: str | None = None) -> DataFrame:
    """``streak`` = consecutive failures up to this row (reset by a success),
    ``tripped`` = ``streak >= threshold``.

    streak = failures so far - failures so far at the last success; both are
    running aggregates, so the key can be split into ordered chunks.
    """
    f = (F.col(failed) if isinstance(failed, str) else failed).cast("boolean")
    df = df.withColumn("_failed", F.coalesce(f, F.lit(False)))
    df = _running(df, keys, order, chunk, {"_cum_fail": ("sum", F.col("_failed").cast("long"))})
    df = _running(df, keys, order, chunk,
                  {"_at_ok": ("max", F.when(~F.col("_failed"), F.col("_cum_fail")))})
    return (df.withColumn("streak", (F.col("_cum_fail") - F.coalesce("_at_ok", F.lit(0))).cast("long"))
              .withColumn("tripped", F.col("streak") >= threshold)
              .drop("_failed", "_cum_fail", "_at_ok"))


def sample_nth(df: DataFrame, key: str, order: list[str], n: int = DEFAULT_SAMPLE_EVERY,
               reset: str | None = None, chunk: str | None = None,
               reset_all: str | None = None) -> DataFrame:
    """Number occurrences per key (``occurrence``) and flag ``emit`` for
    the 1st and every n-th (n, 2n, ...).  n < 1 means 10.

    Rows with ``reset`` true are control rows: they restart their key's count
    and are not occurrences themselves (``occurrence`` NULL, ``emit`` false).
    Rows with ``reset_all`` true restart every key: ``epoch_all`` is their
    running count over all rows, split by ``chunk`` (fine enough that a chunk
    of all keys fits a task).
    """
    n = n if n >= 1 else DEFAULT_SAMPLE_EVERY
    is_reset = F.coalesce(F.col(reset), F.lit(False)) if reset else F.lit(False)
    groups = [key, "epoch"]
    if reset_all:
        is_all = F.coalesce(F.col(reset_all), F.lit(False))
        df = _running(df, [], order, chunk, {"epoch_all": ("sum", is_all.cast("long"))})
        is_reset = is_reset | is_all
        groups.append("epoch_all")
    df = df.withColumn("_reset", is_reset)
    own = F.col("_reset") & ~(F.coalesce(F.col(reset_all), F.lit(False)) if reset_all else F.lit(False))
    df = _running(df, [key], order, chunk, {"epoch": ("sum", own.cast("long"))})
    df = _running(df, groups, order, chunk, {"_occ": ("sum", (~F.col("_reset")).cast("long"))})
    occ = F.when(~F.col("_reset"), F.col("_occ"))
    return (df.withColumn("occurrence", occ)
              .withColumn("emit", F.coalesce((occ == 1) | (occ % n == 0), F.lit(False)))
              .drop("_reset", "_occ"))


def sample_counts(sampled: DataFrame, key: str) -> DataFrame:
    """Current count per key after :func:`sample_nth`: occurrences since the
    key's last reset (0 when a reset -- its own or a reset of all keys --
    came after its last occurrence)."""
    groups = [key, "epoch"]
    keyed = sampled.filter(F.col(key).isNotNull())  # reset-all control rows carry no key
    last = keyed.groupBy(key).agg(F.max("epoch").alias("epoch"))
    if "epoch_all" in sampled.columns:
        final_all = sampled.select(F.max("epoch_all")).scalar()
        last = last.withColumn("epoch_all", final_all)
        groups.append("epoch_all")
    counts = keyed.groupBy(*groups).agg(F.count("occurrence").alias("count"))
    return (last.join(counts, groups, "left")
                .select(key, F.coalesce("count", F.lit(0)).cast("long").alias("count")))
