"""Metric series queries (D8, D9, E4-E7): rates, quantiles, instant values,
evaluation grids and alert intervals over a sample table.

A sample table has one row per observation: label columns (the series key),
``ts`` and ``value``.  Increases follow these rules (no extrapolation):
the delta of a sample is ``value - previous`` or, after a counter reset
(a drop), ``value``; a series' first sample has delta 0; ``increase`` over a
window ending at t sums the deltas of the samples in ``[t - window, t]``;
``rate`` = increase / window seconds.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.functions import anchored_match, epoch_us
from articleflow.operators.joins import join_null_safe
from articleflow.operators.skew import chunked_lag, chunked_running

US = 1_000_000
DAY_US = 86_400 * US


def select_series(samples: DataFrame, metric: str | None = None, **matchers: str) -> DataFrame:
    """Label matcher: ``label="x"`` exact, ``label="~regex"`` anchored regex."""
    df = samples if metric is None else samples.filter(F.col("metric") == metric)
    for label, m in matchers.items():
        df = df.filter(anchored_match(label, m[1:]) if m.startswith("~") else (F.col(label) == m))
    return df


def counter_deltas(samples: DataFrame, series: Sequence[str], chunk_us: int = DAY_US) -> DataFrame:
    """Add ``ts_us`` and ``delta`` per sample (reset-aware, first = 0).

    The previous sample is found with a lag split by time chunk, so a series
    holding most samples is still spread over many tasks.  Samples of equal
    time are taken in order of value, so a tie is never read as a reset.
    """
    df = (samples.withColumn("ts_us", epoch_us("ts"))
                 .withColumn("_chunk", F.floor(F.col("ts_us") / F.lit(chunk_us)).cast("long"))
                 .withColumn("_v", F.col("value").cast("double")))
    df = chunked_lag(df, list(series), ["ts_us", "_v"], "_chunk", "_v", "_prev")
    delta = (F.when(F.col("_prev").isNull(), F.lit(0.0))
              .when(F.col("_v") >= F.col("_prev"), F.col("_v") - F.col("_prev"))
              .otherwise(F.col("_v")))
    return df.withColumn("delta", delta).drop("_prev", "_v", "_chunk")


def range_sum(df: DataFrame, keys: Sequence[str], ts_us: str, value: str, window_us: int,
              out: str, chunk_us: int | None = None, keep_chunk: bool = False) -> DataFrame:
    """``out`` = sum of ``value`` over the key's rows with ``ts`` in
    ``[ts - window, ts]`` -- a RANGE window, split into time chunks of at
    least the window: each row also joins the next chunk as context when it
    is within one window of it, so every task sees a bounded slice of a
    series and no self join is needed.  ``keep_chunk`` leaves the row's chunk
    number in ``_chunk``."""
    chunk_us = max(chunk_us or DAY_US, window_us)
    c = F.floor(F.col(ts_us) / F.lit(chunk_us)).cast("long")
    own = df.withColumn("_chunk", c).withColumn("_own", F.lit(True))
    ctx = (df.filter(F.col(ts_us) >= (c + 1) * F.lit(chunk_us) - F.lit(window_us))
             .withColumn("_chunk", c + 1).withColumn("_own", F.lit(False)))
    w = (Window.partitionBy(*keys, "_chunk").orderBy(F.col(ts_us))
         .rangeBetween(-window_us, Window.currentRow))
    return (own.unionByName(ctx).withColumn(out, F.sum(value).over(w))
               .filter("_own").drop("_own", *([] if keep_chunk else ["_chunk"])))


def counter_increase(samples: DataFrame, series: Sequence[str], window_s: int,
                     chunk_us: int = DAY_US) -> DataFrame:
    """``increase`` and ``rate`` (per second) of a counter at every sample."""
    d = counter_deltas(samples, series, chunk_us)
    out = range_sum(d, series, "ts_us", "delta", window_s * US, "increase", chunk_us)
    return out.withColumn("rate", F.col("increase") / F.lit(float(window_s)))


def latest_value(samples: DataFrame, series: Sequence[str], at, lookback_s: int | None = None) -> DataFrame:
    """E5: the instant value of every series at time ``at``: its last sample
    at or before ``at`` (and within ``lookback_s`` when given)."""
    at_c = F.lit(at).cast("timestamp")
    df = samples.filter(F.col("ts").cast("timestamp") <= at_c)
    if lookback_s is not None:
        df = df.filter(F.col("ts").cast("timestamp") >= at_c - F.expr(f"INTERVAL {int(lookback_s)} SECONDS"))
    return df.groupBy(*series).agg(F.max_by("value", F.struct(epoch_us("ts"), "value")).alias("value"),
                                   F.max(epoch_us("ts")).alias("ts_us"))


def sum_counter(samples: DataFrame, series: Sequence[str], at, by: Sequence[str] = (),
                lookback_s: int | None = None) -> DataFrame:
    """``sum(m)`` / ``sum by (labels)(m)`` of the instant values at ``at``."""
    return latest_value(samples, series, at, lookback_s).groupBy(*by).agg(F.sum("value").alias("value"))


def sum_increase(samples: DataFrame, series: Sequence[str], at, window_s: int, by: Sequence[str] = ()) -> DataFrame:
    """D9 over a window: ``sum by (labels)(increase(m[window]))`` at ``at``,
    and the ``rate`` per second; 0 for a group silent in the window."""
    at_c = F.lit(at).cast("timestamp")
    d = counter_deltas(samples.filter(F.col("ts").cast("timestamp") <= at_c), series)
    inside = F.col("ts_us") >= epoch_us(at_c) - F.lit(window_s * US)
    return (d.groupBy(*by).agg(F.sum(F.when(inside, F.col("delta")).otherwise(0.0)).alias("increase"))
             .withColumn("rate", F.col("increase") / F.lit(float(window_s))))


def histogram_quantile(hist: DataFrame, q: float | Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """Quantile ``q`` (or each of several) from cumulative buckets
    (``le_value`` ascending, +Inf last, ``cumulative_count``): the first
    bucket reaching ``q * total`` is interpolated linearly from its lower
    bound (0 for the first bucket); in the +Inf bucket the answer is the
    largest finite bound; NaN when the total is 0.  A group's buckets (one per
    bound) are gathered once, whatever the number of quantiles."""
    per = hist.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(
        "le_value", F.col("cumulative_count").cast("double").alias("c")))).alias("_b"))
    b = F.col("_b")
    per = (per.withColumn("_total", F.array_max(F.transform(b, lambda x: x["c"])))
              .withColumn("_max_finite", F.array_max(F.transform(F.filter(b, lambda x: x["le_value"] < float("inf")),
                                                                 lambda x: x["le_value"]))))

    def one(p: float) -> Column:
        rank = F.lit(float(p)) * F.col("_total")
        at = F.array_position(F.transform(b, lambda x: x["c"] >= rank), True).cast("int") - 1   # -1: none
        hit, low = F.get(b, at), F.get(b, at - 1)
        before = F.coalesce(low["c"], F.lit(0.0))
        lower = F.coalesce(low["le_value"], F.lit(0.0))
        inside = hit["c"] - before
        value = (F.when(F.col("_total") == 0, F.lit(float("nan")))
                  .when(hit["le_value"] == float("inf"), F.col("_max_finite"))
                  .when(inside == 0, hit["le_value"])
                  .otherwise(lower + (hit["le_value"] - lower) * (rank - before) / inside))
        return F.when(at >= 0, F.struct(F.lit(float(p)).alias("q"), value.alias("value")))
    several = F.array(*[one(p) for p in ([q] if isinstance(q, (int, float)) else q)])
    return per.select(*by, F.inline(F.filter(several, lambda x: x.isNotNull())))


def bucket_bound(le: Column) -> Column:
    """The label ``le`` as a number."""
    return F.when(le == "+Inf", F.lit(float("inf"))).otherwise(le.cast("double"))


def rate_quantile(samples: DataFrame, q: float | Sequence[float], series: Sequence[str], step_s: int, window_s: int,
                  end_us: int | None = None) -> DataFrame:
    """D8 over windowed rates: quantile ``q`` (or each of several, from one
    grid) of the bucket counters (label ``le``) of every series at each step
    (``eval_us``); NaN for a window without observations."""
    rates = evaluation_grid(samples, [*series, "le"], step_s, window_s, end_us=end_us)
    hist = rates.withColumn("le_value", bucket_bound(F.col("le"))).withColumn("cumulative_count", F.col("rate"))
    return histogram_quantile(hist, q, [*series, "eval_us"])


def dense_buckets(span: DataFrame, series: Sequence[str], lo: str, hi: str,
                  chunk_buckets: int) -> DataFrame:
    """Every bucket number ``lo .. hi`` of every series, generated per
    ``(series, chunk)`` after a repartition, so one long series is spread
    over many tasks instead of being exploded by one."""
    c = F.floor(F.col(lo) / F.lit(chunk_buckets)).cast("long")
    ch = (span.select(*series, lo, hi, F.explode(F.sequence(c, F.floor(F.col(hi) / F.lit(chunk_buckets)).cast("long")))
                      .alias("_chunk"))
              .repartition(*series, "_chunk"))
    first = F.greatest(F.col(lo), F.col("_chunk") * F.lit(chunk_buckets))
    last = F.least(F.col(hi), F.col("_chunk") * F.lit(chunk_buckets) + F.lit(chunk_buckets - 1))
    return ch.select(*series, F.explode(F.sequence(first, last)).alias("bucket"))


def last_bucket(samples: DataFrame, step_us: int, end_us: int | None, more: int = 0) -> Column:
    """Last step bucket to evaluate: the one ending at ``end_us``, or ``more``
    after the one that holds the latest sample of any series."""
    if end_us is not None:
        return F.lit(end_us // step_us - 1).cast("long")
    latest = samples.select(F.max(epoch_us("ts"))).scalar()
    return (F.floor(latest / F.lit(step_us)) + F.lit(more)).cast("long")


def evaluation_grid(samples: DataFrame, series: Sequence[str], step_s: int, window_s: int,
                    chunk_us: int = DAY_US, start_us: int | None = None, end_us: int | None = None) -> DataFrame:
    """Evaluate ``increase``/``rate`` of every series on a fixed grid.

    Every series is evaluated up to ``end_us`` (default: until the latest
    sample of all series has left the window), so one that fell silent counts
    as zero there; from its own first sample, or ``start_us`` if later.

    The evaluation at ``eval_us = (b + 1) * step`` covers samples with ts in
    ``[eval - window, eval)`` (window a multiple of step).  Deltas are summed
    per step bucket (one aggregation), the grid is made dense per series so
    empty steps count 0 (generated per time chunk, see
    :func:`dense_buckets`), and the window is a range sum over bucket
    numbers split into time chunks.  Grid size is bounded by the time span,
    not by the number of samples, and no task holds a whole series.
    """
    if window_s % step_s:
        raise ValueError("window must be a multiple of step")
    k = window_s // step_s
    step_us = step_s * US
    chunk_buckets = max(k, chunk_us // step_us)
    d = counter_deltas(samples, series, chunk_us).withColumn(
        "bucket", F.floor(F.col("ts_us") / F.lit(step_us)).cast("long"))
    sums = d.groupBy(*series, "bucket").agg(F.sum("delta").alias("_d"))
    span = (sums.groupBy(*series).agg(F.min("bucket").alias("_lo"))
                .withColumn("_hi", last_bucket(samples, step_us, end_us, k - 1)).where("_lo <= _hi"))
    grid = dense_buckets(span, series, "_lo", "_hi", chunk_buckets)
    dense = join_null_safe(grid, sums, [*series, "bucket"], "left").fillna(0.0, subset=["_d"])
    out = range_sum(dense, series, "bucket", "_d", k - 1, "increase", chunk_buckets)
    out = (out.withColumn("rate", F.col("increase") / F.lit(float(window_s)))
              .withColumn("eval_us", (F.col("bucket") + 1) * F.lit(step_us))
              .drop("_d", "bucket"))
    return out if start_us is None else out.where(F.col("eval_us") >= start_us)


def condition_runs(rows: DataFrame, series: Sequence[str], at: str, condition: Column, chunk: int,
                   hold: int) -> DataFrame:
    """Runs of consecutive rows of a series where ``condition`` holds:
    ``start`` and ``last`` row of the run, ``next`` (the row after it, NULL at
    the end) and ``fire`` (first row of the run at least ``hold`` after its
    start, NULL if none).  ``at`` is the order, a whole number, unique in a
    series.

    One shuffle gathers the rows of a (series, chunk); what is left of it are
    pieces: maximal runs inside the chunk, each with its rows up to the first
    that could fire.  A piece that ends before the chunk does is a run of its
    own.  Only the first and the last piece of a chunk (or the lack of one)
    meet those of the neighbour chunks, two rows a chunk, in a second, narrow
    shuffle; nothing is joined back.
    """
    rows = rows.select(*series, F.col(at).cast("long").alias("_t"), F.coalesce(condition, F.lit(False)).alias("_c"))
    per = (rows.withColumn("_chunk", F.floor(F.col("_t") / F.lit(chunk)).cast("long")).groupBy(*series, "_chunk")
               .agg(F.sort_array(F.collect_list(F.struct("_t", "_c"))).alias("_r")))
    r = F.col("_r")
    # between two neighbours of -1, the false rows, n lies a piece
    per = per.withColumn("_f", F.concat(F.array(F.lit(-1)), F.filter(
        F.transform(r, lambda x, i: F.when(~x["_c"], i)), lambda i: i.isNotNull()), F.array(F.size(r))))
    f = F.col("_f")

    def piece(lo: Column, hi: Column) -> Column:
        own = F.slice(r, lo + 2, hi - lo - 1)
        first = F.get(r, lo + 1)["_t"]
        # the rows of the piece up to the first that lies ``hold`` after its start
        late = F.array_position(F.transform(own, lambda x: x["_t"] >= first + hold), True).cast("int")
        times = F.transform(F.when(late > 0, F.slice(own, 1, late)).otherwise(own), lambda x: x["_t"])
        some = hi - lo > 1
        return F.struct((lo == -1).alias("left"), (hi == F.size(r)).alias("right"), some.alias("some"),
                        F.when(some, first).alias("start"), F.when(some, F.get(r, hi - 1)["_t"]).alias("last"),
                        F.get(r, hi)["_t"].alias("next"), F.when(some, times).alias("times"))
    pieces = F.zip_with(F.slice(f, 1, F.size(f) - 1), F.slice(f, 2, F.size(f) - 1), piece)
    kept = F.filter(pieces, lambda p: p["some"] | p["left"] | p["right"])
    row = per.select(*series, "_chunk", F.get(r, F.lit(0))["_t"].alias("_first"), F.inline(kept))
    # inner pieces stay with their chunk, edges meet
    row = row.withColumn("_meet", F.when(~F.col("left") & ~F.col("right"), F.col("_chunk")))
    w = Window.partitionBy(*series, "_meet").orderBy("_chunk", F.coalesce("start", "_first"), F.col("right"))
    before = F.coalesce(F.lag(F.col("some") & F.col("right")).over(w), F.lit(False))
    row = (row.withColumn("_new", (~(F.col("some") & F.col("left") & before)).cast("long"))
              .withColumn("_after", F.when(F.col("right"), F.lead("_first").over(w)).otherwise(F.col("next")))
              .withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    runs = (row.where("some").groupBy(*series, "_meet", "_run")
               .agg(F.min("start").alias("start"), F.max("last").alias("last"), F.max_by("_after", "start").alias("next"),
                    F.flatten(F.collect_list("times")).alias("_times")))
    fire = F.array_min(F.filter("_times", lambda t: t >= F.col("start") + hold))
    return runs.select(*series, "start", "last", "next", fire.alias("fire"))


def alert_intervals(evaluations: DataFrame, series: Sequence[str], condition: Column,
                    hold_s: int, ts_us: str = "eval_us", chunk_us: int = DAY_US) -> DataFrame:
    """Runs of consecutive evaluations where ``condition`` holds, with
    ``start_us``, ``end_us`` (last true evaluation) and ``fire_us`` (first
    evaluation at least ``hold`` after the start; NULL if the run is
    shorter: pending only).  See :func:`condition_runs`; no series is ever in
    one task."""
    runs = condition_runs(evaluations, series, ts_us, condition, chunk_us, hold_s * US)
    return runs.select(*series, F.col("start").alias("start_us"), F.col("last").alias("end_us"), F.col("fire").alias("fire_us"))


def step_sums(samples: DataFrame, series: Sequence[str], step_us: int, chunk_us: int) -> DataFrame:
    """``_d``: the sum of a counter's deltas in each step (``bucket``) that
    holds a sample."""
    d = counter_deltas(samples, series, chunk_us).withColumn(
        "bucket", F.floor(F.col("ts_us") / F.lit(step_us)).cast("long"))
    return d.groupBy(*series, "bucket").agg(F.sum("delta").alias("_d"))


def rate_alert_intervals(samples: DataFrame, series: Sequence[str], step_s: int, window_s: int,
                         op: str, threshold: float, hold_s: int, measure: str = "rate",
                         chunk_us: int = DAY_US, end_us: int | None = None) -> DataFrame:
    """E6 for counter rules without materialising the grid.

    Same result as ``alert_intervals(evaluation_grid(...), ...)`` (same
    ``start_us``/``end_us``/``fire_us``), but the windowed sum over step
    buckets only changes at a bucket holding samples (it enters the window)
    or ``k`` buckets later (it leaves), so it is evaluated at those change
    points only and each constant segment runs to the next change point:
    O(samples) rows instead of O(time span / step) per series.  A step gives
    both of its points by one explode; nothing is evaluated twice.
    """
    if window_s % step_s:
        raise ValueError("window must be a multiple of step")
    k = window_s // step_s
    step_us = step_s * US
    chunk_b = max(k, chunk_us // step_us)
    sums = step_sums(samples, series, step_us, chunk_us)
    end_b = last_bucket(samples, step_us, end_us, k - 1)
    both = sums.select(*series, F.inline(F.array(
        F.struct("bucket", "_d"), F.struct((F.col("bucket") + F.lit(k)).alias("bucket"), F.lit(0.0).alias("_d")))))
    both = both.groupBy(*series, "bucket").agg(F.sum("_d").alias("_d"))
    val = range_sum(both, series, "bucket", "_d", k - 1, "increase", chunk_b, keep_chunk=True).where(F.col("bucket") <= end_b)
    val = val.withColumn("rate", F.col("increase") / F.lit(float(window_s)))
    return point_intervals(val, series, compare(F.col(measure), op, threshold), end_b, step_us, hold_s)


def quantile_alert_intervals(samples: DataFrame, q: float, series: Sequence[str], step_s: int, window_s: int,
                             op: str, threshold: float, hold_s: int, chunk_us: int = DAY_US,
                             end_us: int | None = None) -> DataFrame:
    """E6 for quantile rules without the grid: equal to
    ``alert_intervals(rate_quantile(...), ...)``.

    The quantile of a series can change only where the windowed rate of one
    of its buckets (label ``le``) changes: at a step holding a sample of any
    bucket, or a window later.  At these change points every bucket that has
    begun by then gets its windowed rate, and only there is interpolated.
    """
    if window_s % step_s:
        raise ValueError("window must be a multiple of step")
    k = window_s // step_s
    step_us = step_s * US
    chunk_b = max(k, chunk_us // step_us)
    keys = [*series, "le"]
    sums = step_sums(samples, keys, step_us, chunk_us)
    end_b = last_bucket(samples, step_us, end_us, k - 1)
    # all branches read the same columns of ``sums``, so its exchange is reused
    steps = sums.groupBy(*series, "bucket").agg(F.count("_d").alias("_n"), F.collect_set("le").alias("_les"))
    points = (steps.where("_n > 0 and size(_les) > 0")
                   .select(*series, F.explode(F.array(F.col("bucket"), F.col("bucket") + F.lit(k))).alias("bucket"))
                   .where(F.col("bucket") <= end_b).distinct())
    begun = sums.groupBy(*keys).agg(F.min("bucket").alias("_lo"), F.count("_d").alias("_n")).where("_n > 0").drop("_n")
    at = (join_null_safe(points, begun, list(series)).where(F.col("bucket") >= F.col("_lo"))
          .select(*keys, "bucket", F.lit(0.0).alias("_d"), F.lit(True).alias("_pt")))
    both = (at.unionByName(sums.select(*keys, "bucket", "_d", F.lit(False).alias("_pt")))
              .groupBy(*keys, "bucket").agg(F.sum("_d").alias("_d"), F.max("_pt").alias("_pt")))
    val = range_sum(both, keys, "bucket", "_d", k - 1, "increase", chunk_b).where("_pt")
    hist = val.select(*series, "bucket", bucket_bound(F.col("le")).alias("le_value"),
                      (F.col("increase") / F.lit(float(window_s))).alias("cumulative_count"))
    at_points = in_chunks(histogram_quantile(hist, q, [*series, "bucket"]), chunk_b)
    return point_intervals(at_points, series, compare(F.col("value"), op, threshold), end_b, step_us, hold_s)


def condition_spans(rows: DataFrame, series: Sequence[str], order: Sequence[str], at: str,
                    condition: Column) -> DataFrame:
    """Runs of consecutive rows of a series where ``condition`` holds:
    ``start`` and ``next`` (the row after the run, NULL at the end), as
    :func:`condition_runs` without its last and firing rows.  ``rows`` have
    their chunk number in ``_chunk``; ``order`` sorts a chunk and agrees with
    ``at``, a whole number, unique in a series.

    Only rows at which the condition turns go on.  The first row of a chunk and
    a run that is open at its end meet those of the neighbour chunks in a
    second, narrow shuffle.
    """
    w = Window.partitionBy(*series, "_chunk").orderBy(*order)
    df = rows.select(*series, "_chunk", *order, F.col(at).cast("long").alias("_t"),
                     F.coalesce(condition, F.lit(False)).alias("_c"))
    df = df.withColumn("_p", F.lag("_c").over(w)).where("_p is null or _p <> _c").withColumn("_n", F.lead("_t").over(w))
    df = df.where("_p is null or _c").select(
        *series, "_chunk", "_t", "_c", "_n", F.col("_p").isNull().alias("_first"), F.expr("_c and _n is null").alias("_open"))
    # runs that lie inside a chunk stay with it, edges meet
    df = df.withColumn("_meet", F.when(~F.col("_first") & ~F.col("_open"), F.col("_chunk")))
    # a chunk's first row tells where a run open before it ends, NULL if not in the chunk
    ends = F.when(F.col("_first"), F.when(F.col("_c"), F.col("_n")).otherwise(F.col("_t")))
    back = Window.partitionBy(*series, "_meet").orderBy(F.col("_chunk").desc(), F.col("_t").desc())
    df = df.withColumns({"_later": F.last(ends, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1)),
                         "_before": F.coalesce(F.lead("_open").over(back), F.lit(False))})
    return (df.where("_c and not (_first and _before)")
              .select(*series, F.col("_t").alias("start"), F.when(F.col("_open"), F.col("_later")).otherwise(F.col("_n")).alias("next")))


def in_chunks(points: DataFrame, chunk_b: int) -> DataFrame:
    return points.withColumn("_chunk", F.floor(F.col("bucket") / F.lit(chunk_b)).cast("long"))


def point_intervals(points: DataFrame, series: Sequence[str], condition: Column, end_b: Column,
                    step_us: int, hold_s: int, order: Sequence[str] = ("bucket",)) -> DataFrame:
    """Alert intervals from change points (with their ``_chunk``): what
    ``condition`` reads at a point's ``bucket`` holds until just before the
    series' next point, or to ``end_b``."""
    runs = condition_spans(points, series, list(order), "bucket", condition)
    runs = runs.withColumn("_eb", F.coalesce(F.col("next") - 1, end_b))
    hold_b = -(-hold_s * US // step_us)  # ceil(hold / step) in buckets
    fire_b = F.col("start") + F.lit(hold_b)
    return runs.select(*series,
                       ((F.col("start") + 1) * F.lit(step_us)).alias("start_us"),
                       ((F.col("_eb") + 1) * F.lit(step_us)).alias("end_us"),
                       F.when(fire_b <= F.col("_eb"), (fire_b + 1) * F.lit(step_us)).alias("fire_us"))


def gauge_alert_intervals(samples: DataFrame, series: Sequence[str], step_s: int, op: str, threshold: float,
                          hold_s: int, chunk_us: int = DAY_US, end_us: int | None = None) -> DataFrame:
    """Alert intervals of a gauge rule: equal to :func:`alert_intervals` over
    :func:`gauge_grid`, but evaluated only in steps that hold a sample, so the
    work follows the samples and not the span.  The last sample of a step is
    found in the order in which the intervals are: one shuffle, one sort."""
    step_us = step_s * US
    end_b = last_bucket(samples, step_us, end_us)
    ts_us = epoch_us("ts")
    points = samples.select(*series, ts_us.alias("ts_us"), F.col("value").alias("_v"),
                            F.floor(ts_us / F.lit(step_us)).cast("long").alias("bucket"))
    points = in_chunks(points.where(F.col("bucket") <= end_b), max(1, chunk_us // step_us))
    order = ["ts_us", "_v"]
    after = F.lead("bucket").over(Window.partitionBy(*series, "_chunk").orderBy(*order))
    points = points.withColumn("_after", after).where("_after is null or _after <> bucket")
    return point_intervals(points, series, compare(F.col("_v"), op, threshold), end_b, step_us, hold_s, order)


def firing_now(intervals: DataFrame, evaluations: DataFrame, series: Sequence[str],
               ts_us: str = "eval_us") -> DataFrame:
    """Alerts firing at the last evaluation of their series."""
    last = evaluations.groupBy(*series).agg(F.max(ts_us).alias("end_us"))
    return join_null_safe(intervals.filter(F.col("fire_us").isNotNull()), last, [*series, "end_us"], "left_semi")


@dataclass(frozen=True)
class AlertRule:
    name: str
    metric: str
    matchers: dict
    expr: str          # 'rate', 'value' or 'p95'
    window_s: int
    op: str            # '>', '==', '<'
    threshold: float
    hold_s: int


# Five of the deployment's six alert rules (metric, matcher,
# expression, comparison, threshold, hold); evaluated every 30 s.  The sixth
# (:func:`service_down`) matches the name of the deployed service's job.
# Breaker "open" is state 2 here (the metric's own coding).
ALERT_EVERY_S = 30
ALERT_PRESETS = {
    "HighErrorRate": AlertRule("HighErrorRate", "articles_ingested_total", {"status": "~error.*"}, "rate", 300, ">", 0.16, 120),
    "NoArticlesProcessed": AlertRule("NoArticlesProcessed", "articles_ingested_total", {}, "rate", 300, "==", 0.0, 300),
    "KafkaConnectionDown": AlertRule("KafkaConnectionDown", "up", {"job": "kafka"}, "value", 0, "==", 0.0, 60),
    "CircuitBreakerOpen": AlertRule("CircuitBreakerOpen", "circuit_breaker_state", {}, "value", 0, "==", 2.0, 120),
    "SlowProviderFetch": AlertRule("SlowProviderFetch", "provider_fetch_duration_seconds", {}, "p95", 300, ">", 10.0, 300),
}


def service_down(job: str) -> AlertRule:
    """The sixth rule; ``job`` is the label of the watched service."""
    return AlertRule("ServiceDown", "up", {"job": job}, "value", 0, "==", 0.0, 60)


def compare(c: Column, op: str, threshold: float) -> Column:
    """``c op threshold``; NaN (the quantile of an empty window) never holds,
    although Spark orders it above every number."""
    return ~F.isnan(c) & {">": c > threshold, "<": c < threshold, "==": c == threshold, ">=": c >= threshold}[op]


def last_in_step(samples: DataFrame, series: Sequence[str], step_us: int) -> DataFrame:
    """``_v``: the last value of every series in each step that has a sample."""
    b = (samples.withColumn("ts_us", epoch_us("ts"))
                .withColumn("bucket", F.floor(F.col("ts_us") / F.lit(step_us)).cast("long")))
    return b.groupBy(*series, "bucket").agg(F.max_by("value", F.struct("ts_us", "value")).alias("_v"))


def gauge_grid(samples: DataFrame, series: Sequence[str], step_s: int, chunk_us: int = DAY_US,
               end_us: int | None = None) -> DataFrame:
    """Instant gauge value on the step grid: the last sample at or before each
    evaluation (carried forward over empty steps, across time chunks), up to
    ``end_us`` or the latest sample of all series."""
    step_us = step_s * US
    last = last_in_step(samples, series, step_us)
    span = (last.groupBy(*series).agg(F.min("bucket").alias("_lo"))
                .withColumn("_hi", last_bucket(samples, step_us, end_us)).where("_lo <= _hi"))
    chunk_buckets = max(1, chunk_us // step_us)
    grid = dense_buckets(span, series, "_lo", "_hi", chunk_buckets)
    g = (join_null_safe(grid, last, [*series, "bucket"], "left")
             .withColumn("_chunk", F.floor(F.col("bucket") / F.lit(chunk_buckets)).cast("long")))
    g = chunked_running(g, list(series), ["bucket"], "_chunk", {"value": ("last", F.col("_v"))})
    return (g.withColumn("eval_us", (F.col("bucket") + 1) * F.lit(step_us))
             .drop("_v", "bucket", "_chunk"))


def evaluate_rule(samples: DataFrame, rule: AlertRule, series: Sequence[str],
                  step_s: int = ALERT_EVERY_S, end_us: int | None = None) -> DataFrame:
    """Alert intervals of one rule on its evaluation grid (E7 -> E6), up to
    ``end_us``.

    All rules are evaluated at their change points, ``p95`` ones where the
    rate of any bucket (label ``le``) changes.
    """
    s = select_series(samples, rule.metric, **rule.matchers)
    if rule.expr == "rate":  # change points only, no dense grid
        return rate_alert_intervals(s, series, step_s, rule.window_s, rule.op, rule.threshold, rule.hold_s,
                                    end_us=end_us)
    if rule.expr == "value":
        return gauge_alert_intervals(s, series, step_s, rule.op, rule.threshold, rule.hold_s, end_us=end_us)
    return quantile_alert_intervals(s, 0.95, series, step_s, rule.window_s, rule.op, rule.threshold, rule.hold_s,
                                    end_us=end_us)
