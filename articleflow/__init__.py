"""articleflow: a PySpark engine for paged article feeds.

Landed JSON pages are parsed into one article schema, de-duplicated, hashed and
compared with a versioned article store to give an exact change feed; the same
DataFrame functions run as batch jobs and under Structured Streaming.  On top
of the pipeline's output sit the operational analytics: counters, cumulative
histograms, quantiles, counter rates, alert intervals, failure streaks, log
sampling and retention tiers.
"""

__version__ = "0.1.0"
