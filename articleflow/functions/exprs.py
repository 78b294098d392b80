"""Scalar column expressions.

All are plain ``pyspark.sql.functions`` compositions, so they stay inside
whole-stage codegen; none is a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from articleflow.schema import HASH_COLS

# Fixed value: the RFC 3339 shape accepted for feed timestamps (date, 'T',
# time, optional fraction with '.' or ',', then 'Z' or a +hh:mm/-hh:mm offset).
RFC3339_PATTERN = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def str0(c) -> Column:
    """Zero-value string: NULL (absent field) becomes ''."""
    return F.coalesce(_col(c), F.lit(""))


def rfc3339(c) -> Column:
    """Strict RFC 3339 text -> TIMESTAMP, NULL when the text is not RFC 3339.

    ``try_to_timestamp`` alone also accepts date-only and zone-less text, hence
    the anchored shape check first.
    """
    c = _col(c)
    return F.when(c.rlike(RFC3339_PATTERN),
                  F.try_to_timestamp(F.regexp_replace(c, ",", ".")))


def epoch_ms_to_ts(c) -> Column:
    """Epoch milliseconds -> TIMESTAMP in whole seconds, truncating toward zero
    (``%`` keeps the dividend's sign, so negative values truncate up)."""
    ms = F.coalesce(_col(c).cast("long"), F.lit(0).cast("long"))
    return F.timestamp_seconds(((ms - ms % 1000) / 1000).cast("long"))


def epoch_us(c) -> Column:
    """TIMESTAMP or TIMESTAMP_NTZ -> epoch microseconds (UTC session)."""
    return F.unix_micros(_col(c).cast("timestamp"))


def elapsed_seconds(start, end) -> Column:
    return (epoch_us(end) - epoch_us(start)) / F.lit(1e6)


def truncate_ellipsis(c, n: int = 10) -> Column:
    """First ``n`` characters plus '...'; short text is kept whole."""
    return F.concat(F.substring(str0(c), 1, n), F.lit("..."))


def content_hash(*cols: str) -> Column:
    """Lower-hex SHA-256 over the hash fields concatenated without separator."""
    cols = cols or tuple(HASH_COLS)
    return F.sha2(F.concat(*[str0(c) for c in cols]), 256)


def anchored_match(c, pattern: str) -> Column:
    """Label matcher ``=~``: the regex must match the whole value."""
    return _col(c).rlike(f"^(?:{pattern})$")


# Gauge codes as text -- breaker state 0 closed, 1 half-open,
# 2 open; up 0 down, 1 up.
BREAKER_STATE_TEXT = {0: "closed", 1: "half-open", 2: "open"}
UP_TEXT = {0: "down", 1: "up"}


def code_text(c, mapping: dict) -> Column:
    """Map a numeric gauge code to its text (NULL for unknown codes)."""
    pairs = []
    for k, v in mapping.items():
        pairs += [F.lit(float(k)), F.lit(v)]
    return F.element_at(F.create_map(*pairs), _col(c).cast("double"))
