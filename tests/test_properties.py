"""Property checks of scalar parsing against plain Python implementations."""

import datetime as dt
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from articleflow.functions import rfc3339

SHAPE = re.compile(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d([.,]\d+)?(Z|[+-]\d\d:\d\d)$")


def py_rfc3339(text):
    """Reference: the strict shape, then a calendar-valid parse, in UTC micros."""
    if not SHAPE.match(text):
        return None
    t = text.replace(",", ".").replace("Z", "+00:00")
    m = re.match(r"^(.*T\d\d:\d\d:\d\d)(\.\d+)?([+-]\d\d:\d\d)$", t)
    frac = (m.group(2) or ".0")[1:7].ljust(6, "0")
    try:
        d = dt.datetime.fromisoformat(m.group(1) + "." + frac + m.group(3))
    except ValueError:
        return None
    return int(d.timestamp() * 1_000_000) if abs(d.timestamp()) < 1e10 else None


texts = st.one_of(
    st.builds(lambda y, mo, d, h, mi, s, frac, z: f"{y:04d}-{mo:02d}-{d:02d}T{h:02d}:{mi:02d}:{s:02d}{frac}{z}",
              st.integers(1970, 2100), st.integers(1, 12), st.integers(1, 28), st.integers(0, 23),
              st.integers(0, 59), st.integers(0, 59),
              st.sampled_from(["", ".5", ".250", ",125", ".123456"]),
              st.sampled_from(["Z", "+02:00", "-05:30", "", "+0200"])),
    st.sampled_from(["", "2024-01-02", "2024-01-02 03:04:05Z", "not a time", "2024-13-01T00:00:00Z",
                     "2024-01-02T03:04:05z"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, min_size=1, max_size=40))
def test_rfc3339_matches_python(spark, values):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, t string")
    got = {r.i: r.us for r in df.select("i", F.unix_micros(rfc3339("t")).alias("us")).collect()}
    assert got == {i: py_rfc3339(v) for i, v in enumerate(values)}
