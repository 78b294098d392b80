"""Change log encoding / decoding and downstream routing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow import schema as S
from articleflow.session import scratch_path


def rfc3339_text(ts) -> Column:
    """TIMESTAMP -> RFC 3339 text in UTC with the fraction trimmed
    (``2024-01-05T10:00:00Z``, ``...00.25Z``); NULL (zero time) stays NULL."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    frac = F.regexp_replace(F.lpad((F.unix_micros(ts) % 1000000).cast("string"), 6, "0"), "0+$", "")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(frac != "", F.concat(F.lit("."), frac)).otherwise(F.lit("")), F.lit("Z"))


def article_json(df: DataFrame) -> Column:
    """Whole article as one JSON object, fields in schema order; NULL fields
    are written (``ignoreNullFields=false``), times as RFC 3339 text."""
    fields = []
    for f in S.ARTICLE.fields:
        c = F.col(f.name)
        if f.name in ("published_at", "updated_at", "fetched_at"):
            c = rfc3339_text(c)
        fields.append(c.alias(f.name))
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})


def to_change_events(articles: DataFrame) -> DataFrame:
    """``(key, value)`` = article id and the article as JSON."""
    return articles.select(F.col("id").alias("key"), article_json(articles).alias("value"))


def write_changes(events: DataFrame, path: str, partitions: int = 0) -> None:
    """A6 sink: same key -> same output partition (hash of the key), so all
    events of one article land in one file per batch, in order."""
    n = partitions or events.sparkSession.conf.get("spark.sql.shuffle.partitions")
    events.repartition(int(n), "key").write.mode("append").parquet(path)


def write_changes_kafka(events: DataFrame, servers: str, topic: str) -> None:
    """A6 sink on a Kafka topic (key = article id, value = JSON; the
    broker's default partitioner keeps one key on one partition).  Needs the
    Kafka connector on the classpath; at-least-once, so consumers drop
    repeats by ``(key, content_hash)``."""
    try:
        (events.select("key", "value").write.format("kafka")
               .option("kafka.bootstrap.servers", servers).option("topic", topic).save())
    except Exception as e:  # connector missing: say so plainly
        if "kafka" in str(e).lower() and "data source" in str(e).lower():
            raise RuntimeError("the Kafka connector is not installed; use write_changes (Parquet)") from e
        raise


def read_changes(events: DataFrame) -> DataFrame:
    """Decode change events; an undecodable message is dropped (it is
    not dead-lettered).  Undecodable = malformed JSON, a wrong-typed field
    (text fields are checked through VARIANT types, so a number is not
    silently taken as text), or a time that is neither null nor RFC 3339.
    Works on a batch or a streaming DataFrame."""
    from articleflow.functions import rfc3339
    from articleflow.operators.joins import fence
    text = F.col("value").cast("string")
    wire = ", ".join(f"{f.name} {'string' if f.name.endswith('_at') else f.dataType.simpleString()}"
                     for f in S.ARTICLE.fields)
    parsed = F.from_json(text, f"{wire}, _corrupt string",
                         {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    text_fields = [f.name for f in S.ARTICLE.fields if f.name in S.ARTICLE_STRING_COLS or f.name.endswith("_at")]
    typed = F.from_json(text, ", ".join(f"{c} variant" for c in text_fields)
                        + ", tags array<struct<label variant>>")
    d = fence(events.select(F.col("key").cast("string").alias("key"), parsed.alias("a"), typed.alias("v")), "a", "v")

    def ok_text(v):
        return v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")
    types_ok = F.lit(True)
    for c in text_fields:
        types_ok = types_ok & ok_text(F.col("v")[c])
    types_ok = types_ok & F.coalesce(F.forall(F.col("v")["tags"], lambda t: ok_text(t["label"])), F.lit(True))
    times_ok = F.lit(True)
    for f in S.ARTICLE.fields:
        if f.name.endswith("_at"):
            c = F.col(f"a.{f.name}")
            times_ok = times_ok & (c.isNull() | rfc3339(c).isNotNull())
    d = d.filter(F.col("a").isNotNull() & F.col("a._corrupt").isNull() & types_ok & times_ok)
    cols = []
    for f in S.ARTICLE.fields:
        c = F.col(f"a.{f.name}")
        if f.name.endswith("_at"):
            c = rfc3339(c)
        elif f.name in S.ARTICLE_STRING_COLS:
            c = F.coalesce(c, F.lit(""))
        cols.append(c.alias(f.name))
    return d.select("key", *cols)


def route(articles: DataFrame, outcome: Column) -> DataFrame:
    """A8 outcome per article: ``synced`` is the downstream call's result
    (a column expression, or a ``mapInPandas``-computed column upstream)."""
    return articles.withColumn("synced", F.coalesce(outcome, F.lit(False)))


def route_with(articles: DataFrame, call) -> DataFrame:
    """A8 with a Python downstream client: ``call(pandas.DataFrame) ->
    pandas.Series[bool]`` is applied to Arrow batches of articles
    (``mapInPandas``), adding ``synced``; one call per batch, not per row."""
    from pyspark.sql import types as T
    schema = T.StructType(list(articles.schema.fields) + [T.StructField("synced", T.BooleanType())])

    def run(batches):
        for pdf in batches:
            yield pdf.assign(synced=call(pdf).astype(bool).to_numpy())
    return articles.mapInPandas(run, schema)


def outcome_table(articles: DataFrame, outcome) -> DataFrame:
    """Articles with ``synced``, written once, so each article is sent once
    and later steps agree on its outcome."""
    marked = route(articles, outcome) if isinstance(outcome, Column) else route_with(articles, outcome)
    path = scratch_path(articles.sparkSession, "outcome")
    marked.write.option("compression", "zstd").partitionBy("synced").parquet(path)
    return articles.sparkSession.read.schema(marked.schema).parquet(path)


def sides(marked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(synced, dead_letters)`` of an outcome table."""
    synced = marked.filter(F.col("synced")).drop("synced")
    return synced, to_change_events(marked.filter(~F.col("synced")).drop("synced"))


def sync_and_route(articles: DataFrame, outcome):
    """``outcome`` (a bool column, or a Python client as in
    :func:`route_with`: downstream call succeeded) splits the decoded
    articles into ``(synced, dead_letters)``; a dead letter is the whole
    article re-encoded with the same key (A6 encoding).  The outcome is
    written once, so each article is sent once and lands on one side."""
    return sides(outcome_table(articles, outcome))
