"""Log line ingestion (A10): decode the JSON message into the record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow.functions import rfc3339

DECODE_ERROR = "failed to decode message as JSON"
TIME_FIELD = "@timestamp"


def _is_object(msg: Column) -> Column:
    """The text is one JSON object."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(msg)).startswith("OBJECT"), F.lit(False))


def ingest_logs(lines: DataFrame, fields: T.StructType, message: str = "message",
                constants: dict[str, str] | None = None) -> DataFrame:
    """A10: decode ``message`` (JSON text) into top-level fields.

    Decoded keys overwrite equal top-level columns, also with an explicit
    null; a key that the message lacks leaves its column as it is.  ``error``
    holds a message when the text does not decode (the record is kept);
    ``constants`` are added as literal columns.  ``fields`` declares the keys
    that become columns (never inferred); :func:`ingest_objects` takes all.
    """
    msg = F.col(message)
    sch = T.StructType(list(fields.fields) + [T.StructField("_corrupt", T.StringType())])
    dec = F.from_json(msg, sch, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    df = lines.withColumn("_dec", dec).withColumn("_keys", F.json_object_keys(msg))
    ok = F.col("_dec").isNotNull() & F.col("_dec._corrupt").isNull() & F.ltrim(msg).startswith("{")
    df = df.withColumn("_ok", ok)
    for f in fields.fields:
        decoded = F.col(f"_dec.{f.name}")
        if f.name in lines.columns:
            given = F.col("_ok") & F.array_contains("_keys", f.name)
            df = df.withColumn(f.name, F.when(given, decoded.cast(lines.schema[f.name].dataType)).otherwise(F.col(f.name)))
        else:
            df = df.withColumn(f.name, F.when(F.col("_ok"), decoded))
    df = df.withColumn("error", F.when(~F.col("_ok"), F.lit(DECODE_ERROR)))
    for k, v in (constants or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df.drop("_dec", "_keys", "_ok")


def ingest_objects(lines: DataFrame, message: str = "message", constants: dict[str, str] | None = None,
                   out: str = "record") -> DataFrame:
    """A10 with every key of the message, declared or not.

    ``out`` is the record as a map from key to VARIANT value: the columns of
    the line, over them the keys of the decoded message, over these ``error``
    (text that is no JSON object: only the line's own columns are there) and
    ``constants``.  A key that the message sets to null overwrites, as a JSON
    null; a key it lacks does not; a message that repeats a key does not
    decode.  The record's ``@timestamp`` also becomes the column ``ts`` (NULL where it has
    none or it is no time).  Nothing is inferred or collected: the merge is a
    map expression.
    """
    msg, as_map = F.col(message), "map<string,variant>"
    own = F.from_json(F.to_json(F.struct(*lines.columns), {"ignoreNullFields": "false"}), as_map)
    constants = constants or {}
    extra = F.from_json(F.to_json(F.create_map(*[F.lit(x) for kv in constants.items() for x in kv])), as_map) \
        if constants else F.from_json(F.lit("{}"), as_map)
    error = F.from_json(F.to_json(F.create_map(F.lit("error"), F.lit(DECODE_ERROR))), as_map)
    told = F.when(F.col("_ok"), F.from_json(msg, as_map)).otherwise(error)

    def over(low: Column, high: Column) -> Column:
        keep = F.map_filter(low, lambda k, v: ~F.map_contains_key(high, k))
        return F.map_concat(keep, high)
    df = lines.withColumn("_ok", _is_object(msg)).withColumn("_told", told)
    df = df.withColumn(out, over(over(own, F.col("_told")), extra))
    stamp = F.col(out)[TIME_FIELD]
    text = F.when(F.schema_of_variant(stamp) == "STRING", F.try_variant_get(stamp, "$", "string"))
    return df.withColumn("ts", rfc3339(text)).drop("_ok", "_told")
