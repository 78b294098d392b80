"""Source registry (A1) and the page request plan (A2)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import schema as S
from articleflow.functions import str0

# Request defaults of a feed without pagination settings.
DEFAULT_PAGE_PARAM = "page"
DEFAULT_LIMIT_PARAM = "pageSize"
DEFAULT_LIMIT = 20


def _ok_text(v: Column) -> Column:
    return v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")


def parse_sources(files: DataFrame, known_parsers: list[str] | None = None,
                  value: str = "value") -> DataFrame:
    """A1 on registry documents already loaded as text (one JSON array per row).

    A document that does not decode -- malformed, not an array, or any entry
    with a wrong-typed field -- yields no source at all.  Entries are checked
    in order: name, url, url prefix ``http``, parser, parser known; the first
    failing rule is the ``reject_reason`` and ``valid`` is its absence.
    """
    from articleflow.operators.parse import PARSERS
    known = known_parsers or list(PARSERS)
    text = F.col(value)
    wrapped = F.concat(F.lit('{"a":'), text, F.lit("}"))
    sch = T.StructType([T.StructField("a", T.ArrayType(S.SOURCE)), T.StructField("_corrupt", T.StringType())])
    parsed = F.from_json(wrapped, sch, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"})
    typed = F.from_json(text, "array<struct<name variant, url variant, transformer variant, "
                              "pagination struct<type variant, page_param variant, limit_param variant>>>")
    strict_ok = F.forall(F.coalesce(typed, F.array()), lambda s: _ok_text(s["name"]) & _ok_text(s["url"])
                         & _ok_text(s["transformer"]) & _ok_text(s["pagination"]["type"])
                         & _ok_text(s["pagination"]["page_param"]) & _ok_text(s["pagination"]["limit_param"]))
    decodes = (parsed.isNotNull() & parsed["_corrupt"].isNull() & F.ltrim(text).startswith("[") & strict_ok)
    keep = [c for c in files.columns if c != value]
    rows = (files.select(*keep, F.when(decodes, parsed["a"]).alias("a"))
                 .select(*keep, F.posexplode("a").alias("pos", "s"))
                 .select(*keep, F.col("pos").cast("long").alias("pos"),
                         str0("s.name").alias("name"), str0("s.url").alias("url"),
                         str0("s.transformer").alias("transformer"),
                         F.struct(str0("s.pagination.type").alias("type"),
                                  str0("s.pagination.page_param").alias("page_param"),
                                  str0("s.pagination.limit_param").alias("limit_param"),
                                  F.coalesce("s.pagination.default_limit", F.lit(0).cast("long")).alias("default_limit"))
                          .alias("pagination")))
    # The reject texts.
    reason = (F.when(F.col("name") == "", F.lit("name is required"))
               .when(F.col("url") == "", F.lit("url is required"))
               .when(~F.col("url").startswith("http"), F.lit("url must start with http"))
               .when(F.col("transformer") == "", F.lit("transformer is required"))
               .when(~F.col("transformer").isin(*known), F.lit("unknown transformer")))
    return rows.withColumn("reject_reason", reason).withColumn("valid", reason.isNull())


def load_sources(spark: SparkSession, path: str, known_parsers: list[str] | None = None,
                 default: dict | None = None, require: bool = False):
    """A1: read registry file(s) at ``path`` -> ``(valid, rejected)``.

    A missing file gives the ``default`` feed (a dict of the source fields)
    when one is configured, else an empty registry.  ``require=True`` fails
    when no valid source is left (checked with a one-row action).
    """
    try:
        files = spark.read.text(path, wholetext=True)
        files.schema  # noqa: B018  (resolves the path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        rows = [] if default is None else [(default.get("name", ""), default.get("url", ""),
                                            default.get("transformer", ""), None)]
        files = spark.createDataFrame(
            [("[" + ",".join(
                '{"name":%s,"url":%s,"transformer":%s}' % tuple(_json_str(x) for x in r[:3]) for r in rows) + "]",)],
            "value string")
    out = parse_sources(files, known_parsers)
    valid, rejected = out.filter("valid"), out.filter(~F.col("valid"))
    if require and valid.limit(1).count() == 0:
        raise ValueError("no valid sources configured")
    return valid, rejected


def _json_str(x: str) -> str:
    import json
    return json.dumps(x)


def plan_pages(sources: DataFrame, max_pages: int | Column) -> DataFrame:
    """A2: the request URL of pages ``0 .. max_pages-1`` of every source;
    ``max_pages`` is a number or a column (none below 1).

    Separator ``&`` when the URL already holds ``?``, else ``?``; parameter
    names default to page / pageSize and the limit to 20; ``offset`` paging
    sends ``page * limit``, any other type the 0-based page number.  Pages
    are generated per source row with ``explode(sequence)``: no join.
    """
    n = F.lit(max_pages).cast("long") if isinstance(max_pages, int) else max_pages.cast("long")
    pg = F.col("pagination")
    page_param = F.when(str0(pg["page_param"]) != "", pg["page_param"]).otherwise(F.lit(DEFAULT_PAGE_PARAM))
    limit_param = F.when(str0(pg["limit_param"]) != "", pg["limit_param"]).otherwise(F.lit(DEFAULT_LIMIT_PARAM))
    limit = F.when(F.coalesce(pg["default_limit"], F.lit(0)) > 0, pg["default_limit"]).otherwise(F.lit(DEFAULT_LIMIT)).cast("long")
    page = F.col("page_no")
    value = F.when(str0(pg["type"]) == "offset", page * limit).otherwise(page)
    sep = F.when(F.col("url").contains("?"), F.lit("&")).otherwise(F.lit("?"))
    keep = [c for c in sources.columns if c not in ("pagination",)]
    return (sources.select(*keep, "pagination", F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1))).alias("page_no"))
                   .select(*keep, "page_no",
                           F.concat(F.col("url"), sep, page_param, F.lit("="), value.cast("string"),
                                    F.lit("&"), limit_param, F.lit("="), limit.cast("string")).alias("request_url")))
