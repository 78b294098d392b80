"""Page payload parsing: raw pages -> articles.

A parser is a bundle of Column expressions over one page payload:

* ``schema``   - the payload's fixed StructType (never inferred);
* ``strict``   - payload -> bool, True when a field has the wrong JSON type in a
                 way ``from_json`` accepts silently (a number in a text field);
* ``articles`` - parsed page -> ARRAY<STRUCT<article fields>>;
* ``page_info``- parsed page -> STRUCT<page, numPages, pageSize, numEntries>.

Dispatch over several parsers is one ``CASE`` per column and one
``posexplode``: a single pass over the raw pages, whatever the number of
parsers.  A page that fails to decode fails as a whole (no row of it is
exploded), like the reference's per-page error.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from articleflow import schema as S
from articleflow.functions import epoch_ms_to_ts, rfc3339, str0, truncate_ellipsis

CORRUPT = "_corrupt"

# Parser names and the id / url prefixes they produce.
PULSELIVE = "pulselive"
ITEMS = "dummy"
ITEMS_URL_PREFIX = "http://dummy/"


def _ok_text(v: Column) -> Column:
    """A VARIANT holding JSON text, JSON null, or nothing (field absent)."""
    return v.isNull() | F.schema_of_variant(v).isin("STRING", "VOID")


@dataclass(frozen=True)
class Parser:
    name: str
    schema: T.StructType
    variant_ddl: str
    strict: Callable[[Column], Column]
    articles: Callable[[Column], Column]
    page_info: Callable[[Column], Column]


# ---------------------------------------------------------------- first feed
def _pulselive_strict_violation(v: Column) -> Column:
    def bad_item(x: Column) -> Column:
        ok = _ok_text(x["leadMedia"]["imageUrl"])
        for f in S.PULSELIVE_STRING_FIELDS:
            ok = ok & _ok_text(x[f])
        ok = ok & F.forall(F.coalesce(x["tags"], F.array()), lambda t: _ok_text(t["label"]))
        return ~ok
    return F.coalesce(F.exists(v["content"], bad_item), F.lit(False))


def _pulselive_articles(doc: Column) -> Column:
    def one(x: Column) -> Column:
        ext = F.coalesce(x["id"], F.lit(0).cast("long")).cast("string")
        summary = str0(x["summary"])
        desc = str0(x["description"])
        updated = epoch_ms_to_ts(x["lastModified"])
        date = str0(x["date"])
        published = F.coalesce(F.when(date != "", rfc3339(date)), updated)
        tags = F.transform(
            F.coalesce(x["tags"], F.array().cast(S.TAGS)),
            lambda t: F.struct(F.coalesce(t["id"], F.lit(0).cast("long")).alias("id"),
                               str0(t["label"]).alias("label")))
        return F.struct(
            F.concat(F.lit(PULSELIVE + "_"), ext).alias("id"),
            F.lit(PULSELIVE).alias("source"),
            ext.alias("external_id"),
            str0(x["type"]).alias("type"),
            str0(x["title"]).alias("title"),
            F.when(desc == "", summary).otherwise(desc).alias("description"),
            summary.alias("summary"),
            str0(x["body"]).alias("body"),
            F.lit("").alias("content"),
            str0(x["canonicalUrl"]).alias("url"),
            str0(x["leadMedia"]["imageUrl"]).alias("image_url"),
            tags.alias("tags"),
            published.alias("published_at"),
            updated.alias("updated_at"),
            F.lit(None).cast("timestamp").alias("fetched_at"),
        )
    return F.transform(F.coalesce(doc["content"], F.array().cast(T.ArrayType(S.PULSELIVE_ITEM))), one)


def _pulselive_page_info(doc: Column) -> Column:
    z = F.lit(0).cast("long")
    pi = doc["pageInfo"]
    return F.struct(F.coalesce(pi["page"], z).alias("page"),
                    F.coalesce(pi["numPages"], z).alias("numPages"),
                    F.coalesce(pi["pageSize"], z).alias("pageSize"),
                    F.coalesce(pi["numEntries"], z).alias("numEntries"))


# --------------------------------------------------------------- second feed
def _items_strict_violation(v: Column) -> Column:
    def bad_item(x: Column) -> Column:
        ok = F.lit(True)
        for f in S.ITEMS_STRING_FIELDS:
            ok = ok & _ok_text(x[f])
        return ~ok
    return F.coalesce(F.exists(v["items"], bad_item), F.lit(False))


def _items_articles(doc: Column) -> Column:
    def one(x: Column) -> Column:
        ext = str0(x["id"])
        content = str0(x["content"])
        ts = rfc3339(str0(x["timestamp"]))
        return F.struct(
            F.concat(F.lit(ITEMS + "_"), ext).alias("id"),
            F.lit(ITEMS).alias("source"),
            ext.alias("external_id"),
            F.lit("").alias("type"),
            str0(x["headline"]).alias("title"),
            F.lit("").alias("description"),
            truncate_ellipsis(content, 10).alias("summary"),
            content.alias("body"),
            F.lit("").alias("content"),
            F.concat(F.lit(ITEMS_URL_PREFIX), ext).alias("url"),
            F.lit("").alias("image_url"),
            F.lit(None).cast(S.TAGS).alias("tags"),
            ts.alias("published_at"),
            ts.alias("updated_at"),
            F.lit(None).cast("timestamp").alias("fetched_at"),
        )
    return F.transform(F.coalesce(doc["items"], F.array().cast(T.ArrayType(S.ITEMS_ITEM))), one)


def _items_page_info(doc: Column) -> Column:
    # The second feed carries no paging metadata: one page of 20, all entries.
    n = F.coalesce(F.size(doc["items"]), F.lit(0)).cast("long")
    return F.struct(F.lit(0).cast("long").alias("page"), F.lit(1).cast("long").alias("numPages"),
                    F.lit(20).cast("long").alias("pageSize"), n.alias("numEntries"))


PARSERS: dict[str, Parser] = {
    PULSELIVE: Parser(
        PULSELIVE, S.PULSELIVE_PAGE,
        "content array<struct<" + ", ".join(f"{f} variant" for f in S.PULSELIVE_STRING_FIELDS)
        + ", tags array<struct<label variant>>, leadMedia struct<imageUrl variant>>>",
        _pulselive_strict_violation, _pulselive_articles, _pulselive_page_info),
    ITEMS: Parser(
        ITEMS, S.ITEMS_PAGE,
        "items array<struct<" + ", ".join(f"{f} variant" for f in S.ITEMS_STRING_FIELDS) + ">>",
        _items_strict_violation, _items_articles, _items_page_info),
}


def register_parser(parser: Parser) -> None:
    """Extension point: add a page format by name (used by the registry join)."""
    PARSERS[parser.name] = parser


def _case(parser_col: Column, per_parser: Callable[[Parser], Column], names) -> Column:
    expr = None
    for name in names:
        branch = per_parser(PARSERS[name])
        expr = F.when(parser_col == name, branch) if expr is None else expr.when(parser_col == name, branch)
    return expr


def _parser_col(parser: str | Column) -> Column:
    if isinstance(parser, Column):
        return parser
    return F.lit(parser) if parser in PARSERS else F.col(parser)


def decode_pages(raw: DataFrame, parser: str | Column = "parser",
                 names: list[str] | None = None) -> DataFrame:
    """Add ``bad`` (page fails to decode), ``items`` (article array) and
    ``page_info`` to every raw page.  ``parser`` is a parser name or a column
    holding one (after the registry join).  Each page is decoded only by its
    own parser (``CASE`` branches evaluate lazily per row)."""
    names = names or list(PARSERS)
    pcol = _parser_col(parser)
    payload = F.col("payload")
    is_null_doc = F.trim(payload) == "null"  # JSON null decodes to an empty page
    df = raw
    for name in names:
        p = PARSERS[name]
        with_corrupt = T.StructType(list(p.schema.fields) + [T.StructField(CORRUPT, T.StringType())])
        df = df.withColumn(f"_doc_{name}", F.when(pcol == name, F.from_json(
            payload, with_corrupt, {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"})))

    def doc(p: Parser) -> Column:
        return F.col(f"_doc_{p.name}")

    undecodable = _case(pcol, lambda p: ~is_null_doc & (doc(p).isNull() | doc(p)[CORRUPT].isNotNull()), names)
    violation = _case(pcol, lambda p: p.strict(F.from_json(payload, p.variant_ddl)), names)
    bad = (~pcol.isin(*names) | payload.isNull()
           | F.coalesce(undecodable, F.lit(False)) | F.coalesce(violation, F.lit(False)))
    return (df.withColumn("bad", bad)
              .withColumn("items", F.when(~F.col("bad"), _case(pcol, lambda p: p.articles(doc(p)), names)))
              .withColumn("page_info", F.when(~F.col("bad"), _case(pcol, lambda p: p.page_info(doc(p)), names)))
              .drop(*[f"_doc_{n}" for n in names]))


def explode_articles(decoded: DataFrame, keep: list[str] | None = None,
                     dedup: bool = False) -> DataFrame:
    """Good pages -> one row per payload item with its position ``pos``.

    ``items`` is NULL on bad pages and exploding NULL yields no row, so no
    filter is needed -- a filter on ``bad`` would be pushed below the
    projection and decode every payload twice.  ``dedup=True`` applies E1
    inside each page's array before exploding (the first item of each id
    survives, with its original position): no shuffle.
    """
    keep = keep if keep is not None else [c for c in S.PAGE_KEY if c in decoded.columns]
    # The *_outer generators plus a filter on the generated column: a plain
    # explode makes the optimizer infer a size(items) > 0 filter below the
    # generator, which would inline (re-run) the whole decode.
    if dedup:
        from articleflow.operators.changes import dedup_items
        rows = (decoded.select(*keep, F.explode_outer(dedup_items(F.col("items"))).alias("e"))
                       .filter(F.col("e").isNotNull()))
        return rows.select(*keep, F.col("e.pos").alias("pos"), "e.a.*")
    return (decoded.select(*keep, F.posexplode_outer("items").alias("pos", "a"))
                   .filter(F.col("a").isNotNull())
                   .select(*keep, F.col("pos").cast("long").alias("pos"), "a.*"))


def parse_pulselive(raw: DataFrame, dedup: bool = False) -> DataFrame:
    """B1: first-feed pages -> articles (bad pages yield nothing)."""
    return explode_articles(decode_pages(raw, PULSELIVE, [PULSELIVE]), dedup=dedup)


def parse_items(raw: DataFrame, dedup: bool = False) -> DataFrame:
    """B2: second-feed pages -> articles."""
    return explode_articles(decode_pages(raw, ITEMS, [ITEMS]), dedup=dedup)


def page_info(raw: DataFrame, parser: str | Column = "parser", names=None) -> DataFrame:
    """Paging metadata per page plus the number of articles in it."""
    d = decode_pages(raw, parser, names)
    keep = [c for c in S.PAGE_KEY if c in d.columns]
    return d.select(*keep, "bad",
                    F.col("page_info.page").alias("page"),
                    F.col("page_info.numPages").alias("num_pages"),
                    F.col("page_info.pageSize").alias("page_size"),
                    F.col("page_info.numEntries").alias("num_entries"),
                    F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_articles"))


def split_bad_pages(raw: DataFrame, parser: str | Column = "parser", names=None):
    """(good, bad) raw pages.  A page is bad if it does not decode, has a
    wrong-typed field anywhere, or names no known parser."""
    from articleflow.operators.joins import fence
    d = fence(decode_pages(raw, parser, names).drop("items", "page_info"), "bad")
    return d.filter(~F.col("bad")).drop("bad"), d.filter(F.col("bad")).drop("bad")


def with_parser(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """``raw`` with the ``parser`` its feed names in the registry; '' for a
    feed that the registry lacks and for a page without a feed."""
    reg = sources.select(F.col("name").alias("feed"), F.col("transformer").alias("parser"))
    return raw.join(reg, "feed", "left").fillna("", ["parser"])


def parse_pages(raw: DataFrame, sources: DataFrame, dedup: bool = False) -> DataFrame:
    """Dispatch each page to the parser its feed names in the registry.

    ``sources`` is the validated registry (A1); AQE broadcasts it by its
    measured size.  Pages that yield no article because nothing can parse
    them are :func:`rejected_pages`.
    """
    return explode_articles(decode_pages(with_parser(raw, sources), "parser"), dedup=dedup)


def rejected_pages(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """The other side of B4: pages of unknown feeds, without a feed, or that
    do not decode, with the ``reason``."""
    from articleflow.operators.joins import fence
    known = F.col("parser").isin(*PARSERS)
    bad = fence(decode_pages(with_parser(raw, sources), "parser").drop("items", "page_info"), "bad").filter("bad")
    return (bad.withColumn("reason", F.when(known, F.lit("undecodable")).when(F.col("feed").isNull(), F.lit("no feed"))
                           .otherwise(F.lit("unknown feed"))).drop("bad", "parser"))


def conform(df: DataFrame) -> DataFrame:
    """Exactly the 16 article fields, typed, zero-valued where absent."""
    cols = []
    for f in S.ARTICLE.fields:
        c = F.col(f.name) if f.name in df.columns else F.lit(None)
        if isinstance(f.dataType, T.StringType):
            c = str0(c.cast("string"))
        else:
            c = c.cast(f.dataType)
        cols.append(c.alias(f.name))
    return df.select(*cols)
