"""Fixed schemas: the article record, page payloads, the source registry.

The schema is declared in code, never inferred; JSON decoding ignores unknown
fields and zero-fills missing ones (strings '' and numbers 0), only "zero time"
is NULL.
"""

from __future__ import annotations

from pyspark.sql import types as T

TAG = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("label", T.StringType()),
])
TAGS = T.ArrayType(TAG)

# Article record, fields in their fixed order.
ARTICLE = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("source", T.StringType()),
    T.StructField("external_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("image_url", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("published_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("content_hash", T.StringType()),
])
ARTICLE_COLS = [f.name for f in ARTICLE.fields]
ARTICLE_STRING_COLS = [f.name for f in ARTICLE.fields if isinstance(f.dataType, T.StringType)]
# Fields fed to the content hash, in hash order, no separator.
HASH_COLS = ["source", "url", "title", "summary", "body"]

# Coordinates of a page inside a crawl; ``pos`` is the item's index in the page.
PAGE_KEY = ["feed", "run_id", "page_no"]
RAW_PAGES = T.StructType([
    T.StructField("feed", T.StringType(), False),
    T.StructField("run_id", T.LongType(), False),
    T.StructField("page_no", T.LongType(), False),
    T.StructField("fetched_at", T.TimestampType()),
    T.StructField("payload", T.StringType()),
])

PAGE_INFO = T.StructType([
    T.StructField("page", T.LongType()),
    T.StructField("numPages", T.LongType()),
    T.StructField("pageSize", T.LongType()),
    T.StructField("numEntries", T.LongType()),
])

# First feed format: page info plus a content array.
PULSELIVE_ITEM = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("date", T.StringType()),
    T.StructField("lastModified", T.LongType()),
    T.StructField("canonicalUrl", T.StringType()),
    T.StructField("tags", TAGS),
    T.StructField("leadMedia", T.StructType([T.StructField("imageUrl", T.StringType())])),
])
PULSELIVE_PAGE = T.StructType([
    T.StructField("pageInfo", PAGE_INFO),
    T.StructField("content", T.ArrayType(PULSELIVE_ITEM)),
])
PULSELIVE_STRING_FIELDS = ["type", "title", "description", "summary", "body", "date", "canonicalUrl"]

# Second feed format: a bare item list.
ITEMS_ITEM = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("headline", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("timestamp", T.StringType()),
])
ITEMS_PAGE = T.StructType([T.StructField("items", T.ArrayType(ITEMS_ITEM))])
ITEMS_STRING_FIELDS = ["id", "headline", "content", "timestamp"]

PAGINATION = T.StructType([
    T.StructField("type", T.StringType()),
    T.StructField("page_param", T.StringType()),
    T.StructField("limit_param", T.StringType()),
    T.StructField("default_limit", T.LongType()),
])
SOURCE = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("transformer", T.StringType()),
    T.StructField("pagination", PAGINATION),
])

# Metric sample: one counter/gauge observation of one labelled series.
SAMPLE = T.StructType([
    T.StructField("metric", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
])
