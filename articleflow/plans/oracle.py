"""Reference SQL (DuckDB dialect) for the registered queries.

Each statement derives its expected rows from the driver tables directly --
written independently of the Spark operators (e.g. publication times are
computed arithmetically, not by parsing the date text).
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# ------------------------------------------------------------ shared CTEs
_UPD = ("CASE WHEN doc_id % 13 = 0 THEN CAST(0 AS BIGINT) "
        "ELSE CAST(((1704067200000 + doc_id * 61003) // 1000) * 1000000 AS BIGINT) END")
_BASE = ("(epoch_us(TIMESTAMP '2024-01-01 00:00:00') + ((doc_id % 28) * 86400 + (doc_id % 24) * 3600 "
         "+ (doc_id % 60) * 60 + (doc_id * 7) % 60) * 1000000)")
_PUB = (f"CASE WHEN doc_id % 8 IN (3, 5, 6) THEN {_UPD} WHEN doc_id % 8 = 7 THEN {_BASE} - 7200000000 "
        f"WHEN doc_id % 8 = 4 THEN {_BASE} + 250000 ELSE {_BASE} END")


def _items(run: int) -> str:
    text = "text" if run == 0 else "CASE WHEN doc_id % 5 = 0 THEN text || ' [updated]' ELSE text END"
    rows = f"""
  SELECT source AS feed, CAST({run} AS BIGINT) AS run_id, CAST(doc_id // 50 + {1000 * run} AS BIGINT) AS page_no,
         doc_id AS ord, doc_id, lang, source AS doc_source, n_chars,
         substring({text}, 1, 40) AS title, substring({text}, 1, 60) AS summary, {text} AS body
  FROM documents"""
    if run == 0:
        rows += """
  UNION ALL
  SELECT source, 0, doc_id // 50, doc_id + 1000000000000, doc_id, lang, source, n_chars,
         '(copy)', substring(text, 1, 60), text
  FROM documents WHERE doc_id % 10 = 7"""
    return rows


def _articles(run: int) -> str:
    return f"""
  SELECT feed, run_id, page_no, ord,
         row_number() OVER (PARTITION BY feed, run_id, page_no ORDER BY ord) - 1 AS pos,
         'pulselive_' || CAST(doc_id AS VARCHAR) AS id, 'pulselive' AS source,
         CAST(doc_id AS VARCHAR) AS external_id, lang AS type, title,
         CASE WHEN doc_id % 4 = 0 THEN summary ELSE lang || '/' || doc_source END AS description,
         summary, body, '' AS content,
         'https://news.example/' || doc_source || '/' || CAST(doc_id AS VARCHAR) AS url,
         'https://img.example/' || CAST(doc_id AS VARCHAR) || '.jpg' AS image_url,
         concat(n_chars % 7, ':', lang, ',', 100 + doc_id % 3 + {run} * (doc_id % 2), ':', doc_source) AS tags_text,
         {_PUB} AS published_us, {_UPD} AS updated_us, CAST(NULL AS BIGINT) AS fetched_us
  FROM ({_items(run)})"""


def _uniq(run: int) -> str:
    return f"""
  SELECT *, sha256('pulselive' || url || title || summary || body) AS content_hash
  FROM ({_articles(run)}) a
  QUALIFY row_number() OVER (PARTITION BY feed, run_id, page_no, id ORDER BY ord) = 1"""


COMMON = f"""
arts0 AS ({_articles(0)}),
arts1 AS ({_articles(1)}),
uniq0 AS ({_uniq(0)}),
uniq1 AS ({_uniq(1)}),
stored AS (
  SELECT id, source, external_id, type, title, description, summary, body, content, url, image_url, tags_text,
         published_us, updated_us, fetched_us,
         CASE WHEN CAST(external_id AS BIGINT) % 3 = 1 THEN 'old'
              ELSE sha256('pulselive' || url || title || summary || body) END AS content_hash
  FROM arts0 WHERE ord < 1000000000000 AND CAST(external_id AS BIGINT) % 3 <> 0
  UNION ALL
  SELECT id || '_gone', source, external_id, type, title, description, summary, body, content, url, image_url, tags_text,
         published_us, updated_us, fetched_us, sha256('pulselive' || url || title || summary || body)
  FROM arts0 WHERE ord < 1000000000000 AND CAST(external_id AS BIGINT) % 9 = 0),
classified AS (
  SELECT u.*, CASE WHEN s.content_hash IS NULL THEN 'new'
                   WHEN s.content_hash <> u.content_hash THEN 'changed' ELSE 'unchanged' END AS change
  FROM uniq0 u LEFT JOIN stored s USING (id)),
chat AS (
  SELECT 'chat' AS feed, CAST(0 AS BIGINT) AS run_id, conv_id * 1000 + turn // 20 AS page_no,
         row_number() OVER (PARTITION BY conv_id, turn // 20 ORDER BY turn) - 1 AS pos,
         'dummy_' || conv_id || '-' || turn AS id, 'dummy' AS source, conv_id || '-' || turn AS external_id,
         '' AS type, role AS title, '' AS description, substring(text, 1, 10) || '...' AS summary,
         text AS body, '' AS content, 'http://dummy/' || conv_id || '-' || turn AS url, '' AS image_url,
         CASE WHEN turn % 5 = 4 THEN NULL ELSE epoch_us(TIMESTAMP '2024-02-01 00:00:00'
              + to_days(CAST(conv_id % 28 AS INTEGER)) + to_hours(CAST(turn % 24 AS INTEGER))) END AS published_us
  FROM conversations)"""


def with_common(body: str) -> str:
    return f"WITH {COMMON}\n{body}"


def rfc3339_sql(us: str) -> str:
    """Epoch micros -> RFC 3339 UTC text, fraction trimmed (NULL stays NULL)."""
    return (f"CASE WHEN {us} IS NULL THEN NULL ELSE strftime(make_timestamp({us}), '%Y-%m-%dT%H:%M:%S') || "
            f"CASE WHEN {us} % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST({us} % 1000000 AS VARCHAR), 6, '0'), '0') END"
            f" || 'Z' END")


_ART_OUT = ("id, source, external_id, type, title, description, summary, body, content, url, image_url, "
            "tags_text, published_us, updated_us, fetched_us")

ORACLE["b1_parse_pulselive"] = with_common(f"SELECT feed, run_id, page_no, pos, {_ART_OUT} FROM arts0")

ORACLE["b2_parse_items"] = with_common("""
SELECT feed, run_id, page_no, pos, id, source, external_id, type, title, description, summary, body, content,
       url, image_url, published_us, published_us AS updated_us, CAST(NULL AS BIGINT) AS fetched_us,
       true AS tags_is_null
FROM chat""")

ORACLE["b3_page_info"] = with_common("""
SELECT feed, run_id, page_no, page_no AS page, max(page_no) OVER (PARTITION BY run_id) + 1 AS num_pages,
       CAST(50 AS BIGINT) AS page_size, n AS num_entries, n AS n_articles
FROM (SELECT feed, run_id, page_no, count(*) AS n FROM arts0 GROUP BY ALL
      UNION ALL SELECT feed, run_id, page_no, count(*) FROM arts1 GROUP BY ALL)""")

ORACLE["b4_parse_pages"] = with_common("""
SELECT feed, run_id, page_no, pos, id, source, title, published_us, '' AS rejected FROM arts0
WHERE page_no % 7 <> 5 AND feed NOT IN ('src3', 'src11')
UNION ALL
SELECT feed, run_id, page_no, pos, id, source, title, published_us, '' FROM chat
UNION ALL
SELECT CASE WHEN page_no % 7 <> 5 THEN feed END, run_id, page_no, NULL, NULL, NULL, NULL, NULL,
       CASE WHEN page_no % 7 = 5 OR feed IS NULL THEN 'no feed' ELSE 'unknown feed' END
FROM (SELECT DISTINCT feed, run_id, page_no FROM arts0) p
WHERE page_no % 7 = 5 OR feed IS NULL OR feed IN ('src3', 'src11')""")

ORACLE["b5_split_bad_pages"] = with_common("""
SELECT DISTINCT feed, run_id, page_no,
       NOT (page_no % 19 = 2) AND (page_no % 9 = 4 OR page_no % 13 = 6) AS bad
FROM arts0""")

ORACLE["b6_conform"] = """
SELECT 'doc_' || doc_id AS id, source, CAST(n_chars AS VARCHAR) AS external_id, '' AS type,
       CASE WHEN doc_id % 2 = 0 THEN lang ELSE '' END AS title, '' AS description, '' AS summary,
       text AS body, '' AS content, '' AS url, '' AS image_url,
       CAST(NULL AS BIGINT) AS published_us, CAST(NULL AS BIGINT) AS updated_us, CAST(NULL AS BIGINT) AS fetched_us,
       '' AS content_hash, true AS tags_is_null
FROM documents"""

ORACLE["b7_content_hash"] = with_common("SELECT feed, page_no, id, content_hash FROM uniq0")

ORACLE["e1_dedup_batch"] = with_common("SELECT feed, run_id, page_no, pos, id, title FROM uniq0")

ORACLE["c1_lookup_hashes"] = with_common("SELECT id, content_hash FROM stored WHERE id IN (SELECT id FROM uniq0)")

ORACLE["c2_classify_changes"] = with_common("SELECT feed, page_no, id, content_hash, change FROM classified")

ORACLE["c2_change_counts"] = with_common(
    "SELECT feed, change, count(*) AS n FROM classified GROUP BY feed, change")

_PAGES01 = """
pages AS (SELECT feed, run_id, page_no, id, content_hash, title, tags_text FROM uniq0
          UNION ALL SELECT feed, run_id, page_no, id, content_hash, title, tags_text FROM uniq1),
seq AS (SELECT feed, run_id, page_no, id, content_hash, title, tags_text, false AS is_stored FROM pages
        UNION ALL SELECT NULL, -1, NULL, id, content_hash, title, tags_text, true FROM stored)"""

ORACLE["c3_change_feed"] = with_common(f""", {_PAGES01.strip()}
SELECT feed, run_id, page_no, id, content_hash,
       CASE WHEN prev IS NULL THEN 'new' WHEN prev <> content_hash THEN 'changed' ELSE 'unchanged' END AS change
FROM (SELECT *, lag(content_hash) OVER (PARTITION BY id ORDER BY run_id, feed NULLS FIRST, page_no NULLS FIRST) AS prev
      FROM seq)
WHERE NOT is_stored""")

ORACLE["c3_state_after"] = with_common(f""", {_PAGES01.strip()}
SELECT id, title, content_hash, tags_text FROM seq
QUALIFY row_number() OVER (PARTITION BY id ORDER BY run_id DESC, feed DESC NULLS LAST, page_no DESC NULLS LAST) = 1""")

ORACLE["a9_upsert_articles"] = with_common("""
SELECT id, title, content_hash, tags_text, published_us FROM uniq1
UNION ALL
SELECT id, title, content_hash, tags_text, published_us FROM stored WHERE id NOT IN (SELECT id FROM uniq1)""")

ORACLE["f1_last_published"] = with_common("""
SELECT source, id, published_us FROM (
  SELECT source, id, published_us FROM stored
  UNION ALL SELECT source, id, published_us FROM chat)
QUALIFY row_number() OVER (PARTITION BY source ORDER BY published_us DESC NULLS LAST, id DESC) = 1""")

ORACLE["f1_last_published_source"] = with_common("""
SELECT source, id, published_us FROM (
  SELECT source, id, published_us FROM stored
  UNION ALL SELECT source, id, published_us FROM chat) WHERE source = 'dummy'
ORDER BY published_us DESC NULLS LAST, id DESC LIMIT 1""")

ORACLE["f1_last_published_by_type"] = with_common("""
SELECT type, id, published_us FROM stored
QUALIFY row_number() OVER (PARTITION BY type ORDER BY published_us DESC NULLS LAST, id DESC) = 1""")

_EMITTED = "emitted AS (SELECT * FROM classified WHERE change <> 'unchanged')"


def _tags_json() -> str:
    return ("'[' || array_to_string(list_transform(string_split(tags_text, ','), "
            "lambda t: '{\"id\":' || split_part(t, ':', 1) || ',\"label\":' || to_json(split_part(t, ':', 2)) || '}'), ',') || ']'")


_VALUE = ("'{' || "
          "'\"id\":' || to_json(id) || ',\"source\":' || to_json(source) || ',\"external_id\":' || to_json(external_id)"
          " || ',\"type\":' || to_json(type) || ',\"title\":' || to_json(title) || ',\"description\":' || to_json(description)"
          " || ',\"summary\":' || to_json(summary) || ',\"body\":' || to_json(body) || ',\"content\":' || to_json(content)"
          " || ',\"url\":' || to_json(url) || ',\"image_url\":' || to_json(image_url)"
          f" || ',\"tags\":' || {_tags_json()}"
          f" || ',\"published_at\":' || to_json({rfc3339_sql('published_us')})"
          f" || ',\"updated_at\":' || to_json({rfc3339_sql('updated_us')})"
          " || ',\"fetched_at\":null'"
          " || ',\"content_hash\":' || to_json(content_hash) || '}'")

ORACLE["a6_change_events"] = with_common(f", {_EMITTED}\nSELECT id AS key, {_VALUE} AS value FROM emitted")

ORACLE["a7_read_changes"] = with_common(f""", {_EMITTED}
SELECT id AS key, id, title, content_hash, tags_text, published_us, updated_us, fetched_us FROM emitted""")

ORACLE["a8_sync_and_route"] = with_common(f""", {_EMITTED}
SELECT id AS key, CASE WHEN length(body) % 7 <> 0 THEN 'synced' ELSE 'dead_letter' END AS route FROM emitted""")

# ---------------------------------------------------------------- sources
_ENTRIES = """
entries AS (
  SELECT page_id // 50 AS file_no, page_id,
         CASE WHEN page_id % 11 = 0 THEN '' ELSE regexp_extract(url, '^[a-z]+://([^/#?]+)', 1) || '-' || page_id END AS name,
         CASE WHEN page_id % 13 = 0 THEN '' WHEN page_id % 7 = 0 THEN replace(url, 'http', 'ftp') ELSE url END AS url,
         CASE page_id % 5 WHEN 0 THEN 'pulselive' WHEN 1 THEN 'dummy' WHEN 2 THEN 'rss' WHEN 3 THEN '' ELSE 'pulselive' END AS transformer,
         CASE WHEN page_id % 2 = 0 THEN 'offset' ELSE 'page' END AS ptype,
         CASE WHEN page_id % 4 = 1 THEN '' ELSE 'p' END AS page_param,
         CASE WHEN page_id % 4 = 2 THEN '' ELSE 'limit' END AS limit_param,
         CASE WHEN page_id % 3 = 0 THEN 0 ELSE 10 + page_id % 50 END AS default_limit
  FROM pages)"""

ORACLE["a1_load_sources"] = f"""WITH {_ENTRIES.strip()}
SELECT file_no, row_number() OVER (PARTITION BY file_no ORDER BY page_id) - 1 AS pos, name, url, transformer,
       reason IS NULL AS valid, reason AS reject_reason
FROM (SELECT *, CASE WHEN name = '' THEN 'name is required' WHEN url = '' THEN 'url is required'
                     WHEN NOT starts_with(url, 'http') THEN 'url must start with http'
                     WHEN transformer = '' THEN 'transformer is required'
                     WHEN transformer NOT IN ('pulselive', 'dummy') THEN 'unknown transformer' END AS reason
      FROM entries)
WHERE file_no % 4 <> 3 AND file_no % 5 <> 1"""

ORACLE["a2_plan_pages"] = f"""WITH {_ENTRIES.strip()}
SELECT 'p' || page_id AS name, g.page_no,
       url || CASE WHEN contains(url, '?') THEN '&' ELSE '?' END
           || CASE WHEN page_param = '' THEN 'page' ELSE page_param END || '='
           || CASE WHEN ptype = 'offset' THEN g.page_no * (CASE WHEN default_limit > 0 THEN default_limit ELSE 20 END)
                   ELSE g.page_no END
           || '&' || CASE WHEN limit_param = '' THEN 'pageSize' ELSE limit_param END || '='
           || CASE WHEN default_limit > 0 THEN default_limit ELSE 20 END AS request_url
FROM entries, (SELECT unnest(range(page_id % 7)) AS page_no) g"""

ORACLE["a3_scan_raw_pages"] = with_common("SELECT feed, run_id, page_no, pos, id FROM arts0")

_FETCH_LOG = """
log AS (
  SELECT 'u' || user_id AS feed, CAST((day(ts) - 1) // 7 AS BIGINT) AS run_id,
         row_number() OVER (PARTITION BY user_id, (day(ts) - 1) // 7 ORDER BY ts, event_id) - 1 AS page_no,
         event_type = 'purchase' AND value > 300 AS fetch_error,
         CASE WHEN event_type = 'click' AND value < 5 THEN NULL ELSE 10 + user_id % 60 END AS num_pages,
         CASE WHEN event_type = 'signup' AND value < 1 THEN 0 ELSE 1 + CAST(floor(value) AS BIGINT) % 20 END AS n_articles,
         event_type IN ('error', 'click') AS batch_failed
  FROM events)"""

ORACLE["a5_walk_pages"] = f"""WITH {_FETCH_LOG.strip()},
w1 AS (SELECT *, coalesce(last_value(num_pages IGNORE NULLS) OVER (PARTITION BY feed, run_id ORDER BY page_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS known_pages,
              sum(CASE WHEN batch_failed THEN 1 ELSE 0 END) OVER (PARTITION BY feed, run_id ORDER BY page_no
                      ROWS UNBOUNDED PRECEDING) AS cum_fail,
              row_number() OVER (PARTITION BY feed, run_id ORDER BY page_no) AS rn
       FROM log),
w2 AS (SELECT *, CAST(cum_fail - coalesce(max(CASE WHEN NOT batch_failed THEN cum_fail END) OVER (
                      PARTITION BY feed, run_id ORDER BY page_no ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS streak FROM w1),
w3 AS (SELECT *, (page_no <> rn - 1) OR (known_pages <> -1 AND page_no >= known_pages) AS pre,
              fetch_error OR n_articles = 0 OR (batch_failed AND streak >= 5) AS post FROM w2),
w4 AS (SELECT *, NOT bool_or(pre) OVER (PARTITION BY feed, run_id ORDER BY page_no ROWS UNBOUNDED PRECEDING)
                 AND NOT coalesce(bool_or(post) OVER (PARTITION BY feed, run_id ORDER BY page_no
                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS reached FROM w3)
SELECT feed, run_id, page_no, known_pages, streak, reached,
       CASE WHEN NOT reached THEN 'not_reached' WHEN fetch_error THEN 'fetch_error' WHEN n_articles = 0 THEN 'empty'
            WHEN batch_failed AND streak >= 5 THEN 'aborted' WHEN batch_failed THEN 'batch_failed'
            ELSE 'processed' END AS outcome
FROM w4"""

ORACLE["a10_ingest_logs"] = """
SELECT event_id,
       CASE WHEN event_id % 17 = 0 THEN user_id ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k,
       CASE WHEN event_id % 17 = 0 THEN 'failed to decode message as JSON' END AS error,
       'local' AS environment, 'articleflow' AS application
FROM events"""

ORACLE["a10_ingest_objects"] = """
WITH e AS (SELECT *, event_id % 17 <> 0 AS ok,
                  '2024-03-' || lpad(CAST(1 + event_id % 28 AS VARCHAR), 2, '0') || 'T' || lpad(CAST(event_id % 24 AS VARCHAR), 2, '0')
                    || ':00:00Z' AS stamp FROM events),
r AS (SELECT event_id, 'event_id' AS key, CAST(event_id AS VARCHAR) AS value FROM e
      UNION ALL SELECT event_id, 'k', CASE WHEN ok AND event_id % 5 = 0 THEN 'null'
                WHEN ok AND event_id % 5 <> 1 THEN '"' || event_type || '"' ELSE CAST(user_id AS VARCHAR) END FROM e
      UNION ALL SELECT event_id, 'environment', '"local"' FROM e
      UNION ALL SELECT event_id, 'error', '"failed to decode message as JSON"' FROM e WHERE NOT ok
      UNION ALL SELECT event_id, 'seen_' || event_type, CAST(user_id AS VARCHAR) FROM e WHERE ok
      UNION ALL SELECT event_id, 'o', '{"a":[' || event_id || ',true]}' FROM e WHERE ok
      UNION ALL SELECT event_id, '@timestamp', '"' || stamp || '"' FROM e WHERE ok AND event_id % 3 <> 0)
SELECT event_id, CASE WHEN ok AND event_id % 3 <> 0 THEN epoch_us(CAST(replace(replace(stamp, 'T', ' '), 'Z', '') AS TIMESTAMP)) END AS ts_us,
       r.key, r.value FROM r JOIN e USING (event_id)"""

ORACLE["e2_sample_nth"] = """
WITH r AS (SELECT event_id, event_type, ts, value < 0.5 AS is_reset,
                  CAST(sum(CASE WHEN value < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id
                      ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch
           FROM events),
o AS (SELECT *, CASE WHEN NOT is_reset THEN CAST(sum(CASE WHEN is_reset THEN 0 ELSE 1 END) OVER (
                      PARTITION BY event_type, epoch ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS occurrence
      FROM r)
SELECT event_id, event_type, epoch, occurrence,
       coalesce(occurrence = 1 OR occurrence % 10 = 0, false) AS emit
FROM o"""

ORACLE["e2_sample_counts"] = """
WITH r AS (SELECT event_type, value < 0.5 AS is_reset,
                  sum(CASE WHEN value < 0.5 THEN 1 ELSE 0 END) OVER (PARTITION BY event_type ORDER BY ts, event_id
                      ROWS UNBOUNDED PRECEDING) AS epoch
           FROM events)
SELECT event_type, CAST(count(*) FILTER (WHERE NOT is_reset) AS BIGINT) AS count
FROM r WHERE epoch = (SELECT max(epoch) FROM r r2 WHERE r2.event_type = r.event_type)
GROUP BY event_type"""

ORACLE["e3_failure_streaks"] = """
WITH c AS (SELECT event_id, user_id, ts, event_type = 'error' AS failed,
                  sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id
                      ROWS UNBOUNDED PRECEDING) AS cum_fail
           FROM events)
SELECT event_id, user_id, streak, streak >= 3 AS tripped
FROM (SELECT *, CAST(cum_fail - coalesce(max(CASE WHEN NOT failed THEN cum_fail END) OVER (PARTITION BY user_id
                 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS BIGINT) AS streak FROM c)"""

# ---------------------------------------------------------------- counters
_WALK = ORACLE["a5_walk_pages"].replace("SELECT feed, run_id, page_no, known_pages, streak, reached,",
                                        "SELECT feed, run_id, page_no, known_pages, streak, reached, 0 AS _z,", 1)

ORACLE["d1_ingest_counters"] = with_common(f"""
SELECT feed, 'success' AS status, count(*) AS n FROM classified GROUP BY feed
UNION ALL
SELECT feed, 'error_crawl', count(*) FROM (
  SELECT feed, run_id FROM ({_WALK}) w GROUP BY feed, run_id
  HAVING bool_or(outcome IN ('fetch_error', 'aborted'))) GROUP BY feed""")

ORACLE["d2_duplicate_counters"] = with_common("""
SELECT feed, count(*) AS skipped FROM classified WHERE change = 'unchanged' GROUP BY feed""")

ORACLE["d3_publish_counters"] = with_common("""
SELECT feed, CAST(sum(CASE WHEN page_no % 7 <> 3 THEN n_changed ELSE 0 END) AS BIGINT) AS published,
       count(*) FILTER (WHERE page_no % 7 = 3 AND n_changed > 0) AS publish_errors
FROM (SELECT feed, run_id, page_no, count(*) FILTER (WHERE change <> 'unchanged') AS n_changed
      FROM classified GROUP BY ALL) GROUP BY feed""")

ORACLE["d4_sync_counters"] = with_common(f""", {_EMITTED}
SELECT source, CAST(count(*) FILTER (WHERE length(body) % 7 <> 0) AS BIGINT) AS processed,
       CAST(count(*) FILTER (WHERE length(body) % 7 = 0) AS BIGINT) AS errors,
       CAST(count(*) FILTER (WHERE length(body) % 7 = 0) AS BIGINT) AS dead_lettered
FROM (SELECT source, body FROM emitted UNION ALL SELECT source, body FROM chat) GROUP BY source""")

ORACLE["d5_parse_error_counters"] = with_common("""
SELECT feed, count(*) AS parse_errors FROM (SELECT DISTINCT feed, page_no FROM arts0)
WHERE NOT (page_no % 19 = 2) AND (page_no % 9 = 4 OR page_no % 13 = 6) GROUP BY feed""")


def _hist_sql(value: str, source: str, by: str, bounds) -> str:
    def le(b):
        return format(float(b), "g")
    parts = [f"SELECT {by}, '{le(b)}' AS le, count(*) FILTER (WHERE {value} <= {float(b)!r}) AS cumulative_count, "
             f"round(sum({value}), 6) AS sum, count({value}) AS count FROM {source} GROUP BY {by}" for b in bounds]
    parts.append(f"SELECT {by}, '+Inf', count({value}), round(sum({value}), 6), count({value}) FROM {source} GROUP BY {by}")
    return "\nUNION ALL\n".join(parts)


_HIST_BOUNDS = (1, 2.5, 5, 10, 25, 50, 100, 250)
_FRESH_BOUNDS = (60, 300, 600, 1800, 3600, 7200, 21600, 86400)

ORACLE["d6_histogram"] = _hist_sql("value", "events", "event_type", _HIST_BOUNDS)

ORACLE["d7_freshness"] = "WITH f AS (SELECT o_orderpriority AS feed, CAST(round(o_totalprice * 1e6) AS BIGINT) / 1e6 AS fr FROM orders WHERE o_orderdate IS NOT NULL)\n" \
    + _hist_sql("fr", "f", "feed", _FRESH_BOUNDS)


def _quantile_sql(q: float) -> str:
    bounds = list(_HIST_BOUNDS)
    cum = ", ".join(f"count(*) FILTER (WHERE value <= {float(b)!r}) AS c{i}" for i, b in enumerate(bounds))
    rank = f"{q!r} * total"
    cases = []
    for i, b in enumerate(bounds):
        lo = 0.0 if i == 0 else float(bounds[i - 1])
        prev = "0" if i == 0 else f"c{i - 1}"
        cases.append(f"WHEN c{i} >= {rank} THEN CASE WHEN c{i} - {prev} = 0 THEN {float(b)!r} ELSE "
                     f"{lo!r} + ({float(b)!r} - {lo!r}) * ({rank} - {prev}) / (c{i} - {prev}) END")
    return (f"SELECT event_type, CAST({q!r} AS DOUBLE) AS q, round(CASE WHEN total = 0 THEN 'NaN'::DOUBLE "
            + " ".join(cases) + f" ELSE {float(bounds[-1])!r} END, 6) AS value "
            f"FROM (SELECT event_type, count(*) AS total, {cum} FROM events GROUP BY event_type)")


ORACLE["d8_histogram_quantile"] = _quantile_sql(0.5) + "\nUNION ALL\n" + _quantile_sql(0.95)

_SAMPLES = """
samples AS (
  SELECT 'articles_ingested_total' AS metric, 'u' || user_id AS source,
         CASE WHEN event_type = 'error' THEN 'error_crawl' ELSE 'success' END AS status,
         epoch_us(ts) AS ts_us, event_id,
         CAST(count(*) OVER (PARTITION BY user_id, CASE WHEN event_type = 'error' THEN 'error_crawl' ELSE 'success' END,
                              CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS value
  FROM events),
deltas AS (
  SELECT *, CASE WHEN prev IS NULL THEN 0.0 WHEN value >= prev THEN value - prev ELSE value END AS delta
  FROM (SELECT *, lag(value) OVER (PARTITION BY metric, source, status ORDER BY ts_us, value) AS prev FROM samples))"""

_AT_US = "epoch_us(TIMESTAMP '2024-01-20 00:00:00')"

ORACLE["d9_sum_by_status"] = f"""WITH {_SAMPLES.strip()}
SELECT status, round(sum(value), 6) AS value FROM (
  SELECT status, arg_max(value, ts_us) AS value FROM samples WHERE ts_us <= {_AT_US}
  GROUP BY metric, source, status) GROUP BY status"""

ORACLE["d9_sum_total"] = f"""WITH {_SAMPLES.strip()}
SELECT round(sum(value), 6) AS value FROM (
  SELECT arg_max(value, ts_us) AS value FROM samples WHERE ts_us <= {_AT_US} GROUP BY metric, source, status)"""

ORACLE["e4_counter_rate"] = f"""WITH {_SAMPLES.strip()}
SELECT source, status, ts_us, round(inc, 6) AS increase, round(inc / 3600.0, 6) AS rate
FROM (SELECT *, sum(delta) OVER (PARTITION BY metric, source, status ORDER BY ts_us
                                 RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS inc FROM deltas)"""

ORACLE["e5_latest_value"] = f"""
SELECT source, value, CASE value WHEN 0 THEN 'closed' WHEN 1 THEN 'half-open' WHEN 2 THEN 'open' END AS state, ts_us
FROM (SELECT 'u' || user_id AS source, arg_max(CAST(floor(value) AS BIGINT) % 3, epoch_us(ts))::DOUBLE AS value,
             max(epoch_us(ts)) AS ts_us
      FROM events WHERE epoch_us(ts) <= {_AT_US} AND epoch_us(ts) >= {_AT_US} - 86400000000
      GROUP BY user_id)"""

_GRID = f"""WITH {_SAMPLES.strip()},
b AS (SELECT metric, source, status, CAST(floor(ts_us / 3600000000) AS BIGINT) AS bucket, sum(delta) AS d
      FROM deltas WHERE regexp_full_match(status, 'error.*') GROUP BY ALL),
span AS (SELECT metric, source, status, min(bucket) AS lo, (SELECT max(bucket) FROM b) AS hi FROM b GROUP BY ALL),
grid AS (SELECT metric, source, status, unnest(range(lo, hi + 3)) AS bucket FROM span),
dense AS (SELECT g.*, coalesce(b.d, 0.0) AS d FROM grid g LEFT JOIN b USING (metric, source, status, bucket)),
ev AS (SELECT metric, source, status, (bucket + 1) * 3600000000 AS eval_us,
              sum(d) OVER (PARTITION BY metric, source, status ORDER BY bucket ROWS 2 PRECEDING) AS inc
       FROM dense)"""

ORACLE["e7_evaluation_grid"] = _GRID + """
SELECT source, status, eval_us, round(inc, 6) AS increase, round(inc / 10800.0, 6) AS rate FROM ev"""

ORACLE["e6_alert_intervals"] = _GRID + """,
runs AS (SELECT *, sum(CASE WHEN inc >= 1 THEN 0 ELSE 1 END) OVER (PARTITION BY metric, source, status
                      ORDER BY eval_us ROWS UNBOUNDED PRECEDING) AS run FROM ev),
t AS (SELECT *, min(eval_us) OVER (PARTITION BY metric, source, status, run) AS start_us FROM runs WHERE inc >= 1)
SELECT source, status, start_us, max(eval_us) AS end_us,
       min(eval_us) FILTER (WHERE eval_us - start_us >= 7200000000) AS fire_us
FROM t GROUP BY metric, source, status, run, start_us"""

ORACLE["i1_age_tier"] = """
SELECT l_orderkey, l_linenumber,
       CASE WHEN a >= 90 * 86400000000 THEN 'delete' WHEN a >= 30 * 86400000000 THEN 'cold'
            WHEN a >= 7 * 86400000000 THEN 'warm' ELSE 'hot' END AS tier
FROM (SELECT *, epoch_us(TIMESTAMP '1999-01-01 00:00:00') - epoch_us(l_shipdate) AS a FROM lineitem)"""

ORACLE["i1_expire_samples"] = """
SELECT event_id FROM events
WHERE epoch_us(TIMESTAMP '2024-01-31 00:00:00') - epoch_us(ts) < 15 * 86400000000"""

# a day goes when its last moment is old enough
ORACLE["i1_expire_days"] = """
SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events
WHERE ts IS NULL OR date_diff('day', CAST(ts AS DATE) + 1, DATE '2024-01-24') < 15"""

ORACLE["i1_tier_days"] = """
SELECT event_id, CASE WHEN ts IS NULL THEN 'hot' WHEN a >= 30 THEN 'cold' WHEN a >= 7 THEN 'warm' ELSE 'hot' END AS tier
FROM (SELECT *, date_diff('day', CAST(ts AS DATE) + 1, DATE '2024-02-05') AS a FROM events)"""

# ---------------------------------------------------------------- streaming
ORACLE["a4_stream_raw_pages"] = with_common("""
SELECT DISTINCT feed, run_id, page_no FROM arts0
UNION ALL SELECT DISTINCT feed, run_id, page_no FROM arts1
UNION ALL SELECT DISTINCT feed, run_id, page_no FROM chat""")

_STREAM_PAGES = """
spages AS (SELECT feed, run_id, page_no, id, content_hash, body, source, published_us FROM uniq0
           UNION ALL SELECT feed, run_id, page_no, id, content_hash, body, source, published_us FROM uniq1
           UNION ALL SELECT feed, run_id, page_no, id, sha256('dummy' || url || title || summary || body), body,
                  source, published_us FROM chat),
sfeed AS (SELECT *, lag(content_hash) OVER (PARTITION BY id ORDER BY run_id, feed, page_no) AS prev FROM spages),
semitted AS (SELECT * FROM sfeed WHERE prev IS NULL OR prev <> content_hash)"""

ORACLE["h1_run_ingest"] = with_common(f""", {_STREAM_PAGES.strip()}
SELECT id AS key, feed, run_id, page_no, content_hash FROM semitted""")

ORACLE["h3_run_sync"] = with_common(f""", {_STREAM_PAGES.strip()}
SELECT id AS key, CASE WHEN length(body) % 7 <> 0 THEN 'synced' ELSE 'dead_letter' END AS route FROM semitted""")

ORACLE["h4_sample_nth_stream"] = ORACLE["e2_sample_nth"].replace(
    "SELECT event_id, event_type, epoch, occurrence,", "SELECT event_id, event_type, occurrence,")

ORACLE["e6_alert_intervals_sparse"] = ORACLE["e6_alert_intervals"]

def _fresh_rows() -> str:
    rows = [(f"'article_freshness_seconds_bucket', feed, '', '{format(float(b), 'g')}'",
             f"count(*) FILTER (WHERE age <= {float(b)!r})") for b in _FRESH_BOUNDS]
    rows += [("'article_freshness_seconds_bucket', feed, '', '+Inf'", "count(age)"),
             ("'article_freshness_seconds_sum', feed, '', ''", "round(sum(age), 3)"),
             ("'article_freshness_seconds_count', feed, '', ''", "count(age)")]
    return "".join(f"\nUNION ALL\nSELECT {key}, CAST({v} AS DOUBLE) FROM aged GROUP BY feed" for key, v in rows)


ORACLE["h1_ingest_counters"] = with_common(f""", {_STREAM_PAGES.strip()},
aged AS (SELECT feed, (epoch_us(TIMESTAMP '2024-01-15 12:00:00') - published_us) / 1e6 AS age FROM spages WHERE published_us IS NOT NULL)
SELECT 'articles_ingested_total' AS metric, feed AS source, 'success' AS status, '' AS le, CAST(count(*) AS DOUBLE) AS value
FROM sfeed GROUP BY feed
UNION ALL
SELECT 'articles_duplicates_skipped_total', feed, '', '', CAST(count(*) AS DOUBLE)
FROM sfeed WHERE prev = content_hash GROUP BY feed
UNION ALL
SELECT 'articles_published_total', feed, '', '',
       CAST(count(*) FILTER (WHERE prev IS NULL OR prev <> content_hash) AS DOUBLE)
FROM sfeed GROUP BY feed
UNION ALL
SELECT 'publish_errors_total', feed, '', '', 0.0::DOUBLE FROM sfeed GROUP BY feed{_fresh_rows()}""")

# the whole run's walk at once, however its pages were cut into micro-batches
ORACLE["h1_walk_counters"] = with_common("""
, pg AS (SELECT feed, page_no, count(*) AS n, TRY_CAST(regexp_extract(feed, '([0-9]+)$', 1) AS BIGINT) AS f
         FROM uniq0 GROUP BY feed, page_no),
marked AS (SELECT *, feed IS NULL OR coalesce(f % 5 = 4 AND page_no = 9, false) AS bad,
                  coalesce(f % 5 = 3 AND page_no = 11, false) AS empty,
                  row_number() OVER w - 1 AS nth FROM pg WINDOW w AS (PARTITION BY feed ORDER BY page_no)),
failing AS (SELECT *, NOT bad AND NOT empty AND coalesce((page_no + f) % 13 < f % 7, false) AS failed FROM marked),
counted AS (SELECT *, sum(failed::INT) OVER (PARTITION BY feed ORDER BY page_no ROWS 4 PRECEDING) = 5 AS fifth FROM failing),
walk AS (SELECT *, max((page_no <> nth)::INT) OVER (PARTITION BY feed ORDER BY page_no) = 0
                AND coalesce(max((bad OR empty OR fifth)::INT) OVER (PARTITION BY feed ORDER BY page_no
                             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 AS reached FROM counted)
SELECT 'articles_ingested_total' AS metric, feed AS source, 'success' AS status, CAST(sum(n) AS DOUBLE) AS value
FROM walk WHERE reached AND NOT bad AND NOT empty AND NOT failed GROUP BY feed
UNION ALL
SELECT 'articles_published_total', feed, '', CAST(sum(n) AS DOUBLE)
FROM walk WHERE reached AND NOT bad AND NOT empty AND NOT failed GROUP BY feed
UNION ALL
SELECT 'articles_ingested_total', feed, 'error_crawl', CAST(1 AS DOUBLE) FROM walk WHERE reached AND (bad OR fifth)
UNION ALL
SELECT 'article_parse_errors_total', feed, '', CAST(count(*) AS DOUBLE) FROM walk WHERE reached AND bad GROUP BY feed""")

ORACLE["h3_counters"] = with_common(f""", {_STREAM_PAGES.strip()}
SELECT m.metric, source, CAST(count(*) AS DOUBLE) AS value
FROM semitted JOIN (VALUES ('cms_articles_processed_total', true), ('cms_sync_errors_total', false),
                           ('dlq_messages_published_total', false)) m(metric, ok) ON m.ok = (length(body) % 7 <> 0)
GROUP BY m.metric, source""")

ORACLE["e2_reset_all"] = """
WITH r AS (SELECT event_id, event_type, ts, coalesce(event_type = 'purchase' AND value > 400, false) AS is_all,
                  CAST(sum(CASE WHEN event_type = 'purchase' AND value > 400 THEN 1 ELSE 0 END) OVER (
                      ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS epoch_all FROM events),
o AS (SELECT *, CASE WHEN NOT is_all THEN CAST(sum(CASE WHEN is_all THEN 0 ELSE 1 END) OVER (
                      PARTITION BY event_type, epoch_all ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) END AS occurrence
      FROM r)
SELECT event_id, event_type, epoch_all, occurrence, coalesce(occurrence = 1 OR occurrence % 10 = 0, false) AS emit FROM o"""

ORACLE["e4_null_labels"] = f"""WITH {_SAMPLES.strip()},
twice AS (SELECT source, nullif(status, 'success') AS status, ts_us, value FROM samples
          UNION ALL SELECT source, nullif(status, 'success'), ts_us, value + 0.5 FROM samples),
d2 AS (SELECT *, lag(value) OVER (PARTITION BY source, status ORDER BY ts_us, value) AS prev FROM twice)
SELECT source, status, round(sum(CASE WHEN prev IS NULL THEN 0.0 WHEN value >= prev THEN value - prev ELSE value END), 6) AS total,
       count(*) AS n FROM d2 GROUP BY source, status"""

ORACLE["d9_increase_by_status"] = f"""WITH {_SAMPLES.strip()}
SELECT status, round(i, 6) AS increase, round(i / 3600.0 * 60, 6) AS per_minute
FROM (SELECT status, sum(CASE WHEN ts_us >= {_AT_US} - 3600000000 THEN delta ELSE 0.0 END) AS i
      FROM deltas WHERE ts_us <= {_AT_US} GROUP BY status)"""

# the first minute of a series has no earlier sample: its observations do not count
_MINUTES = f"""
minutes AS (SELECT event_type AS source, date_trunc('minute', ts) AS m, count(value) AS nt,
                   {", ".join(f"count(*) FILTER (WHERE value <= {float(b)!r}) AS n{i}" for i, b in enumerate(_HIST_BOUNDS))}
            FROM events WHERE ts IS NOT NULL GROUP BY ALL),
later AS (SELECT *, epoch_us(m) AS ts_us, m > min(m) OVER (PARTITION BY source) AS counts FROM minutes)"""


def _rate_quantile_sql(q: float) -> str:
    n = len(_HIST_BOUNDS)
    names = [f"n{i}" for i in range(n)] + ["nt"]
    hourly = ", ".join(f"sum(CASE WHEN counts THEN {x} ELSE 0 END) AS {x}" for x in names)
    w = "OVER (PARTITION BY source ORDER BY bucket ROWS 2 PRECEDING)"
    sums = ", ".join(f"CAST(sum(coalesce({x}, 0)) {w} AS DOUBLE) / 10800.0::DOUBLE AS {'c' + x[1:] if x != 'nt' else 'total'}"
                     for x in names)
    inner = f"""(WITH {_MINUTES.strip()},
h AS (SELECT source, CAST(floor(ts_us / 3600000000) AS BIGINT) AS bucket, {hourly} FROM later GROUP BY ALL),
grid AS (SELECT source, unnest(range(min(bucket), (SELECT max(bucket) FROM h) + 3)) AS bucket FROM h GROUP BY source)
SELECT source, (bucket + 1) * 3600000000 AS eval_us, {sums} FROM grid LEFT JOIN h USING (source, bucket))"""
    body = _quantile_sql(q).replace("SELECT event_type,", "SELECT source, eval_us,", 1)
    body = body.replace(f"{q!r} * total", f"{q!r}::DOUBLE * total")
    return body[:body.index("FROM (SELECT event_type, count(*)")] + f"FROM {inner} WHERE total > 0"


ORACLE["d8_rate_quantile"] = _rate_quantile_sql(0.5) + "\nUNION ALL\n" + _rate_quantile_sql(0.95)


def _rule_sql(rule: str, points: str, last: str, condition: str, hold: int) -> str:
    """Intervals of a rule from its change points (source, status, b, and what
    the condition reads); ``hold`` in steps of 30 s."""
    part = "PARTITION BY source, status ORDER BY b"
    return f"""
SELECT '{rule}' AS rule, source, status, (sb + 1) * 30000000 AS start_us, (eb + 1) * 30000000 AS end_us,
       CASE WHEN sb + {hold} <= eb THEN (sb + {hold} + 1) * 30000000 END AS fire_us
FROM (SELECT source, status, run, min(b) AS sb, max(upto) AS eb
      FROM (SELECT *, sum(CASE WHEN hit THEN 0 ELSE 1 END) OVER ({part} ROWS UNBOUNDED PRECEDING) AS run
            FROM (SELECT *, {condition} AS hit, coalesce(lead(b) OVER ({part}) - 1, ({last})) AS upto FROM {points}))
      WHERE hit GROUP BY source, status, run)"""


def _windows_sql(name: str, steps: str, cols: list[str]) -> str:
    """CTE ``name``: sums over 10 steps at every step where one can change."""
    sums = ", ".join(f"sum({c}) OVER (PARTITION BY source, status ORDER BY b RANGE BETWEEN 9 PRECEDING AND CURRENT ROW) AS {c}"
                     for c in cols)
    zero = ", ".join(f"0 AS {c}" for c in cols)
    return f"""{name} AS (SELECT DISTINCT source, status, b, {sums} FROM (
  SELECT source, status, b, {", ".join(cols)} FROM {steps}
  UNION ALL SELECT source, status, b + 10, {zero} FROM {steps} WHERE b < (SELECT max(b) FROM {steps})))"""


def _gauge_sql(name: str, value: str, where: str) -> str:
    return f"""{name} AS (SELECT 'u' || user_id AS source, '' AS status, CAST(floor(epoch_us(ts) / 30000000) AS BIGINT) AS b,
  arg_max({value}, struct_pack(t := epoch_us(ts), v := {value})) AS v FROM events WHERE {where} GROUP BY ALL)"""


_STEP = "CAST(floor(ts_us / 30000000) AS BIGINT) AS b"
ORACLE["e6_rules"] = f"""WITH {_SAMPLES.strip()}, {_MINUTES.strip()},
every_step AS (SELECT source, status, {_STEP}, sum(delta) * 60 AS v FROM deltas GROUP BY ALL),
error_step AS (SELECT * FROM every_step WHERE status = 'error_crawl'),
slow_step AS (SELECT source, '' AS status, {_STEP}, sum(CASE WHEN counts THEN n3 ELSE 0 END) AS upto10,
                     sum(CASE WHEN counts THEN nt ELSE 0 END) AS total FROM later GROUP BY ALL),
{_windows_sql("every_at", "every_step", ["v"])},
{_windows_sql("error_at", "error_step", ["v"])},
{_windows_sql("slow_at", "slow_step", ["upto10", "total"])},
{_gauge_sql("kafka_at", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END", "user_id % 2 = 0")},
{_gauge_sql("crawler_at", "CASE WHEN event_type = 'error' THEN 0 ELSE 1 END", "user_id % 2 <> 0")},
{_gauge_sql("breaker_at", "CAST(floor(value) AS BIGINT) % 3", "true")}
""" + "\nUNION ALL".join([
    _rule_sql("HighErrorRate", "error_at", "SELECT max(b) + 9 FROM error_step", "v / 300.0 > 0.16", 4),
    _rule_sql("NoArticlesProcessed", "every_at", "SELECT max(b) + 9 FROM every_step", "v = 0", 10),
    _rule_sql("KafkaConnectionDown", "kafka_at", "SELECT max(b) FROM kafka_at", "v = 0", 2),
    _rule_sql("ServiceDown", "crawler_at", "SELECT max(b) FROM crawler_at", "v = 0", 2),
    _rule_sql("CircuitBreakerOpen", "breaker_at", "SELECT max(b) FROM breaker_at", "v = 2", 4),
    _rule_sql("SlowProviderFetch", "slow_at", "SELECT max(b) + 9 FROM slow_step",
              "total > 0 AND upto10 / 300.0::DOUBLE < 0.95::DOUBLE * (total / 300.0::DOUBLE)", 10)])
