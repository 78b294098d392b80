"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

import re

from articleflow.llm.chat_format import END, START, TEXT, TURN
from articleflow.llm.decontaminate import UNSPACED
from articleflow.llm.quality import CUTOFFS, RULES
from articleflow.llm.secrets import KINDS, SCOPE

_CONTROL = r"(<\\*(/?s>|\|[a-z_]+\|>|/?SYS>>)|\[\\*/?INST\])"

OP3 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
s AS (SELECT *, lag(role) OVER w AS before, row_number() OVER w AS n FROM t
      WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
c AS (SELECT *, (before IS NULL OR before <> role) AS opens,
             length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS shown,
             length(role) + len(regexp_extract_all(role, '{_CONTROL}')) AS shown_role FROM s)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(shown + CASE WHEN opens THEN {len(START + TEXT + END)} + shown_role ELSE {len(TURN)} END)::BIGINT
         AS formatted_chars
FROM c GROUP BY conv_id"""

# as in the operator, with code points written for this engine
_UNSPACED = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", UNSPACED)

OP4 = r"""
WITH raw AS (
  SELECT 'd' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
split AS (SELECT side, id, [x FOR x IN string_split_regex(regexp_replace(lower(coalesce(text, '')), '""" + _UNSPACED + r"""', ' \0 ', 'g'),
                                                      '[^\p{L}\p{N}]+') IF x <> ''] AS w
          FROM raw),
items AS (SELECT min(id) AS item_id, w, len(w) AS n FROM split WHERE side = 'b' AND len(w) > 0 GROUP BY w),
dw AS (SELECT id AS doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM split WHERE side = 'd'),
iw AS (SELECT item_id, n, unnest(w) AS w, generate_subscripts(w, 1) AS p FROM items),
-- two substitutions among 13 words leave 4 equal words in a row; a shorter item has an equal word somewhere
d4 AS (SELECT doc_id, p, concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v) AS g
       FROM dw WINDOW v AS (PARTITION BY doc_id ORDER BY p)),
i4 AS (SELECT item_id, p, concat_ws(' ', w, lead(w, 1) OVER v, lead(w, 2) OVER v, lead(w, 3) OVER v) AS g
       FROM iw WHERE n >= 13 WINDOW v AS (PARTITION BY item_id ORDER BY p)),
shifts AS (SELECT DISTINCT doc_id, item_id, d4.p - i4.p AS s FROM d4 JOIN i4 USING (g)
           UNION SELECT DISTINCT doc_id, item_id, dw.p - iw.p FROM dw JOIN iw USING (w) WHERE n < 13),
eq AS (SELECT s.doc_id, s.item_id, s.s, iw.p, iw.n, (dw.w IS NOT NULL AND dw.w = iw.w)::INT AS e
       FROM shifts s JOIN iw USING (item_id) LEFT JOIN dw ON dw.doc_id = s.doc_id AND dw.p = iw.p + s.s),
win AS (SELECT *, sum(e) OVER (PARTITION BY doc_id, item_id, s ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS k
        FROM eq),
good AS (SELECT *, CASE WHEN n >= 13 THEN p <= n - 12 AND k >= 11 ELSE p = 1 AND k >= (4 * n + 4) // 5 END AS ok FROM win),
cover AS (SELECT *, max(ok::INT) OVER (PARTITION BY doc_id, item_id, s ORDER BY p
                                       ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS c FROM good),
per AS (SELECT doc_id, item_id, s, n, sum(e * c) AS n_match FROM cover GROUP BY ALL HAVING max(c) = 1)
SELECT doc_id, item_id, max(n_match)::BIGINT AS n_match, max(n)::BIGINT AS n_item FROM per GROUP BY doc_id, item_id"""


def _op6() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    ok = {"assign": "length(value) >= 6", "weak_secret": "regexp_matches(match, '[0-9]') AND regexp_matches(match, '[A-Za-z]')"}
    each = [f"""SELECT rid, '{k}' AS kind, {rank} AS rank, '{part}' AS part, i, gap, match, {ok.get(k, 'true')} AS ok FROM (
        SELECT rid, unnest(string_split_regex(text, {quote(p)})) AS gap,
               unnest(regexp_extract_all(text, {quote(p)}, 0)) AS match,
               unnest(regexp_extract_all(text, {quote(p)}, {2 if k == 'assign' else 0})) AS value,
               generate_subscripts(string_split_regex(text, {quote(p)}), 1) AS i
        FROM d WHERE regexp_matches(text, {quote(p)})) WHERE match IS NOT NULL"""
            for k, (p, rank, part, _) in KINDS.items()]
    near = ("EXISTS (SELECT 1 FROM spans o WHERE o.rid = s.rid AND o.part = '{}' AND greatest(o.start, s.start) - least(o.stop, s.stop) <= %d)" % SCOPE)
    listed = "coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank){}, '')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
m AS ({' UNION ALL '.join(each)}),
pos AS (SELECT *, sum(length(gap) + length(match)) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM m),
spans AS (SELECT rid, kind, rank, part, (stop - length(match))::BIGINT AS start, stop::BIGINT AS stop FROM pos WHERE ok),
kept AS (SELECT * FROM spans s WHERE rank < 3
  OR (part = 'id' AND {near.format('secret')}) OR (part = 'secret' AND {near.format('id')})
  OR (part = 'endpoint' AND {near.format('id')} AND {near.format('secret')}))
SELECT any_value(doc_id) AS doc_id,
       count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
       count(*) FILTER (kind = 'hex') AS n_hex,
       sha256({listed.format(' FILTER (rank < 3)')}) AS base_sha256, {listed.format(' FILTER (rank IS NOT NULL)')} AS spans
FROM d LEFT JOIN kept USING (rid) GROUP BY rid"""


def _op7(risk: float = 0.02, delta: float = 0.05) -> str:
    p = risk / len(RULES)
    tries = " UNION ALL ".join(
        f"SELECT doc_id, stratum, '{r}' AS rule, unnest({CUTOFFS!r}) AS cutoff,"
        f" CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END AS share FROM ok" for r, (a, b) in RULES.items())
    over = " OR ".join(
        f"coalesce(CASE WHEN {b} > 0 THEN {a} / {b} ELSE 0 END > "
        f"(SELECT cutoff FROM fit x WHERE x.stratum = r.stratum AND x.rule = '{n}'), false)" for n, (a, b) in RULES.items())
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS stratum, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, unnest(l) AS w, generate_subscripts(l, 1) AS p
      FROM (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS l FROM d)),
g AS (SELECT *, lead(w, 1) OVER v AS w2, lead(w, 2) OVER v AS w3 FROM w WINDOW v AS (PARTITION BY rid ORDER BY p)),
n AS (SELECT *, (w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, w, w2, w3) > 1)::INT AS r FROM g),
c AS (SELECT *, max(r) OVER (PARTITION BY rid ORDER BY p ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c FROM n),
words AS (SELECT rid, count(*) AS n_words, sum(length(w))::BIGINT AS word_chars, sum(c)::BIGINT AS n_repeat_words
          FROM c GROUP BY rid),
l AS (SELECT rid, line, count(*) AS k FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid, line),
lines AS (SELECT rid, sum(k)::BIGINT AS n_lines, sum(k - 1)::BIGINT AS n_dup_lines FROM l GROUP BY rid),
r AS (SELECT d.rid, doc_id, stratum, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines,
             length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
      FROM d LEFT JOIN words ON words.rid = d.rid LEFT JOIN lines ON lines.rid = d.rid),
b AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed FROM r),
ok AS (SELECT * FROM b WHERE NOT base_failed),
lab AS (SELECT doc_id, min(quality) AS q, coalesce(max(toxic), 0) AS t FROM labels GROUP BY doc_id
        HAVING min(quality) IS NOT NULL),
tries AS ({tries}),
seen AS (SELECT stratum, rule, cutoff, count(*) FILTER (q = 1 AND t = 0) AS n,
                count(*) FILTER (q = 1 AND t = 0 AND share > cutoff) AS k,
                count(*) FILTER (q = 0) AS n_bad, count(*) FILTER (q = 0 AND share > cutoff) AS k_bad
         FROM tries JOIN lab USING (doc_id) GROUP BY ALL),
tail AS (SELECT *, CASE WHEN k >= n * {p} THEN 1 ELSE list_sum([
           exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))
           FOR i IN range(k + 1)]) END AS tail FROM seen),
fit AS (SELECT stratum, rule, max_by(cutoff, {{'g': k_bad / n_bad - 10 * k / n, 'c': cutoff}}) AS cutoff
        FROM tail WHERE n > 0 AND n_bad > 0 AND tail <= {delta} / (SELECT greatest(1, count(*)) FROM seen) AND k_bad > 0
          AND k_bad / n_bad - 10 * k / n > 0 GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       (NOT base_failed AND NOT ({over})) AS kept
FROM b AS r"""


def _op11() -> str:
    """The tree by recursion: a level's nodes from the level below; proofs and
    folds climb with a row each.  DuckDB has no crc32, so its bits are taken
    through the polynomial."""
    h = lambda text: "sha256(concat(" + ", ".join(
        f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
        for c in ("doc_id", "source", "lang", "n_chars", text)) + "))"
    bit = "CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::BIGINT) ELSE c // 2 END"
    byte = "list_reduce([xor(a::BIGINT, b::BIGINT)] || range(8), lambda c, i: " + bit + ")"
    crc = ("list_reduce([4294967295::BIGINT] || [ascii(x)::BIGINT FOR x IN string_split(doc_id::VARCHAR, '')], "
           f"lambda a, b: {byte})")

    def climb(name, rows):
        # nodes of all levels of the trees of ``rows`` (tree, pos, h, n)
        return f"""{name} AS (
  SELECT tree, 0 AS level, pos, h, n FROM ({rows})
  UNION ALL
  SELECT tree, level + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 2) // 3
  FROM {name} WHERE n > 1 GROUP BY tree, level, pos // 3)"""

    def proof(name, nodes, rows):
        # per level the siblings before and after, then one row per leaf
        return f"""{name} AS (
  SELECT r.rid, list(struct_pack(l := coalesce(l, ''), r := coalesce(r, '')) ORDER BY level) AS proof FROM (
    SELECT r.rid, s.level, string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos < r.pos // (3 ** s.level)::BIGINT) AS l,
           string_agg(s.h, '' ORDER BY s.pos) FILTER (s.pos > r.pos // (3 ** s.level)::BIGINT) AS r
    FROM {rows} r JOIN {nodes} s ON s.tree = r.tree AND s.n > 1
     AND s.pos // 3 = r.pos // (3 ** (s.level + 1))::BIGINT
    GROUP BY r.rid, s.level) AS r GROUP BY r.rid)"""

    return f"""
WITH RECURSIVE leaves AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce('=' || source, '') AS tree, {h("text")} AS leaf,
         CASE WHEN doc_id IS NOT NULL AND xor({crc}, 4294967295::BIGINT) % 2 = 0
              THEN {h("replace(text, chr(10), '')")} ELSE {h("text")} END AS claimed FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
                  count(*) OVER (PARTITION BY tree) AS n FROM leaves),
{climb("low", "SELECT tree, pos, leaf AS h, n FROM placed")},
subs AS (SELECT tree AS name, h AS subroot, 'all' AS tree, row_number() OVER (ORDER BY encode(tree)) - 1 AS pos,
                count(*) OVER () AS n, row_number() OVER (ORDER BY encode(tree)) AS rid FROM low WHERE n = 1),
{climb("high", "SELECT tree, pos, subroot AS h, n FROM subs")},
{proof("low_proof", "low", "placed")},
{proof("high_proof", "high", "subs")},
proofs AS (SELECT p.rid, p.doc_id, p.leaf, p.claimed, s.subroot,
                  coalesce(lp.proof, []) || coalesce(hp.proof, []) AS proof
           FROM placed p JOIN subs s ON s.name = p.tree LEFT JOIN low_proof lp ON lp.rid = p.rid
           LEFT JOIN high_proof hp ON hp.rid = s.rid),
fold AS (SELECT rid, 0 AS i, claimed AS h FROM proofs
         UNION ALL SELECT f.rid, i + 1, sha256(proof[i + 1].l || h || proof[i + 1].r)
         FROM fold f JOIN proofs p ON p.rid = f.rid AND i < len(proof)),
ends AS (SELECT rid, arg_max(h, i) AS folded_root FROM fold GROUP BY rid)
SELECT doc_id, leaf, subroot, (SELECT max(h) FROM high WHERE n = 1) AS root,
       sha256(array_to_string([x.l || x.r FOR x IN proof], '')) AS proof_sha256, folded_root,
       folded_root = (SELECT max(h) FROM high WHERE n = 1) AS verified
FROM proofs JOIN ends USING (rid)"""


ORACLE = {"op3_chat_format": OP3, "op4_decontaminate": OP4, "op6_secrets": _op6(), "op7_quality": _op7(),
          "op11_merkle": _op11()}
