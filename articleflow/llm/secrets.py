"""Operator 6: secret scans by multipart credential linking.

Base spans, per kind leftmost and non-overlapping: ``assign`` (a secret's
name, a sign, a value), ``access`` (access identifiers) and ``hex`` (long
hexadecimal runs).  Weak candidates (``weak_id``: an account's name or id,
``weak_secret``: other key names or long mixed strings, ``endpoint``: service
addresses) are far too common alone.  They are reported only where parts
complete each other within a scope of ``SCOPE`` code points: an identifier
beside a secret, a secret beside an identifier, an endpoint beside both.
Base spans count as parts.  The link is an interval join over the parts:
equal text and common bins of the scope's width, then the distance.  A scope
holds a bounded number of parts, so a very long text costs its length.

``redact`` measures the distance as the gap between the spans, so a secret of
any length is linked on both sides.  ``secret_report`` measures it from start
to start, as its SQL does: a part that follows a longer one than the scope is
not linked there.

Positions come from the lengths of the stretches between matches, added up
by a window over the matches.  DataFrame functions only.

Defined results: null text: empty; offsets are code points, end exclusive;
rows are taken one by one, so repeated rows and null ids each give a row;
spans are ordered by start, then kind; texts are taken whole; the report
leaves other columns out and ``redact`` keeps them, so their names cannot
clash; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from articleflow.llm.common import ready, written

SCOPE = 256
MASK = "[SECRET]"
# The base patterns.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"    # the whole run of 20 and more
HEX = r"[0-9a-f]{24,}"           # the whole run of 24 and more
# The weak parts: (pattern, what the match must hold besides).
WEAK_ID = r"""(?i:user_?name|user_?id|login|client_?id|access_?key_?id|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}"""
WEAK_SECRET = r"""(?i:pwd|passphrase|private_?key|access_?key|auth_?key|credential)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{4,}|[A-Za-z0-9+/]{32,}"""
ENDPOINT = r"""(?i:https?|postgres|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._:/@-]{3,}|(?i:host|endpoint|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{3,}"""
#: kind: (pattern, order, part it plays, weak)
KINDS = {"assign": (ASSIGN, 0, "secret", False), "access": (ACCESS, 1, "id", False), "hex": (HEX, 2, "secret", False),
         "weak_id": (WEAK_ID, 3, "id", True), "weak_secret": (WEAK_SECRET, 4, "secret", True),
         "endpoint": (ENDPOINT, 5, "endpoint", True)}


def _stretches(kind: str) -> Column:
    """Matches of a kind, in order: length of the stretch before, length,
    whether it counts; null without a match."""
    pattern = KINDS[kind][0]
    text = F.col("text")
    pat = F.lit(pattern)
    whole = F.regexp_extract_all(text, pat, F.lit(0))
    value = F.regexp_extract_all(text, pat, F.lit(2)) if kind == "assign" else whole
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("match"), value.alias("value"))
    ok = {"assign": lambda x: F.char_length(x["value"]) >= 6,
          "weak_secret": lambda x: x["match"].rlike("[0-9]") & x["match"].rlike("[A-Za-z]")}.get(kind, lambda x: F.lit(True))
    return F.when(text.rlike(pattern), F.transform(rows, lambda x, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.char_length(x["gap"]).alias("gap"),
        F.char_length(x["match"]).alias("size"), ok(x).alias("ok"))))


def find_spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, spans).  rows: doc_id, print (hash of the text), rid (of the
    row).  spans: rid, kind, rank (order of kinds), start, end; base spans and
    linked weak ones.  The scope is the gap between two spans."""
    ready(docs.sparkSession)
    parts = F.concat(*[F.coalesce(_stretches(k), F.array().cast(
        "array<struct<kind:string,i:int,gap:int,size:int,ok:boolean>>")) for k in KINDS])
    found = written(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
                    .select("doc_id", F.xxhash64("text").alias("print"), F.monotonically_increasing_id().alias("rid"),
                            parts.alias("parts")), "matches")
    upto = Window.partitionBy("rid", "kind").orderBy("i")
    rank = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[1])])
    part = F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[2])])
    matches = found.where(F.size("parts") > 0).select("rid", F.inline("parts")).where("size is not null")
    spans = (matches.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("ok")
             .select("rid", "kind", rank[F.col("kind")].alias("rank"), part[F.col("kind")].alias("part"),
                     (F.col("end") - F.col("size")).cast("long").alias("start"), "end"))
    spans = written(spans, "spans")
    kept = spans.where(F.col("rank") < 3)
    weak = spans.where(F.col("rank") >= 3)
    for role, others in (("id", ["secret"]), ("secret", ["id"]), ("endpoint", ["id", "secret"])):
        mine = weak.where(F.col("part") == role)
        for other in others:
            mine = _beside(mine, spans.where(F.col("part") == other))
        kept = kept.unionByName(mine)
    return found.select("doc_id", "print", "rid"), kept.drop("part")


def _beside(mine: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of ``mine`` with a row of ``other`` within the scope: interval
    join on the text and the bins that the other and the surroundings of mine
    reach."""
    last, o_last = F.col("end"), F.col("o_end")
    bin_of = lambda at: F.floor(at / SCOPE)
    left = mine.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start") - SCOPE), bin_of(last + SCOPE))))
    right = (other.select(F.col("rid").alias("o_rid"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
             .withColumn("o_bin", F.explode(F.sequence(bin_of(F.col("o_start")), bin_of(o_last)))))
    near = (F.col("rid") == F.col("o_rid")) & (F.col("bin") == F.col("o_bin")) & (
        F.greatest("start", "o_start") - F.least(last, o_last) <= SCOPE)
    return left.join(right, near, "left_semi").drop("bin").distinct()


def secret_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of each row."""
    rows, spans = find_spans(docs)
    listed = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "rank", "kind", "end"))).alias("s"))
    every = F.coalesce("s", F.array().cast("array<struct<start:bigint,rank:int,kind:string,end:bigint>>"))
    joined = rows.join(listed, "rid", "left").select("doc_id", every.alias("s"))

    def text(s):
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind):
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("s", lambda x: x["rank"] < 3)
    return joined.select("doc_id", count("assign"), count("access"), count("hex"),
                         F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("s")).alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every found span replaced by ``MASK`` in text (and
    n_chars, where there is such a column, counted anew)."""
    rows, spans = find_spans(docs)
    order = Window.partitionBy("rid").orderBy("start", "end")
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("start") < F.col("before"), 0).otherwise(1)).over(
        order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = (spans.withColumn("before", before).withColumn("island", island)
              .groupBy("rid", "island").agg(F.min("start").alias("start"), F.max("end").alias("end")))
    cuts = merged.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("cuts"))
    by_text = written(rows.join(cuts, "rid").groupBy(F.col("doc_id").alias("__id"), F.col("print").alias("__print"))
                      .agg(F.first("cuts").alias("__cuts")), "cuts")   # equal texts have equal cuts
    out = docs.join(by_text, docs["doc_id"].eqNullSafe(by_text["__id"])
                    & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == by_text["__print"]), "left")
    cut, text = F.col("__cuts"), F.col("text")
    start = F.concat(F.array(F.lit(0).cast("long")), cut["end"])
    stop = F.concat(cut["start"], F.array(F.char_length("text").cast("long")))
    pieces = F.zip_with(start, stop, lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int")))
    clean = F.when(cut.isNull(), text).otherwise(F.array_join(pieces, MASK))
    new = {"text": clean.alias("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(cut.isNull(), F.col("n_chars")).otherwise(F.char_length(clean).cast(kind)).alias("n_chars")
    return out.select(*[new.get(c, docs[c]) for c in docs.columns])
