"""Operator 7: quality rules with risk-controlled thresholds.

Fixed base rules reject texts of few or mostly repeated words.  Beyond them,
each rule compares a share (symbols, capitals, repeated lines, repeated
words) with a cutoff that the labelled documents must justify, stratum by
stratum (language): a cutoff may be used only if, on the labelled holdout, an
exact binomial test shows that it rejects fewer than ``risk / rules`` of the
stratum's good documents.  All strata, rules and cutoffs are tested at once,
so the level is ``delta`` divided by their number (Bonferroni).  With
probability ``1 - delta`` the rules together then reject at most ``risk`` of
the good documents of every stratum.  Of the permitted cutoffs the one that
separates the holdout best is used; without any, the rule is off there.

Defined results: null or empty text: no words, rejected by the base rules; a
null language is a stratum of its own; labels that are null or whose document
is missing are ignored, several labels of a document count as its worst;
repeated rows each give a row; without labels only the base rules reject.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready, written

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]
#: Rules: numerator and denominator of the share that a cutoff bounds.
RULES = {"symbols": ("n_symbols", "word_chars"), "capitals": ("n_upper", "word_chars"),
         "dup_lines": ("n_dup_lines", "n_lines"), "repeats": ("n_repeat_words", "n_words")}
CUTOFFS = [0.02, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]

_SPACE = dict.fromkeys(b" \t\n\x0b\x0c\r")
_SYMBOLS = b"#*$%&|<>"                       # fixed value
_NOT_SYMBOLS = bytes(sorted(set(range(256)) - set(_SYMBOLS)))
_NOT_UPPER = bytes(sorted(set(range(256)) - set(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")))
_NOT_STARTS = bytes(range(0x80, 0xC0)) + bytes(_SPACE)   # UTF-8 continuation bytes, white space
_WORD = re.compile(rb"[^\x20\x09-\x0D]")


def repeated_words(words: list[bytes]) -> int:
    """Words that stand in a 3-word window found twice or more."""
    if len(words) < 4:
        return 0
    number: dict[bytes, int] = {}
    w = np.array([number.setdefault(x, len(number)) for x in words], np.int64)
    # pairs get numbers first, so that no code overflows
    _, pair = np.unique(w[:-1] * len(number) + w[1:], return_inverse=True)
    _, at, n = np.unique(pair[:-1] * len(number) + w[2:], return_inverse=True, return_counts=True)
    twice = n[at] > 1
    hit = np.zeros(len(words), bool)
    for i in range(3):
        hit[i:i + len(twice)] |= twice
    return int(hit.sum())


def text_counts(text: str | None) -> tuple[int, ...]:
    """The counts of :data:`COUNTS` for one whole text."""
    raw = (text or "").encode()
    words = raw.split()                      # bytes: splits at ASCII white space
    lines = Counter(x for x in raw.split(b"\n") if _WORD.search(x)) if raw else {}
    n_lines = sum(lines.values())
    return (len(words), len(raw.translate(None, _NOT_STARTS)), len(raw.translate(None, _NOT_SYMBOLS)),
            n_lines - len(lines), repeated_words(words), n_lines, len(raw.translate(None, _NOT_UPPER)))


def _make_counts():
    def run(texts):
        rows = [text_counts(t) for t in texts.to_pylist()]
        return [pa.array(list(c), type=pa.int64()) for c in zip(*rows)] if rows else [pa.array([], pa.int64())] * len(COUNTS)
    return run


def with_counts(docs: DataFrame, text_col: str = "text", prefix: str = "") -> DataFrame:
    """``docs`` with the counts of each whole text."""
    ready(docs.sparkSession)
    return append_columns(docs, [text_col], _make_counts, [field(prefix + c, "long") for c in COUNTS])


def base_failed(prefix: str = "") -> Column:
    n, r = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < 50) | (100 * r > 50 * n)


def share(rule: str, prefix: str = "") -> Column:
    a, b = (F.col(prefix + c) for c in RULES[rule])
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed from its largest term down."""
    if k >= n * p:
        return 1.0                           # never evidence of a lower rate
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                    + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-18:
        total += term
        term *= i * (1 - p) / ((n - i + 1) * p)
        i -= 1
    return total


def _make_tail(p: float):
    return lambda k, n: [[binomial_tail(a, b, p) for a, b in zip(k.to_pylist(), n.to_pylist())]]


def fit_cutoffs(counted: DataFrame, labels: DataFrame, stratum_col: str = "lang",
                risk: float = 0.02, delta: float = 0.05) -> DataFrame:
    """(stratum, cutoffs map<rule, cutoff>) from all labelled rows of
    ``counted`` (doc_id, stratum, counts).  Rows: the strata; nothing larger
    is gathered."""
    worst = (labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
             .where("doc_id is not null and q is not null"))
    tries = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("cutoff"), (share(r) > c).alias("hit"))
                      for r in RULES for c in CUTOFFS])
    good = (F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)
    seen = (counted.where(~base_failed()).join(worst, "doc_id")
            .select(F.coalesce(stratum_col, F.lit("")).alias("stratum"), good.alias("good"),
                    (F.col("q") == 0).alias("bad"), F.inline(tries))
            .groupBy("stratum", "rule", "cutoff")
            .agg(F.count_if("good").alias("n"), F.count_if(F.col("good") & F.col("hit")).alias("k"),
                 F.count_if("bad").alias("n_bad"), F.count_if(F.col("bad") & F.col("hit")).alias("k_bad")))
    seen = written(seen, "holdout")
    tests = max(1, seen.count())
    tail = append_columns(seen, ["k", "n"], partial(_make_tail, risk / len(RULES)), [field("tail", "double")])
    gain = F.col("k_bad") / F.col("n_bad") - 10 * F.col("k") / F.col("n")
    fit = (tail.where((F.col("tail") <= delta / tests) & (F.col("k_bad") > 0)).withColumn("gain", gain).where("gain > 0")
           .groupBy("stratum", "rule").agg(F.max_by("cutoff", F.struct("gain", "cutoff")).alias("cutoff")))
    return written(fit.groupBy("stratum").agg(
        F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("cutoffs")), "cutoffs")


def judge(counted: DataFrame, cutoffs: DataFrame, stratum_col: str = "lang", prefix: str = "") -> DataFrame:
    """``counted`` with ``__kept``."""
    c = cutoffs.select(F.col("stratum").alias("__stratum"), F.col("cutoffs").alias("__cutoffs"))
    rows = counted.join(c, F.coalesce(counted[stratum_col], F.lit("")) == c["__stratum"], "left")
    over = F.lit(False)
    for r in RULES:
        over = over | F.coalesce(share(r, prefix) > F.col("__cutoffs")[r], F.lit(False))
    return rows.withColumn("__kept", ~base_failed(prefix) & ~over).drop("__stratum", "__cutoffs")


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    counted = written(with_counts(docs.select("doc_id", "text", "lang")).drop("text"), "counts")
    out = judge(counted, fit_cutoffs(counted, labels))
    return out.select("doc_id", *COUNTS[:5], base_failed().alias("base_failed"), F.col("__kept").alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows.  The texts are read twice and never
    shuffled: once for the labelled counts, once to judge each row in place."""
    narrow = with_counts(docs.select("doc_id", "text", "lang")).drop("text")
    cutoffs = fit_cutoffs(narrow, labels)
    shown = with_counts(docs, prefix="__q_")
    return judge(shown, cutoffs, prefix="__q_").where("__kept").select(*docs.columns)
