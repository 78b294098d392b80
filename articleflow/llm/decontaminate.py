"""Operator 4: benchmark decontamination by spaced-seed hashing.

Words are the lower-cased runs of letters and digits.  A text is contaminated
by a benchmark item if, on one alignment of the two, some 13 consecutive
words of the item agree with the document in at least 11 places (0.8 and
more), substitutions allowed anywhere.  Of a shorter item 0.8 of the words,
rounded up, must agree on one alignment, which for 4 and fewer is all of them.
Unspaced scripts (Chinese, Japanese, Thai, ...) are cut into characters.

Seeds: a mask selects some positions of a short window and ignores the rest.
Hashes of the selected words of every window are joined between items and
documents.  The default mask (positions 0, 1, 3, 6, 7) hits every pattern of
two substitutions among 13 words, so no overlap is missed; ``SHORT_MASKS`` do
so for each shorter length (tests enumerate both).  Each hit names an
alignment; distinct alignments are verified word by word.  An item of 4 and
fewer words is its own seed: its hit needs no more.  DataFrame functions only.

Items with the same words count as one, reported under the smallest id.  Rows
that share a doc_id are one document.  Defined results: null or empty texts
have no words and match nothing; texts are taken whole, whatever their length;
a null id is an id of its own; ties between alignments go to the first; other
columns, also of clashing names, are left out (``drop_contaminated`` keeps the
documents' own); an empty benchmark or table gives no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import ready, small_side, written

MASKS = ((0, 1, 3, 6, 7),)
WINDOW, NEED = 13, 11
WHOLE = 4                 # an item of up to so many words is its own seed
#: From this many words on, these masks; the next entry's length ends it.
SHORT_MASKS = {1: ((0,),), 2: ((0, 1),), 3: ((0, 1, 2),), 4: ((0, 1, 2, 3),), 5: ((0, 1, 2), (0, 1, 3)),
               6: ((0, 1, 2, 3), (0, 1, 3, 4)), 7: ((0, 1, 3, 4),), 8: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5)),
               10: ((0, 1, 2, 3, 4), (0, 1, 2, 4, 5), (0, 1, 3, 6, 7))}
#: Scripts without blanks between words: Thai, Lao, Burmese, Khmer, Tai, Balinese, Javanese, kana, ideographs.
UNSPACED = (r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u1950-\u19DF\u1A20-\u1AAF\u1B00-\u1B7F\u3005-\u3007\u3040-\u30FF"
            r"\u31F0-\u31FF\u3400-\u4DBF\u4E00-\u9FFF\uA980-\uA9FF\uAA60-\uAA7F\uF900-\uFAFF\uFF66-\uFF9F"
            r"\x{20000}-\x{3FFFF}]")


def short_need(n: int) -> int:
    """Words of an item of ``n`` that must agree: 0.8 of them, rounded up."""
    return (4 * n + 4) // 5


def short_masks(n: int) -> tuple[tuple[int, ...], ...]:
    return SHORT_MASKS[max(k for k in SHORT_MASKS if k <= n)]


def word_hashes(text: Column) -> Column:
    lower = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), UNSPACED, " $0 ")
    words = F.array_remove(F.split(lower, r"[^\p{L}\p{N}]+"), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seed_hashes(words: str, mask: tuple[int, ...]) -> Column:
    """Hash of the selected words of each window of ``words``, by position."""
    w, n = F.col(words), F.size(words)
    span = mask[-1] + 1
    return F.when(n >= span, F.transform(
        F.sequence(F.lit(0), n - span), lambda i: F.xxhash64(F.lit(sum(1 << o for o in mask)), *[F.get(w, i + o) for o in mask])))


def item_classes(benchmark: DataFrame) -> DataFrame:
    """item_id (smallest of the items with these words), words, n."""
    return (benchmark.select("item_id", word_hashes(F.col("text")).alias("words"))
            .where(F.size("words") > 0)
            .groupBy("words").agg(F.min("item_id").alias("item_id"))
            .select("item_id", "words", F.size("words").alias("n")))


def _seeds(rows: DataFrame, keep: list[str], masks: list[tuple[int, ...]]) -> DataFrame:
    """(keep, h, pos) for every window under every mask."""
    arrays = F.array(*[seed_hashes("words", m) for m in masks]) if len(masks) > 1 else None
    if arrays is None:
        return rows.select(*keep, F.posexplode(seed_hashes("words", masks[0])).alias("pos", "h"))
    return (rows.select(*keep, F.explode(arrays).alias("hs"))
            .select(*keep, F.posexplode("hs").alias("pos", "h")))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks=MASKS) -> DataFrame:
    """(doc_id, item_id, n_match, n_item): each contaminated document with
    the items found in it; n_match counts the agreeing words of the best
    alignment's matching windows."""
    ready(docs.sparkSession)
    items = written(item_classes(benchmark), "items")
    short = sorted(r[0] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())  # 12 values at most
    by_length = {n: short_masks(n) for n in short}
    every = list(dict.fromkeys([tuple(m) for m in masks] + [m for ms in by_length.values() for m in ms]))
    item_seeds = _seeds(items.where(F.col("n") >= WINDOW), ["item_id", "n"], [tuple(m) for m in masks])
    for n, ms in by_length.items():
        item_seeds = item_seeds.unionByName(_seeds(items.where(F.col("n") == n), ["item_id", "n"], list(ms)))
    at = F.when(F.col("n") > WHOLE, F.col("pos")).alias("at")     # null: the seed is the whole item
    item_seeds = written(item_seeds.select("item_id", at, "h"), "item_seeds")
    doc_seeds = _seeds(docs.select("doc_id", word_hashes(F.col("text")).alias("words")), ["doc_id"], every)
    hits = doc_seeds.join(small_side(item_seeds, 64), "h")
    hits = written(hits.select("doc_id", "item_id", (F.col("pos") - F.col("at")).alias("shift")).distinct(), "aligned")
    aligned = hits.where("shift is not null")
    # only documents with a hit are read again
    ids = written(aligned.select(F.col("doc_id").alias("hit_id")).distinct(), "hit_ids")
    again = docs.select("doc_id", "text").join(small_side(ids, 16), F.col("doc_id").eqNullSafe(F.col("hit_id")), "left_semi")
    tries = aligned.select(F.col("doc_id").alias("hit_id"), "item_id", "shift").join(
        items.withColumnRenamed("words", "item_words"), "item_id")
    pairs = (again.select("doc_id", word_hashes(F.col("text")).alias("words"))
             .join(tries, F.col("doc_id").eqNullSafe(F.col("hit_id"))))
    size = F.least("n", F.lit(WINDOW))
    need = F.when(F.col("n") < WINDOW, F.floor((4 * F.col("n") + 4) / 5)).otherwise(NEED)
    same = F.transform("item_words", lambda w, i: F.coalesce(F.get("words", F.col("shift") + i) == w, F.lit(False)).cast("int"))
    good = F.filter(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.aggregate(
        F.slice("same", i + 1, F.col("size")), F.lit(0), lambda a, x: a + x) >= F.col("need"))
    n_match = F.size(F.filter(F.sequence(F.lit(0), F.col("n") - 1), lambda i: (F.get("same", i) == 1) & F.exists(
        "good", lambda g: (i >= g) & (i < g + F.col("size")))))
    found = (pairs.select("doc_id", "item_id", "n", size.alias("size"), need.alias("need"), same.alias("same"))
             .withColumn("good", good).where(F.size("good") > 0)
             .select("doc_id", "item_id", n_match.alias("n_match"), F.col("n").alias("n_item")))
    found = found.unionByName(hits.where("shift is null").join(items, "item_id").select(
        "doc_id", "item_id", F.col("n").alias("n_match"), F.col("n").alias("n_item")))
    return found.groupBy("doc_id", "item_id").agg(F.max("n_match").cast("long").alias("n_match"),
                                                  F.max("n_item").cast("long").alias("n_item"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, least_words: int = 2) -> DataFrame:
    """``docs`` without the documents contaminated by an item of at least
    ``least_words`` words: a benchmark item of one word stands in many clean
    texts, so by default it is only reported (:func:`contaminated`)."""
    found = contaminated(docs, benchmark).where(F.col("n_item") >= least_words)
    bad = written(found.select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__bad"]), "left_anti")
