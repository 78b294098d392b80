"""Operator 8: token counts by heap-and-linked-list byte-pair merging.

A marked word starts as a list of characters linked to their neighbours.  The
adjacent pair of the lowest rank (best score; on a tie the leftmost) is popped
from a heap and merged until no pair of neighbours is a piece.  The count is
the initial symbols minus the merges; a character without a piece counts as
its UTF-8 bytes.  No identifiers are made.  Words are independent, because no
piece crosses a word's end (checked when the table is read), so a task counts
each distinct word once and keeps the counts in a bounded table.

Defined results: null or empty text: 0 tokens, 0 bytes; a text is never cut,
whatever its length; repeated rows each give a row; other columns are left
out, so their names cannot clash; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready
from articleflow.llm.pieces import Pieces, shared

BYTES_KEPT = 64 << 20  # of the words that a worker keeps counts of, about; beyond, the table starts anew


def count_word(word: str, scores: dict[str, float], known: set[str]) -> int:
    """Tokens of one marked word."""
    n = len(word)
    total = sum(1 if c in known else len(c.encode()) for c in word)
    if n < 2:
        return total
    symbol = list(word)              # '' once merged into its left neighbour
    left = list(range(-1, n - 1))
    right = list(range(1, n + 1))
    heap = []
    for i in range(n - 1):
        s = scores.get(word[i:i + 2])
        if s is not None:
            heap.append((-s, i, 2, i + 1))
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    while heap:
        _, i, size, j = pop(heap)
        a = symbol[i]
        if not a or right[i] != j or len(a) + len(symbol[j]) != size:
            continue                 # one of the two has changed since
        symbol[i] = merged = a + symbol[j]
        symbol[j] = ""
        total -= 1
        k = right[i] = right[j]
        if k < n:
            left[k] = i
            s = scores.get(merged + symbol[k])
            if s is not None:
                push(heap, (-s, i, size + len(symbol[k]), k))
        h = left[i]
        if h >= 0:
            s = scores.get(symbol[h] + merged)
            if s is not None:
                push(heap, (-s, h, size + len(symbol[h]), i))
    return total


class _Counts(dict):
    """Counts by word, computed when first asked for."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.scores = pieces.scores
        self.known = {p for p in pieces.ids if len(p) == 1}
        self.size = 0

    def __missing__(self, word):
        n = count_word(word, self.scores, self.known)
        self.size += 120 + 4 * len(word)
        if self.size > BYTES_KEPT:
            self.clear()
            self.size = 0
        self[word] = n
        return n


_KEPT: dict[str, _Counts] = {}       # of this worker process, for its next tasks


def _make(table):
    pieces = table.value
    key = f"{len(pieces.ids)}:{hash(frozenset(pieces.scores.items()))}"
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = _Counts(pieces)
    count, words = _KEPT[key].__getitem__, pieces.splitter()

    def run(texts):
        return [[sum(map(count, words(t))) for t in texts.to_pylist()]]
    return run


def count_tokens(docs: DataFrame, text_col: str = "text", model_path: str | None = None,
                 out: str = "n_tokens") -> DataFrame:
    """``docs`` with the column ``out`` (long): tokens of each whole text."""
    spark = ready(docs.sparkSession)
    table = shared(spark, model_path)
    return append_columns(docs, [text_col], partial(_make, table), [field(out, "long")])


def token_report(docs: DataFrame, limit: int = 4096, model_path: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens and whether the text is over ``limit`` tokens."""
    rows = docs.select("doc_id", "text")
    counted = count_tokens(rows, model_path=model_path)
    return counted.select("doc_id",
                          F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
                          "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
