"""Operator 2: language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1, hashed from its code point and a
seed, so letters of all scripts differ.  An n-gram's vector binds its
letters' vectors, each rotated by its place, by multiplication; a text's
vector bundles its n-grams by addition (words are bounded by a vector of
their own).  A language's prototype bundles the unit vectors of its training
texts.  A text gets the language whose prototype has the largest cosine.

All sums are over integers, so results do not depend on how rows are dealt
out.  Training reads all labelled training rows: each task adds up one vector
per language, Spark adds these up, and only the prototypes (languages x
``DIM`` numbers) reach the driver.

Defined results: null text or a text without a letter: ``und``, score 0; texts
are taken whole; a tie goes to the language first in order; null ``lang`` does
not train; without training rows every text is ``und``; repeated rows each
give a row and train as often; an empty table gives no row; ``predict`` keeps
other columns and refuses an input column named like an output.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready

DIM = 1024
BITS = 21                # of a code point; three fit in the code of an n-gram
ROWS_AT_ONCE = 64        # texts of one matrix product
GRAMS_KEPT = 16_384      # n-gram vectors that a worker keeps
UNIT = 1 << 20           # unit vectors are rounded to this many steps
MAX_LANGS = 2_000        # bound on what the driver and each worker hold (16 MB)


def letter_vectors(points: np.ndarray, seed: int) -> np.ndarray:
    """Vectors of +1 and -1 of some code points (0: the border of a word),
    from 64 hashed bits at a time."""
    x = points.astype(np.uint64)[:, None] * np.uint64(DIM // 64) + np.arange(DIM // 64, dtype=np.uint64)
    x += np.uint64(seed * 0x9E3779B97F4A7C15 % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 0x9E3779B97F4A7C15)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    x ^= x >> np.uint64(32)
    return np.unpackbits(x.astype("<u8").view(np.uint8), axis=1).astype(np.int8) * 2 - 1


class Profiler:
    """Vectors of texts; the letters' vectors follow from the seed."""

    def __init__(self, seed: int = 7):
        self.seed = seed
        n = 0x110000
        self.letter = np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)
        self.rows: dict[int, int] = {}
        self.table = np.empty((GRAMS_KEPT, DIM), np.float32)

    def grams(self, text: str | None):
        """Codes and counts of the letter 3-grams; None without a letter."""
        raw = np.frombuffer((text or "").lower().encode("utf-32-le"), np.uint32)
        c = np.where(self.letter[raw], raw, 0).astype(np.int64)
        c = np.concatenate(([0], c, [0]))
        c = c[(c > 0) | (np.concatenate(([1], c[:-1])) > 0)]     # one boundary between words
        if len(c) < 3:
            return None
        return np.unique((c[:-2] << 2 * BITS) | (c[1:-1] << BITS) | c[2:], return_counts=True)

    def _vectors(self, codes: np.ndarray) -> np.ndarray:
        new = [g for g in codes.tolist() if g not in self.rows]
        if len(self.rows) + len(new) > GRAMS_KEPT:
            self.rows.clear()
            new = codes.tolist()
        if len(new) > GRAMS_KEPT:             # more kinds than are kept
            return self._bind(codes)
        if new:
            n = len(self.rows)
            self.table[n:n + len(new)] = self._bind(np.array(new))
            self.rows.update(zip(new, range(n, n + len(new))))
        return self.table[[self.rows[g] for g in codes.tolist()]]

    def _bind(self, codes):
        low = (1 << BITS) - 1
        points, at = np.unique(np.concatenate((codes >> 2 * BITS, (codes >> BITS) & low, codes & low)), return_inverse=True)
        letter = letter_vectors(points, self.seed)
        a, b, c = np.split(at, 3)
        return (np.roll(letter, 2, 1)[a] * np.roll(letter, 1, 1)[b] * letter[c]).astype(np.float32)

    def vectors(self, texts: list[str | None]):
        """(rows with a letter, their integer vectors), a few texts at a time."""
        for i in range(0, len(texts), ROWS_AT_ONCE):
            found = [(j, g) for j, g in ((j, self.grams(texts[j])) for j in range(i, min(i + ROWS_AT_ONCE, len(texts)))) if g]
            if not found:
                continue
            codes = np.unique(np.concatenate([g[0] for _, g in found]))
            long = max(int(g[1].sum()) for _, g in found) >= 1 << 23
            count = np.zeros((len(found), len(codes)), np.float64 if long else np.float32)
            for row, (_, g) in enumerate(found):
                count[row, np.searchsorted(codes, g[0])] = g[1]
            yield [j for j, _ in found], (count @ self._vectors(codes)).astype(np.float64)


_PROFILER: list[Profiler] = []               # of this worker process


def _profiler() -> Profiler:
    if not _PROFILER:
        _PROFILER.append(Profiler())
    return _PROFILER[0]


def _unit(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)


def _partial_sums(batches):
    prof, sums = _profiler(), {}
    for b in batches:
        langs = b.column(1).to_pylist()
        for rows, v in prof.vectors(b.column(0).to_pylist()):
            for j, x in zip(rows, np.rint(_unit(v) * UNIT).astype(np.int64)):
                sums[langs[j]] = sums.get(langs[j], 0) + x
    for lang, v in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([lang] * DIM), pa.array(np.arange(DIM, dtype=np.int32)), pa.array(v)],
                                         names=["lang", "dim", "v"])


def fit(train: DataFrame) -> dict[str, np.ndarray]:
    """Prototypes by language from ``train`` (text, lang), all its rows."""
    ready(train.sparkSession)
    sums = (train.where("lang is not null and text is not null").select("text", "lang")
            .mapInArrow(_partial_sums, "lang string, dim int, v long")
            .groupBy("lang", "dim").agg(F.sum("v").alias("v"))
            .groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("dim", "v"))).alias("v"))
            .select("lang", F.col("v.v").alias("v")))
    rows = sums.limit(MAX_LANGS + 1).collect()
    if len(rows) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages: raise MAX_LANGS if workers can hold their prototypes")
    return {r["lang"]: np.array(r["v"], np.float64) for r in rows}


def _make_predict(names: list[str], prototypes: np.ndarray):
    prof = _profiler()

    def run(texts):
        texts = texts.to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        if names:
            for rows, v in prof.vectors(texts):
                cos = np.round(_unit(v) @ prototypes.T, 6)
                for j, best, c in zip(rows, cos.argmax(1), cos.max(1)):
                    lang[j], score[j] = names[best], min(1.0, max(0.0, float(c)))
        return [lang, score]
    return run


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text_col: str = "text",
            lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """``docs`` with the predicted language of each whole text and its cosine."""
    ready(docs.sparkSession)
    for out in (lang_out, score_out):
        if out in docs.columns:
            raise ValueError(f"the input has a column {out!r}; name another one")
    names = sorted(prototypes)
    table = _unit(np.array([prototypes[n] for n in names])) if names else np.empty((0, DIM))
    return append_columns(docs, [text_col], partial(_make_predict, names, table),
                          [field(lang_out, "string"), field(score_out, "double")])


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: prototypes from the rows that are
    not held out, predictions for all."""
    rows = docs.select("doc_id", "text", "lang", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2,
                                                            F.lit(False)).alias("held_out"))
    prototypes = fit(rows.where(~F.col("held_out")).select("text", "lang"))
    return predict(rows.select("doc_id", "text", "held_out"), prototypes).select("doc_id", "held_out", "lang_pred", "score")
