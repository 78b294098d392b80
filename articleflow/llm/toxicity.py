"""Operator 13: toxicity of texts behind noisy-channel deobfuscation.

1. A character language model (4-grams of a-z, a word's border and one symbol
   for all other letters) is counted over every text.
2. Suspicious spans of a text (signs for letters, letters with separators
   between them, a letter three or more times in a row) become lattices of
   readings.  A reading has the cost of its channel (a sign read as a letter,
   a separator dropped, repeats folded to two or one) plus the surprise of
   the model; Viterbi takes the cheapest path, exactly, over all contexts of
   three characters.  All other words are kept as they are.
3. The restored text is scored by a logistic regression over how often its
   words and the beginnings of its words occur.

The language model counts all texts.  The classifier learns from the
``TRAIN_ROWS`` labelled doc_ids of the smallest hash (all, if they are fewer),
so that texts stay where they are and only these ids are broadcast.  Features
are hashed to ``BUCKETS`` numbers; each task counts, by label, the documents
that have one, Spark adds the counts up, and the ``KEPT`` features that tell
the labels apart best (chi-squared, ties by number) get a weight; toxic rows, the fewer, count
``TOXIC_WEIGHT`` times.  So what is
broadcast is bounded by the alphabet and these three numbers, whatever the
data's size.

Defined results: a null or empty text scores like any text without features;
texts are taken whole; without training rows of both labels every score is
the share of toxic ones (0 without any); a null label does not train, of
several labels of a doc_id the highest counts; repeated rows score each;
ties in a lattice go to the reading listed first; other columns are left out
(``score`` keeps them and refuses an input column named like an output); an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready, written

SYMBOLS = 28               # border, a to z, any other letter
OTHER = 27
SMOOTH = 8.0               # weight of the shorter context
BUCKETS = 1 << 18          # hashed features
KEPT = 4096                # features with a weight
TRAIN_ROWS = 50_000        # bound on the labelled doc_ids that the classifier learns from
TOXIC_WEIGHT = 3.0         # of a toxic row, which are the fewer
BEGINNINGS = (4, 6, 7, 8)   # in bytes of UTF-8
BYTES_KEPT = 128 << 20     # of the words and results that a worker keeps, about

# Letters that a sign may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
        "@": "a", "$": "s", "!": "il", "|": "il", "€": "e", "£": "l", "*": "aeiou", "#": "aeiou"}
SEPARATORS = " .-_,/~'"    # fixed value: signs that may stand between the letters of a word
# Channel costs in nats.
AS_LETTER, AS_ANY_LETTER, AS_SIGN, DROPPED, AS_BORDER, FOLDED = 1.0, 3.0, 6.0, 0.5, 4.0, 0.5

_SIGN = "[" + re.escape("".join(LEET)) + "]"
_L = r"[^\W\d_]"
_ONE = rf"(?:{_L}|{_SIGN})"
# Single letters (or signs) with a space between them, three or more; the
# first pattern only tells quickly whether a text can hold any.
MAYBE_SPACED = re.compile(r" \S \S ")
SPACED = re.compile(rf"(?<!\S){_ONE}(?: {_ONE}(?!\S)){{2,}}")
# Inside a run without spaces: single letters with another separator between
# them; words with signs beside letters (a sign that only ends a word stays);
# words with a letter three times in a row.
TRIPLE = re.compile(r"(\w)\1\1")
MAYBE_SPAN = re.compile(rf"{_SIGN}|({_L})\1\1|{_L}[{re.escape(SEPARATORS)}]{_ONE}[{re.escape(SEPARATORS)}]")
_REST = rf"(?:{_L}|{_SIGN}{{1,2}}(?={_L}|\s|$))*"
SPANS = re.compile(                          # words are entered at their first letter only: linear in the run
    rf"(?<!\w){_ONE}(?:[{re.escape(SEPARATORS)}]{_ONE}(?!\w)){{2,}}"
    rf"|(?:(?<!{_L}){_L}++|(?<!\S)){_SIGN}{{1,2}}(?={_L}){_REST}"
    rf"|(?<!{_L}){_L}*?({_L})\1\1{_L}*")


def _codes() -> np.ndarray:
    """Symbol of each code point: 1 to 26 with marks stripped, OTHER, or 0."""
    n = 0x110000
    code = np.zeros(n, np.uint8)
    code[np.fromiter((chr(i).isalpha() for i in range(n)), bool, n)] = OTHER
    for i in range(0x250):                   # Latin letters with marks
        c = unicodedata.normalize("NFD", chr(i).lower())[0]
        if "a" <= c <= "z":
            code[i] = ord(c) - 96
    return code


_CODE: list[np.ndarray] = []


def _code() -> np.ndarray:
    if not _CODE:
        _CODE.append(_codes())
    return _CODE[0]


def _gram_counts(batches):
    """4-gram counts of the texts of a task; before a word's first letter
    stand three borders."""
    code, sums = _code(), np.zeros(SYMBOLS ** 4, np.int64)
    for b in batches:
        joined = " ".join(t for t in b.column(0).to_pylist() if t)
        c = code[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
        c = np.concatenate((np.zeros(1, np.uint8), c, np.zeros(1, np.uint8)))
        keep = c > 0
        keep[1:] |= c[:-1] > 0                                  # one border after a word
        c = np.concatenate((np.zeros(3, np.int32), c[keep].astype(np.int32)))
        if len(c) > 4:
            # borders hide what stands before them
            one, two, three = c[2:-1], c[1:-2], c[:-3]
            two = np.where(one == 0, 0, two)
            three = np.where(two == 0, 0, three)
            sums += np.bincount(((three * SYMBOLS + two) * SYMBOLS + one) * SYMBOLS + c[3:], minlength=SYMBOLS ** 4)
    at = np.flatnonzero(sums)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[at])], names=["gram", "n"])


def language_model(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Surprise in nats of a symbol after three others, from all texts; at
    most ``SYMBOLS ** 4`` numbers."""
    ready(docs.sparkSession)
    rows = (docs.select(text_col).mapInArrow(_gram_counts, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n"))
            .collect())
    n = np.zeros(SYMBOLS ** 4)
    n[[r["gram"] for r in rows]] = [r["n"] for r in rows]
    n = n.reshape((SYMBOLS,) * 4)
    p = np.full(SYMBOLS, 1 / SYMBOLS)
    for k in (0, 1, 2, 3):                   # from no context to three symbols
        c = n.sum(axis=tuple(range(3 - k)))
        p = (c + SMOOTH * p) / (c.sum(-1, keepdims=True) + SMOOTH)
    return -np.log(p).astype(np.float32)


def _slots(span: str):
    """The lattice of a span: per place the readings (text, cost)."""
    slots, i = [], 0
    while i < len(span):
        c = span[i]
        j = i + 1
        while j < len(span) and span[j] == c:
            j += 1
        run = j - i
        if c in LEET:
            wild = c in "*#"
            read = [(x, AS_ANY_LETTER if wild else AS_LETTER) for x in LEET[c]]
            for _ in range(run):
                slots.append([*read, (c, AS_SIGN)])
        elif c.isalpha():
            slots.append([(c, 0.0)])
            if run == 2:
                slots.append([(c, 0.0)])
            elif run > 2:
                slots.append([("", FOLDED), (c, FOLDED)])
        else:
            slots.extend([[("", DROPPED), (" ", AS_BORDER)]] * run)
        i = j
    return slots


class Kept(dict):
    """Results by word, found when first asked for; starts anew when words and
    results (``weight(result)`` bytes) reach ``BYTES_KEPT``, so its size does
    not follow the data."""

    def __init__(self, find, weight):
        super().__init__()
        self.find, self.weight, self.size = find, weight, 0

    def __missing__(self, word):
        out = self.find(word)
        self.size += 200 + len(word) + self.weight(out)
        if self.size > BYTES_KEPT:
            self.clear()
            self.size = 0
        self[word] = out
        return out


class Restorer:
    """Most likely readings under the language model."""

    def __init__(self, surprise: np.ndarray):
        self.surprise = surprise
        self.code = _code()
        self.runs = Kept(self._run, len)

    def decode(self, span: str) -> str:
        """The cheapest path through the lattice of ``span``."""
        paths = {(0, 0, 0): (0.0, None)}     # context: cost, (text, path before)
        table, code = self.surprise, self.code
        for slot in [*_slots(span), [(" ", 0.0)]]:
            new: dict = {}
            for ctx, (cost, back) in paths.items():
                for text, extra in slot:
                    if text:
                        s = int(code[ord(text)])
                        total = cost + extra + (float(table[ctx[0], ctx[1], ctx[2], s]) if s or ctx[2] else 0.0)
                        to = (ctx[1], ctx[2], s) if s else (0, 0, 0)
                    else:
                        total, to = cost + extra, ctx
                    if to not in new or total < new[to][0]:
                        new[to] = (total, (text, back))
            paths = new
        _, back = min(paths.values(), key=lambda x: x[0])
        out = []
        while back is not None:
            out.append(back[0])
            back = back[1]
        return "".join(reversed(out))[:-1]   # without the closing border

    def _run(self, run: str) -> str:
        # most are a word and perhaps a stop, which stays whatever it is
        if (TRIPLE if run.rstrip(".,;:?!").isalpha() else MAYBE_SPAN).search(run):
            return SPANS.sub(lambda m: self.decode(m[0]), run)
        return run

    def spaced(self, text: str | None) -> str:
        """``text`` in lower case with spaced-out words read."""
        text = (text or "").lower()
        if MAYBE_SPACED.search(f" {text} "):
            text = SPACED.sub(lambda m: self.decode(m[0]), text)
        return text

    def restore(self, text: str | None) -> str:
        """``text`` in lower case with its spans read."""
        return " ".join(map(self.runs.__getitem__, self.spaced(text).split(" ")))


_WORD = re.compile(rf"{_L}+")
_crc, _MASK = zlib.crc32, BUCKETS - 1


def _features(word: str) -> list[int]:
    """Buckets of a word and of its beginnings."""
    raw = word.encode()
    out = [_crc(raw) & _MASK]
    n = len(raw)
    out.extend([_crc(raw[:k], 1) & _MASK for k in BEGINNINGS if n >= k])
    return out


class Features:
    """How often a restored text has each feature (of ``only`` these)."""

    def __init__(self, surprise: np.ndarray, only=None):
        self.restorer = Restorer(surprise)
        self.only = only
        # the words of a run of the text, as features of its restored form
        self.runs = Kept(self._run, lambda f: 36 * len(f))

    def _run(self, run: str):
        shown = self.restorer._run(run)
        word = shown.rstrip(".,;:?!")
        words = (word,) if word.isalpha() else _WORD.findall(shown)
        f = [x for w in words for x in _features(w)]
        if self.only is not None:
            f = [x for x in f if x in self.only]
        return f or ()

    def count(self, text: str | None) -> list[tuple[int, int]]:
        n: Counter = Counter()
        for run, k in Counter(self.restorer.spaced(text).split()).items():
            for f in self.runs[run]:
                n[f] += k
        return sorted(n.items())

    def found(self, text: str | None) -> set[int]:
        return set().union(*map(self.runs.__getitem__, set(self.restorer.spaced(text).split())))


def _held(batches, model=None):
    """Documents by label that have a feature, as counts of a task."""
    features = Features(model.value)
    sums = np.zeros((2, BUCKETS), np.int64)
    for b in batches:
        for t, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            sums[toxic, list(features.found(t))] += 1
    at = np.flatnonzero(sums.any(0))
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(sums[0, at]), pa.array(sums[1, at])],
                                     names=["feature", "clean", "toxic"])


def _vectors(batches, model=None, weighted=None):
    features = Features(model.value, weighted)
    for b in batches:
        rows = [[(weighted[f], k) for f, k in features.count(t)] for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([[i for i, _ in r] for r in rows], pa.list_(pa.int32())),
             pa.array([[math.log1p(k) for _, k in r] for r in rows], pa.list_(pa.float64())), b.column(1)],
            names=["i", "x", "toxic"])


def fit(train: DataFrame, surprise: np.ndarray, kept: int = KEPT) -> tuple[dict[int, float], float]:
    """Weights by feature and the constant, from all rows of ``train`` (text,
    toxic 0 or 1), which are read three times."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.linalg import SparseVector, VectorUDT
    spark = ready(train.sparkSession)
    rows = train.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    n = dict(rows.groupBy("toxic").count().collect())
    share = n.get(1, 0) / max(1, sum(n.values()))
    if share in (0, 1):
        return {}, (40.0 if share else -40.0)
    model = spark.sparkContext.broadcast(surprise)
    sums = (rows.mapInArrow(partial(_held, model=model), "feature int, clean long, toxic long").groupBy("feature")
            .agg(F.sum("clean").cast("double").alias("c"), F.sum("toxic").cast("double").alias("t")))
    n0, n1 = float(n[0]), float(n[1])
    chi = f"(t * {n0!r} - c * {n1!r}) * (t * {n0!r} - c * {n1!r}) / ((t + c) * ({n0 + n1!r} - t - c))"
    best = sums.where(f"t + c < {n0 + n1!r}").selectExpr("feature", f"{chi} as chi").orderBy(F.desc("chi"), "feature").limit(kept)
    # at most ``kept`` numbers
    weighted = {f: i for i, f in enumerate(sorted(r["feature"] for r in best.collect()))}
    size = max(1, len(weighted))
    vector = F.udf(lambda i, x: SparseVector(size, i, x), VectorUDT())
    table = written(rows.mapInArrow(partial(_vectors, model=model, weighted=weighted),
                                    "i array<int>, x array<double>, toxic int"), "toxic")
    weight = F.when(F.col("toxic") == 1, TOXIC_WEIGHT).otherwise(1.0)
    lr = LogisticRegression(labelCol="toxic", weightCol="weight", maxIter=60, regParam=1e-3, standardization=False)
    got = lr.fit(table.select(vector("i", "x").alias("features"), "toxic", weight.alias("weight")))
    w = got.coefficients.toArray()
    return {f: float(w[i]) for f, i in weighted.items()}, float(got.intercept)


def _make_score(model, weights, constant):
    features = Features(model.value, weights)

    def run(texts):
        out = []
        for t in texts.to_pylist():
            z = constant + sum(weights[f] * math.log1p(k) for f, k in features.count(t))
            out.append(round(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), 9))
        return [out]
    return run


def _make_restore(model):
    restorer = Restorer(model.value)
    return lambda texts: [[None if t is None else restorer.restore(t) for t in texts.to_pylist()]]


def _new(docs: DataFrame, out: str) -> None:
    if out in docs.columns:
        raise ValueError(f"the input has a column {out!r}; name another one")


def restored(docs: DataFrame, surprise: np.ndarray, text_col: str = "text", out: str = "restored") -> DataFrame:
    """``docs`` with each text in lower case, obfuscated words read."""
    _new(docs, out)
    model = ready(docs.sparkSession).sparkContext.broadcast(surprise)
    return append_columns(docs, [text_col], partial(_make_restore, model), [field(out, "string")])


def score(docs: DataFrame, surprise: np.ndarray, weights: dict[int, float], constant: float, text_col: str = "text",
          out: str = "score") -> DataFrame:
    """``docs`` with the probability that a text is toxic."""
    _new(docs, out)
    model = ready(docs.sparkSession).sparkContext.broadcast(surprise)
    return append_columns(docs, [text_col], partial(_make_score, model, weights, constant), [field(out, "double")])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learnt from the labelled rows that
    are not held out, scored for all."""
    rows = docs.select("doc_id", "text", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
                       .alias("held_out"))
    surprise = language_model(rows)
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)")
    learnt = marks.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    learnt = written(learnt.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS), "labelled")
    train = rows.join(F.broadcast(learnt), "doc_id").select("text", "toxic")
    weights, constant = fit(train, surprise)
    return (score(rows, surprise, weights, constant)
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
