"""Operator 1: SentencePiece encoding and decoding by shared-prefix Viterbi.

Each batch of texts is cut into marked words.  The distinct words, sorted,
are the leaves of a trie in depth-first order: going from one word to the
next keeps the stack of forward scores up to their common prefix and extends
it from there, so a prefix shared by many words is scored once.  The forward
score of a prefix is the best sum of piece scores over its segmentations; a
tie keeps the segmentation whose last piece is longer.  A character without
a piece costs the unknown score and is written as its byte pieces.

The installed public vocabulary carries merge ranks as scores.  This operator
segments by the best score sum, as a unigram model with these pieces and
scores does, and equals the library run on such a model; a byte-pair encoder
may cut a word otherwise (operator 8 counts by merging).

Defined results: null or empty text: no pieces, decoded as the empty string;
texts are taken whole; repeated rows each give a row.  A text that already
holds the mark U+2581 decodes it as a space, as the library does, and its
``round_trip`` is false.
"""

from __future__ import annotations

from array import array
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready
from articleflow.llm.pieces import MARK, Pieces, shared

BYTES_KEPT = 48 << 20  # of the words and encodings that a worker keeps, about; beyond, the table starts anew


def viterbi_sorted(words: list[str], pieces: Pieces, tails: set[str]) -> dict[str, bytes]:
    """Ids (32-bit, as bytes) of each of the sorted distinct ``words``.
    ``tails``: every suffix of a piece; a segment that is no suffix of a piece
    ends the search for longer ones."""
    scores, ids, unk = pieces.scores, pieces.ids, pieces.unk_score
    best, back = [0.0], [0]          # by prefix length: forward score, length of the last piece
    out, before = {}, ""
    for word in words:
        keep, most = 0, min(len(before), len(word))
        while keep < most and before[keep] == word[keep]:
            keep += 1
        del best[keep + 1:], back[keep + 1:]
        for end in range(keep + 1, len(word) + 1):
            top, size = best[end - 1] + unk, 1
            for start in range(end - 1, -1, -1):
                segment = word[start:end]
                if segment not in tails:
                    break
                s = scores.get(segment)
                if s is not None and (s := s + best[start]) >= top:
                    top, size = s, end - start
            best.append(top)
            back.append(size)
        path, end = [], len(word)
        while end:
            start = end - back[end]
            i = ids.get(word[start:end])
            if i is None:
                path.extend(pieces.byte_ids[b] for b in reversed(word[start:end].encode()))
            else:
                path.append(i)
            end = start
        path.reverse()
        out[word] = array("i", path).tobytes()
        before = word
    return out


_KEPT: dict[str, dict] = {}
_SIZE = [0]


def _make_encode(table):
    pieces = table.value
    words = pieces.splitter()
    tails = {p[i:] for p in pieces.ids for i in range(len(p))}
    key = f"{len(pieces.ids)}:{hash(frozenset(pieces.scores.items()))}"
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key], _SIZE[0] = {}, 0

    def run(texts):
        known = _KEPT[key]
        cut = [words(t) for t in texts.to_pylist()]
        missing = sorted({w for ws in cut for w in ws if w not in known})
        if _SIZE[0] > BYTES_KEPT:
            known.clear()
            _SIZE[0] = 0
            missing = sorted({w for ws in cut for w in ws})
        new = viterbi_sorted(missing, pieces, tails)
        _SIZE[0] += sum(150 + 4 * len(w) + len(x) for w, x in new.items())
        known.update(new)
        get = known.__getitem__
        found = [b"".join(map(get, ws)) for ws in cut]
        ends = np.cumsum([0, *map(len, found)]) // 4
        return [pa.ListArray.from_arrays(pa.array(ends, pa.int32()),
                                         pa.array(np.frombuffer(b"".join(found), np.int32)))]
    return run


def _make_decode(table):
    pieces = table.value
    place = [p.encode() for p in pieces.texts]
    for b, i in enumerate(pieces.byte_ids):
        place[i] = bytes([b])
    get, mark = place.__getitem__, MARK.encode()

    def run(ids):
        out = []
        flat = pc.fill_null(ids.flatten(), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
        for x in np.split(flat, ends[:-1]) if len(ends) else ():
            raw = b"".join(map(get, x.tolist())).replace(mark, b" ")
            out.append(raw[1 if raw[:1] == b" " else 0:].decode("utf-8", "replace"))
        return [out]
    return run


def _make_both(table):
    """Encoding, and whether decoding gives the text back, in one worker."""
    to_ids, to_text = _make_encode(table), _make_decode(table)

    def run(texts):
        ids, = to_ids(texts)
        back, = to_text(ids)
        return [ids, [b == (t or "") for b, t in zip(back, texts.to_pylist())]]
    return run


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", model_path: str | None = None) -> DataFrame:
    """``docs`` with ``out`` array<int>: piece ids of each whole text."""
    spark = ready(docs.sparkSession)
    return append_columns(docs, [text_col], partial(_make_encode, shared(spark, model_path)),
                          [field(out, "array<int>")])


def decode(rows: DataFrame, ids_col: str = "ids", out: str = "decoded", model_path: str | None = None) -> DataFrame:
    """``rows`` with ``out`` string: the text that the ids spell."""
    spark = ready(rows.sparkSession)
    return append_columns(rows, [ids_col], partial(_make_decode, shared(spark, model_path)), [field(out, "string")])


def encoded_documents(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """doc_id, n_pieces, ids, round_trip: encoding of each whole text, and
    whether decoding gives the text again."""
    spark = ready(docs.sparkSession)
    rows = append_columns(docs.select("doc_id", "text"), ["text"], partial(_make_both, shared(spark, model_path)),
                          [field("ids", "array<int>"), field("round_trip", "boolean")])
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "round_trip")
