"""Operator 12: alignment of two tokenizers by merge-path partitioning.

Both tokenizers cover the same bytes, so a text gives two ascending lists of
token ends.  A worker lays the texts of a chunk one behind the other, which
keeps both lists ascending, and cuts the merge of the lists into pieces of
``PIECE_ENDS`` ends each: where a piece starts in either list is found by a
binary search on its diagonal, so no piece needs another one, and a long text
is cut like many short ones.  A piece emits the ends that both lists share
(overlaps); a shared end whose two halves fall into neighbouring pieces is
stitched at their border.  Between shared ends lie the groups; a token of A
and a token of B in one group are linked.

A chunk row keeps, by document, the distinct linked identifier pairs and how
often each is linked, both in the fewest bytes a number that hold the chunk's
largest, and once for the chunk how many of its documents hold a pair.  Spark
adds these up by pair, and every chunk gets back the counts of its own pairs.
A pair takes one row of a chunk, so the most common pair has no more rows than
there are chunks.  Chunk rows are shuffled and sorted whole, several at a time,
so a chunk is closed by its documents too, empty ones among them.

Defined results: a null or empty text, or one that a tokenizer does not give
back byte by byte (the library drops or rewrites something), has no tokens:
zeros and an empty digest; texts are taken whole; control strings are plain
text; repeated rows are documents each; ties for the highest count all count
as best; other columns are left out, so their names cannot clash (``alignments``
keeps them and refuses an input column named like its output); an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import LARGE_ROWS, append_columns, field, ready, small_side, written

CHUNK_BYTES = 1 << 20      # a chunk is closed by the text that reaches this, so that its row stays well below a MB
DOC_BYTES = 128            # what a document adds to a chunk besides its text
ENCODED_AT_ONCE = 1 << 18  # characters given to the library at a time
PIECE_ENDS = 1 << 16       # ends of both lists in one piece
LINKS_AT_ONCE = 1 << 19    # links laid out in memory at a time
WIDE = 4096                # a group with more links has its repeated ids counted first


class Tokenizers:
    """The two tokenizers, the bytes of their tokens and printable ids."""

    def __init__(self, a_path: str, b_path: str):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"       # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters = _byte_letters()
        vocab = self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join(letters.get(c, c.encode()) for c in token)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i)
                        else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.len_a = np.array([len(x) for x in self.bytes_a])
        self.len_b = np.array([len(x) for x in self.bytes_b])
        # a token as the digest shows it, first of its group or not
        self.shown = [s + str(i) for i in range(len(self.bytes_a)) for s in ",;"]
        self.shown += [s + str(i) for i in range(n) for s in ",|"]
        self.fast = self._faster()

    def _faster(self):
        """The merges of A in a faster library, None unless A is a plain
        byte-level vocabulary whose ids stand in the order of its merges."""
        import json

        import public_tokenizers
        import tiktoken
        kind = json.loads(self.a.to_str())
        pre, special = kind["pre_tokenizer"] or {}, {x["id"] for x in kind["added_tokens"]}
        if kind["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex"):
            return None
        ranks = {raw: i for i, raw in enumerate(self.bytes_a) if i not in special}
        merges = kind["model"]["merges"]
        if len(ranks) != 256 + len(merges) or sorted(ranks.values()) != list(range(len(ranks))):
            return None
        return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        """By the faster library where all characters are of old standing, so
        that both know the same letters; else by the vocabulary's own."""
        plain = [self.fast is not None and not _NEWER.search(t) for t in texts]
        own = iter(self.a.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False))
        return [self.fast.encode_ordinary(t) if p else next(own).ids for t, p in zip(texts, plain)]

    def encode(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and of B by text, empty where they do not give the bytes
        back.  The libraries see few texts at a time: what they make of them
        is many times larger."""
        out, at, size = [(_NONE, _NONE)] * len(texts), [], 0
        for i, t in enumerate(texts):
            if t:
                at.append(i)
                size += len(t)
            if at and (size >= ENCODED_AT_ONCE or i == len(texts) - 1):
                lot = [texts[j] for j in at]
                spaced = [" " + x for x in lot]
                for j, s, a, b in zip(at, spaced, self._ids_a(spaced), self.b.encode(lot, num_threads=1), strict=True):
                    raw = s.encode()
                    if (b"".join(map(self.bytes_a.__getitem__, a)) == raw
                            and b"".join(map(self.bytes_b.__getitem__, b)) == raw):
                        out[j] = np.array(a, np.int32), np.array(b, np.int32)
                at, size = [], 0
        return out


# Letters, marks and ideographs that all versions of Unicode since 6 class alike, and ASCII.
_NEWER = re.compile("[^\x00-\u02ff\u0400-\u04ff\u2010-\u2027\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
_NONE = np.zeros(0, np.int32)


def _byte_letters() -> dict[str, bytes]:
    """The letter of each byte in a byte-level vocabulary: printable Latin-1
    bytes stand for themselves, the others for U+0100 and on, in order."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in keep)
    return {**{chr(b): bytes([b]) for b in keep}, **{chr(256 + i): bytes([b]) for i, b in enumerate(rest)}}


def diagonals(ea: np.ndarray, eb: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    """Where each piece of the merge starts in ``ea`` and ``eb`` (and a last
    entry: their lengths), by binary search on all diagonals at once.  Of two
    equal ends the one of A comes first."""
    d = np.append(np.arange(0, len(ea) + len(eb), piece), len(ea) + len(eb))
    lo, hi = np.maximum(0, d - len(eb)), np.minimum(d, len(ea))
    while (open_ := lo < hi).any():
        mid = (lo + hi) // 2
        a_first = open_.copy()
        a_first[open_] = ea[mid[open_]] <= eb[d[open_] - mid[open_] - 1]
        lo, hi = np.where(a_first, mid + 1, lo), np.where(open_ & ~a_first, mid, hi)
    return lo, d - lo


def shared_ends(ea: np.ndarray, eb: np.ndarray, piece: int = PIECE_ENDS) -> tuple[np.ndarray, np.ndarray]:
    """Indices in ``ea`` and ``eb`` of the ends that both hold, piece by piece."""
    ia, ib = diagonals(ea, eb, piece)
    found_a, found_b = [], []
    for a0, a1, b0, b1 in zip(ia, ia[1:], ib, ib[1:], strict=False):
        if a0 and b0 < b1 and ea[a0 - 1] == eb[b0]:          # a shared end cut by the border
            found_a.append([a0 - 1])
            found_b.append([b0])
        at = np.searchsorted(eb[b0:b1], ea[a0:a1])
        hit = np.flatnonzero(at < b1 - b0)
        hit = hit[eb[b0 + at[hit]] == ea[a0 + hit]]
        found_a.append(a0 + hit)
        found_b.append(b0 + at[hit])
    join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
    return join(found_a), join(found_b)


class Chunk:
    """Some texts, their tokens one behind the other, and the groups."""

    def __init__(self, tok: Tokenizers, texts: list[str | None]):
        both = tok.encode(texts)
        self.tok, self.docs = tok, len(texts)
        self.n_a = np.array([len(a) for a, _ in both], np.int64)
        self.n_b = np.array([len(b) for _, b in both], np.int64)
        self.a = np.concatenate([_NONE, *[a for a, _ in both]])
        self.b = np.concatenate([_NONE, *[b for _, b in both]])
        ea, eb = np.cumsum(tok.len_a[self.a]), np.cumsum(tok.len_b[self.b])
        cut_a, cut_b = shared_ends(ea, eb)
        # group g holds the tokens [a0[g], a0[g + 1]) and [b0[g], b0[g + 1])
        self.a0, self.b0 = np.append(0, cut_a + 1), np.append(0, cut_b + 1)
        self.ends = np.append(0, ea[cut_a])
        self.size_a, self.size_b = np.diff(self.a0), np.diff(self.b0)
        # a text ends where both lists end, so it holds whole groups
        self.g0 = np.searchsorted(self.a0, np.append(0, np.cumsum(self.n_a)))

    def links(self) -> np.ndarray:
        """Links of each document."""
        total = np.append(0, np.cumsum(self.size_a * self.size_b))
        return total[self.g0[1:]] - total[self.g0[:-1]]

    def digests(self) -> list[str]:
        first_a, first_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        first_a[self.a0[:-1]] = 1
        first_b[self.b0[:-1]] = 1
        code = np.empty(len(self.a) + len(self.b), np.int64)
        code[np.arange(len(self.a)) + np.repeat(self.b0[:-1], self.size_a)] = self.a * 2 + first_a
        code[np.arange(len(self.b)) + np.repeat(self.a0[1:], self.size_b)] = 2 * len(self.tok.bytes_a) + self.b * 2 + first_b
        out, at = [], 0
        for n in (self.n_a + self.n_b).tolist():
            shown = "".join(map(self.tok.shown.__getitem__, code[at:at + n].tolist()))[1:]
            out.append(hashlib.sha256(shown.encode()).hexdigest() if n else "")
            at += n
        return out

    def pairs(self):
        """(document, pair, links) of the distinct linked pairs of each
        document, in order; a pair is id_a * vocabulary of B + id_b."""
        many = len(self.tok.bytes_a) * len(self.tok.bytes_b)
        doc = np.repeat(np.arange(self.docs), np.diff(self.g0))
        links = self.size_a * self.size_b
        keys, times = [], []

        def add(key, w):
            if len(key):
                key, at = np.unique(key, return_inverse=True)
                keys.append(key)
                times.append(np.bincount(at, w).astype(np.int64))

        plain = np.flatnonzero(links <= WIDE)
        total = np.cumsum(links[plain])
        for part in np.split(plain, np.searchsorted(total, np.arange(LINKS_AT_ONCE, total[-1] if len(total) else 0,
                                                                    LINKS_AT_ONCE))):
            n, nb = links[part], self.size_b[part]
            k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)          # number of the link in its group
            nb_k = np.repeat(nb, n)
            add(np.repeat(doc[part], n) * many
                + self.a[np.repeat(self.a0[part], n) + k // nb_k] * len(self.tok.bytes_b)
                + self.b[np.repeat(self.b0[part], n) + k % nb_k], np.ones(len(k)))
        for g in np.flatnonzero(links > WIDE).tolist():
            a, ca = np.unique(self.a[self.a0[g]:self.a0[g + 1]], return_counts=True)
            b, cb = np.unique(self.b[self.b0[g]:self.b0[g + 1]], return_counts=True)
            step = max(1, LINKS_AT_ONCE // len(b))
            for i in range(0, len(a), step):
                add((doc[g] * many + a[i:i + step, None] * len(self.tok.bytes_b) + b).ravel(),
                    (ca[i:i + step, None] * cb).ravel().astype(float))
        if not keys:
            return (np.zeros(0, np.int64),) * 3
        key, at = np.unique(np.concatenate(keys), return_inverse=True)
        w = np.zeros(len(key), np.int64)
        np.add.at(w, at, np.concatenate(times))
        return key // many, key % many, w


_TOKENIZERS: dict[tuple, Tokenizers] = {}          # of this worker process


def _tokenizers(a_path: str | None, b_path: str | None) -> Tokenizers:
    if a_path is None or b_path is None:
        import public_tokenizers
        a_path = a_path or public_tokenizers.path("byte_bpe_50k.json")
        b_path = b_path or public_tokenizers.path("piece_bpe_32k.model")
    if (a_path, b_path) not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[a_path, b_path] = Tokenizers(a_path, b_path)
    return _TOKENIZERS[a_path, b_path]


def _make_groups(a_path, b_path):
    tok = _tokenizers(a_path, b_path)

    def run(texts):
        out = []
        for t in texts.to_pylist():
            c = Chunk(tok, [t])
            out.append([{"start": int(c.ends[g]), "stop": int(c.ends[g + 1]), "a": c.a[c.a0[g]:c.a0[g + 1]].tolist(),
                         "b": c.b[c.b0[g]:c.b0[g + 1]].tolist()} for g in range(len(c.size_a))])
        return [out]
    return run


def alignments(docs: DataFrame, text_col: str = "text", out: str = "groups", a_path: str | None = None,
               b_path: str | None = None) -> DataFrame:
    """``docs`` with the groups of each text: byte range in space + text, and
    the ids of A and B inside."""
    ready(docs.sparkSession)
    if out in docs.columns:
        raise ValueError(f"the input has a column {out!r}; name another one")
    return append_columns(docs, [text_col], partial(_make_groups, a_path, b_path),
                          [field(out, "array<struct<start:long,stop:long,a:array<int>,b:array<int>>>")])


def _packed(x: np.ndarray) -> bytes:
    """Numbers from 0 on in the fewest bytes each."""
    return x.astype(np.min_scalar_type(x.max(initial=0)).newbyteorder("<")).tobytes()


def _unpacked(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{len(raw) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


_CHUNK = {"chunk": "long", "pair": "array<long>", "held": "array<int>", "doc_id": "array<long>", "n_a": "array<long>",
          "n_b": "array<long>", "n_groups": "array<long>", "n_links": "array<long>", "groups_sha256": "array<string>",
          "kinds": "array<int>", "at": "binary", "times": "binary"}
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _chunks(a_path, b_path, batches):
    from pyspark import TaskContext
    tok, task, n = _tokenizers(a_path, b_path), TaskContext.get().partitionId(), 0

    def close(ids, texts):
        c = Chunk(tok, texts)
        doc, pair, times = c.pairs()
        pairs, at, held = np.unique(pair, return_inverse=True, return_counts=True)
        row = [(task << 32) + n, pairs, held, ids, c.n_a, c.n_b, np.diff(c.g0), c.links(), c.digests(),
               np.bincount(doc, minlength=c.docs), _packed(at), _packed(times)]
        types = [pa.list_(_ARROW[t[6:-1]]) if t.startswith("array") else _ARROW[t] for t in _CHUNK.values()]
        return pa.RecordBatch.from_arrays([pa.array([x], type=t) for x, t in zip(row, types, strict=True)], names=list(_CHUNK))

    ids, texts, size = [], [], 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            size += len(t or "") + DOC_BYTES
            if size >= CHUNK_BYTES:
                yield close(ids, texts)
                ids, texts, size, n = [], [], 0, n + 1
    if ids:
        yield close(ids, texts)


def chunks(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """``docs`` (doc_id, text) as a written table of chunks (``_CHUNK``)."""
    ready(docs.sparkSession)
    return written(docs.select("doc_id", "text").mapInArrow(partial(_chunks, a_path, b_path),
                                                               ", ".join(f"{c} {t}" for c, t in _CHUNK.items())), "chunks",
                   options=LARGE_ROWS)


def pair_counts(parts: DataFrame) -> DataFrame:
    """pair and n_docs: the documents of ``chunks`` that hold the pair linked."""
    return (parts.select(F.inline(F.arrays_zip("pair", "held")))
            .groupBy("pair").agg(F.sum("held").alias("n_docs")))


def _reports(batches):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    for batch in batches:
        for row in range(batch.num_rows):
            get = {c: batch.column(i)[row] for i, c in enumerate(batch.schema.names)}
            to = np.append(0, np.cumsum(get["kinds"].values.to_numpy()))
            at, times = (_unpacked(get[c].as_py(), to[-1]) for c in ("at", "times"))
            n_docs, best = (get[c].values.to_numpy(zero_copy_only=False) if get[c].is_valid else np.zeros(0, np.int64)
                            for c in ("n_docs", "best"))
            sums = [np.append(0, np.cumsum(x[at] * times))[to] for x in (best, n_docs)]
            cols = [get[c].values for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.array(np.diff(s)) for s in sums], get["groups_sha256"].values],
                                             names=names)


def alignment_report(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    parts = chunks(docs, a_path, b_path)
    tok = _tokenizers(a_path, b_path)
    counts = written(pair_counts(parts), "pairs")
    id_a = F.expr(f"pair div {len(tok.bytes_b)}")
    # at most a row for each id of the vocabulary of A
    highest = written(counts.groupBy(id_a.alias("id_a")).agg(F.max("n_docs").alias("highest")), "highest")
    own = (parts.select("chunk", F.posexplode("pair").alias("i", "pair"))
           .join(small_side(counts, 16), "pair").withColumn("id_a", id_a).join(small_side(highest, 16), "id_a")
           .groupBy("chunk")
           .agg(F.sort_array(F.collect_list(F.struct("i", "n_docs", (F.col("n_docs") == F.col("highest")).cast("long")
                                                     .alias("best")))).alias("own"))
           .select("chunk", F.col("own.n_docs").alias("n_docs"), F.col("own.best").alias("best")))
    whole = parts.drop("pair", "held").join(own, "chunk", "left")
    # a row is a chunk, so a batch holds one
    return written(whole.mapInArrow(_reports, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
                                              "count_sum long, groups_sha256 string"), "aligned", arrow_rows=1)
