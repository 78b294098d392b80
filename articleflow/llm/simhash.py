"""Operator 5: near duplicates by SimHash fingerprints and pigeonhole blocks.

A 64-bit fingerprint is cut into ``blocks`` blocks.  Two fingerprints that
differ in at most ``max_bits`` bits agree on at least ``blocks - max_bits`` of
them, so the fingerprints are dealt out by every choice of that many blocks
and verified only where all of these are equal.  Exact copies are one
fingerprint from the start, so a group of copies costs one row.

A block value shared by at most ``max_bucket`` distinct fingerprints is
verified within one task, which returns the links of a spanning forest, never
all pairs.  Fingerprints in a fuller one (very many near copies) meet at
their midpoints instead: two differ in at most 4 bits exactly if some value
is within 2 bits of both.  At most 2081 distinct fingerprints lie within 2
bits of a value, so these groups are bounded, and the work stays in
proportion to the number of fingerprints.  Both ways are exact.

Defined results: null or empty text and texts without a word have fingerprint
zero and are linked like any other; fewer words than a shingle: the whole
sequence is one shingle; repeated rows each give a row; rows with a null
doc_id are grouped by text, and ``component_id`` is null if no row of the
component has an id.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import append_columns, field, ready, small_side, written
from articleflow.llm.components import components

ROWS_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text (bit set: in over half the hashes)."""
    from xxhash import xxh64_intdigest
    if not text:
        return 0
    words = text.encode().lower().split()     # bytes: A-Z and ASCII space only
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = [xxh64_intdigest(b" ".join(words), 42)]
    else:
        joined, at = b" ".join(words), 0
        starts = [at := at + len(w) + 1 for w in words]
        starts.insert(0, 0)
        hashes = [xxh64_intdigest(joined[s:e - 1], 42) for s, e in zip(starts, starts[shingle:])]
    ones = np.zeros(64, np.int64)
    h = np.array(hashes, np.uint64)
    for i in range(0, len(h), ROWS_AT_ONCE):  # bounded memory for long texts
        part = h[i:i + ROWS_AT_ONCE].byteswap().view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(ones * 2 > len(h))
    return int(bits.view(">u8")[0].astype(np.uint64).view(np.int64))


def _make_fingerprint(shingle: int):
    return lambda texts: [[fingerprint(t, shingle) for t in texts.to_pylist()]]


def with_fingerprint(docs: DataFrame, shingle: int = 4, text_col: str = "text", out: str = "fp") -> DataFrame:
    """``docs`` with ``out`` (long): the fingerprint of each whole text."""
    ready(docs.sparkSession)
    return append_columns(docs, [text_col], partial(_make_fingerprint, shingle), [field(out, "long")])


def block_masks(blocks: int, max_bits: int) -> list[int]:
    """One mask (signed long) for each choice of blocks that must agree."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    one = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:])]
    out = []
    for some in combinations(one, blocks - max_bits):
        m = sum(some)
        out.append(m - (1 << 64) if m >> 63 else m)
    return out


def forest(fps: np.ndarray, max_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that join the same fingerprints as all close pairs do, fewer
    than there are fingerprints."""
    out, rest = [], fps
    while rest.size:
        todo, rest = [rest[0]], rest[1:]
        while todo and rest.size:
            x = todo.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                found, rest = rest[near], rest[~near]
                out.append((np.full(found.size, x), found))
                todo.extend(found)
    return out


def _bucket_links(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Rows (mask number, key, fp) sorted by mask number and key -> links."""
    none = tuple(np.empty(0, t) for t in (np.int32, np.int64, np.int64))

    def link(k, key, fp):
        new = np.flatnonzero((k[1:] != k[:-1]) | (key[1:] != key[:-1])) + 1
        start = np.concatenate(([0], new)).astype(np.int64)
        size = np.diff(np.concatenate((start, [len(fp)])))
        pairs = []
        few = (size > 1) & (size <= 8)
        for step in range(1, int(size[few].max(initial=1))):
            s, n = start[few & (size > step)], size[few & (size > step)]
            i = np.repeat(s, n - step) + (np.arange((n - step).sum()) - np.repeat(np.cumsum(n - step) - (n - step), n - step))
            ok = np.bitwise_count(fp[i] ^ fp[i + step]) <= max_bits
            pairs.append((fp[i[ok]], fp[i[ok] + step]))
        for s, n in zip(start[size > 8], size[size > 8]):
            pairs += forest(fp[s:s + n], max_bits)
        if pairs:
            a, b = (np.concatenate(x).view(np.int64) for x in zip(*pairs))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    kept, held = [none], 0
    for b in batches:
        kept.append(tuple(b.column(i).to_numpy() for i in range(3)))
        held += b.num_rows
        if held >= ROWS_AT_ONCE:
            k, key, fp = (np.concatenate(x) for x in zip(*kept))
            other = np.flatnonzero((k != k[-1]) | (key != key[-1]))
            cut = int(other[-1]) + 1 if other.size else 0   # the last group may go on
            yield from link(k[:cut], key[:cut], fp[:cut].view(np.uint64)) if cut else ()
            kept, held = [(k[cut:], key[cut:], fp[cut:])], len(k) - cut
    k, key, fp = (np.concatenate(x) for x in zip(*kept))
    if len(k):
        yield from link(k, key, fp.view(np.uint64))


def _around(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Each fingerprint with every value within ``radius`` bits of it."""
    flips = np.array([sum(1 << i for i in some) for r in range(radius + 1) for some in combinations(range(64), r)],
                     np.uint64)
    for b in batches:
        for fp in np.array_split(b.column(0).to_numpy(), max(1, b.num_rows // 32)):
            near = (fp.view(np.uint64)[:, None] ^ flips).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near), pa.array(np.repeat(fp, flips.size))], names=["mid", "fp"])


def close_links(fps: DataFrame, max_bits: int = 4, blocks: int = 6, max_bucket: int = 16_384) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that connect exactly
    those that chains of pairs within ``max_bits`` bits connect."""
    masks = block_masks(blocks, max_bits)
    keys = fps.select("fp", F.inline(F.array(*[
        F.struct(F.lit(i).alias("k"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(masks)])))
    heavy = written(keys.groupBy("k", "key").count().where(F.col("count") > max_bucket).select("k", "key"), "heavy")
    some_heavy = not heavy.isEmpty()
    light = keys
    if some_heavy:
        heavy = small_side(heavy, 32)
        light = keys.join(heavy, ["k", "key"], "left_anti")
    links = (light.select("k", "key", "fp").repartition("k", "key").sortWithinPartitions("k", "key")
             .mapInArrow(partial(_bucket_links, max_bits=max_bits), "a long, b long"))
    if some_heavy:
        hot = written(keys.join(heavy, ["k", "key"], "left_semi").select("fp").distinct(), "hot")
        meet = (hot.mapInArrow(partial(_around, radius=(max_bits + 1) // 2), "mid long, fp long")
                .groupBy("mid").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1))
        near = meet.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
        # an odd distance limit also meets one bit beyond it: verify
        links = links.unionByName(near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)
                                  if max_bits % 2 else near)
    return links


def _rooted(docs: DataFrame, shingle: int, max_bits: int, blocks: int, max_bucket: int) -> DataFrame:
    """doc_id, fp, root (a fingerprint that names the component) and
    component_id of each row."""
    ready(docs.sparkSession)
    prints = written(with_fingerprint(docs.select("doc_id", "text"), shingle).select("doc_id", "fp"), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "classes")
    roots = components(close_links(classes.select("fp"), max_bits, blocks, max_bucket))
    rooted = classes.join(roots, classes.fp == roots.node, "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    ids = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return prints.join(rooted.join(ids, "root").select("fp", "root", "component_id"), "fp")


def near_duplicates(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 6,
                    max_bucket: int = 16_384) -> DataFrame:
    """doc_id, fp (long), component_id: smallest doc_id that chains of close
    fingerprints reach."""
    return _rooted(docs, shingle, max_bits, blocks, max_bucket).select("doc_id", "fp", "component_id")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                                        "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4, max_bits: int = 4, blocks: int = 6,
                max_bucket: int = 16_384) -> DataFrame:
    """``docs`` with one row of each component: one whose id is the
    component's.  It is decided by row, not by id: rows that share an id and
    lie in different components do not speak for each other."""
    found = written(_rooted(docs, shingle, max_bits, blocks, max_bucket), "components")
    if found.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        spare = found.where("doc_id <> component_id").select("doc_id")
        return docs.join(written(spare, "spare"), "doc_id", "left_anti")
    # rare: ids are missing or repeated, and a row is known by its id and fingerprint
    stay = (found.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
            .groupBy("root", F.col("doc_id").alias("__id")).agg(F.min("fp").alias("__print")).drop("root"))
    stay = written(stay, "stay")
    shown = with_fingerprint(docs, shingle, out="__fp")
    out = shown.join(stay, shown["doc_id"].eqNullSafe(stay["__id"]) & (shown["__fp"] == stay["__print"]), "left_semi")
    return out.dropDuplicates(["doc_id", "__fp"]).drop("__fp")
