"""Operator 9: removal of repeated 50-byte strings by merging shard BWTs.

Texts are UTF-8 bytes.  Every byte goes that is covered by a 50-byte string
which also starts in a document with a smaller doc_id.

A text that an earlier document has whole (equal length and 128 bits of
hash) goes whole; the phases below work on the rest.

Suffixes are brought together where they can be equal, and nowhere else.  In
each 50-byte window the 16-byte string of the least hash is its anchor; equal
windows have equal anchors at equal places.  Consecutive windows of one anchor
form a stretch.  Phase 1 keeps the stretches whose anchor occurs in two
documents or more; phase 2 deals their bytes out by anchor.  Equal stretches
are settled at once: all but the first document's go.  The distinct ones that
share an anchor are cut into shards; each shard gets its suffix order and
Burrows-Wheeler transform, and the shards' transforms are merged by
refinement of their interleave: from the order by the first d bytes, a stable
deal by the transform's (preceding) bytes gives the order by d + 8, without
sorting the suffixes of all shards again.  Where neighbours part is known at
every depth, so at 50 the intervals of equal windows and the smallest doc_id
of each are there.  Phase 3 joins the removed spans with the texts.

Nothing is collected.  A task holds one block of stretches; an anchor with
more than ``MAX_GROUP`` distinct stretches is settled window by window in a
grouped minimum instead, which Spark combines before the shuffle.

Defined results: null text: empty; texts under 50 bytes keep all; rows that
share a doc_id do not remove from one another; a row without a doc_id keeps
all its bytes and removes none; repeated rows each give the same row; an
empty table gives no row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from articleflow.llm.common import NARROW_ROWS, append_columns, field, ready, small_side, written

LENGTH, ANCHOR = 50, 16
CHUNK = 1 << 22          # bytes scanned at once
BLOCK = 1 << 21          # bytes of distinct stretches whose shards are merged
SHARD = 1 << 18          # bytes of a shard
MAX_GROUP = 1 << 15      # distinct stretches of one anchor that a task holds
SLOTS = 22               # 2 ** SLOTS slots for the hashes of a block's short strings
_POS = 24                # bits of a place within a chunk
_MOST = np.iinfo(np.int32).max


def _eights(raw: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as big-endian numbers."""
    x = raw.astype(np.uint64)
    for step in (1, 2, 4):
        x = (x[:-step] << np.uint64(8 * step)) | x[step:]
    return x


def _slide(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive numbers."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[:-step], x[step:])
        have += step
    return x


def stretches(raw: np.ndarray, ends: np.ndarray):
    """Of texts laid end to end: (anchor hash, first window, windows) of every
    stretch, as arrays; windows never cross a text's end."""
    n = len(raw)
    if n < LENGTH:
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64))
    e = _eights(raw)
    a, b = e[:n - ANCHOR + 1], e[ANCHOR - 8:]
    h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    place = np.arange(len(h), dtype=np.uint64)
    key = (h >> np.uint64(_POS) << np.uint64(_POS)) | place
    least = _slide(key, LENGTH - ANCHOR + 1)
    starts = np.concatenate(([0], ends[:-1]))
    text = np.repeat(np.arange(len(ends)), ends - starts)[:len(least)]
    valid = np.flatnonzero(np.arange(len(least)) + LENGTH <= ends[text])
    anchor = (least[valid] & np.uint64((1 << _POS) - 1)).astype(np.int64)
    if not len(valid):
        return tuple(np.empty(0, t) for t in (np.int64, np.int64, np.int64))
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (text[valid][1:] != text[valid][:-1]))))
    count = np.diff(np.concatenate((first, [len(valid)])))
    return h[anchor[first]].view(np.int64), valid[first], count


def _laid_out(texts: list[bytes]):
    """(raw bytes, ends, first text's number, offset within that text) of
    parts of up to CHUNK bytes; a longer text comes in parts that overlap by
    all but one byte of a window, so each window is in one part."""
    held, size, at = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > CHUNK:
            yield b"".join(held), np.cumsum([len(x) for x in held]), at, 0
            held, size = [], 0
        if len(t) > CHUNK:
            for off in range(0, len(t) - LENGTH + 1, CHUNK - LENGTH + 1):
                part = t[off:off + CHUNK]
                yield part, np.array([len(part)]), i, off
            continue
        if not held:
            at = i
        held.append(t)
        size += len(t)
        if i + 1 < len(texts) and len(texts[i + 1]) > CHUNK:
            yield b"".join(held), np.cumsum([len(x) for x in held]), at, 0
            held, size = [], 0
    if held:
        yield b"".join(held), np.cumsum([len(x) for x in held]), at, 0


def _scan(texts: list[bytes]):
    """(hash, text number, offset in text, windows) of all stretches."""
    for raw, ends, at, off in _laid_out(texts):
        h, s, r = stretches(np.frombuffer(raw, np.uint8), ends)
        starts = np.concatenate(([0], ends[:-1]))
        i = np.searchsorted(ends, s, side="right")
        yield h, i + at, s - starts[i] + off, r


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _spread(*numbers: np.ndarray) -> np.ndarray:
    """A key of each row alone, for rows that need no company."""
    x = np.zeros(len(numbers[0]), np.uint64)
    for y in numbers:
        x = (x ^ y.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(32)
    return x.view(np.int64)


# What a row of an anchor is: to be compared; known to be in two documents;
# only telling others that the anchor is in its document.
ASK, KNOWN, TELL = 0, 1, 2


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, text) -> (h, doc_id, print, s, kind).  An anchor that
    two documents of a batch share is known at once: its rows are spread, and
    two rows tell the other batches, so a common passage does not fill a task."""
    for b in batches:
        doc, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
        for h, i, s, _ in _scan(_bytes(b.column(2))):
            if not len(h):
                continue
            d, kind = doc[i], np.zeros(len(h), np.int8)
            order = np.lexsort((d, h))
            first = np.flatnonzero(np.concatenate(([True], h[order][1:] != h[order][:-1])))
            size = np.diff(np.append(first, len(h)))
            low, high = order[first], order[first + size - 1]
            two = d[low] != d[high]
            kind[order[np.repeat(two, size)]] = KNOWN
            tell = np.concatenate((low[two], high[two]))
            key = np.where(kind == KNOWN, _spread(d, s, h), h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((x, x[tell] if x is not key else h[tell]))) for x in (key, d, prints[i])]
                + [pa.array(np.concatenate((s, s[tell])), pa.int64()),
                   pa.array(np.concatenate((kind, np.full(len(tell), TELL, np.int8))))],
                names=["h", "doc_id", "print", "s", "kind"])


def _in_two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, doc_id, print, s, kind) sorted by h and doc_id -> (doc_id,
    print, s) of the anchors that two documents have."""
    def out(rows, some):
        some = (some | (rows[4] == KNOWN)) & (rows[4] != TELL)
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in rows[1:4]], names=["doc_id", "print", "s"])

    rest, known = None, None          # rows of the last anchor; it, if it is known to be in two
    for b in batches:
        rows = [c.to_numpy() for c in b.columns]
        if rest is not None:
            rows = [np.concatenate(x) for x in zip(rest, rows)]
        h, doc = rows[0], rows[1]
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        size = np.diff(np.concatenate((first, [len(h)])))
        two = doc[first] != doc[first + size - 1]
        if known is not None and h[0] == known:
            two[0] = True
        some = np.repeat(two, size)
        cut = len(h) if two[-1] else int(first[-1])
        known = h[-1] if two[-1] else None
        rest = None if two[-1] else [c[cut:] for c in rows]
        if cut:
            yield out([c[:cut] for c in rows], some[:cut])
    if rest is not None:
        yield out(rest, np.zeros(len(rest[0]), bool))


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, print, text, places) -> (h, piece, doc_id, print, s, e): bytes
    of the stretches at the places.  A stretch that an earlier document of the
    batch has whole is settled at once: a row without bytes, spread."""
    for b in batches:
        doc, prints = b.column(0).to_numpy(), b.column(1).to_numpy()
        texts, places = _bytes(b.column(2)), b.column(3)
        counts = np.array([len(x) for x in places])
        at = (np.repeat(np.arange(len(texts)), counts) << 40) | places.flatten().to_numpy()   # text, place
        for h, i, s, r in _scan(texts):
            wanted = np.flatnonzero(np.isin((i << 40) | s, at))
            if not len(wanted):
                continue
            wanted = wanted[np.argsort(doc[i[wanted]], kind="stable")]
            h, i, s, r = h[wanted], i[wanted], s[wanted], r[wanted]
            d, e = doc[i], s + r + LENGTH - 1
            first, pieces = {}, []
            for j, a, z, k in zip(i.tolist(), s.tolist(), e.tolist(), d.tolist()):
                piece = texts[j][a:z]
                pieces.append(piece if first.setdefault(piece, k) == k else None)
            here = np.fromiter((x is None for x in pieces), bool, len(pieces))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.where(here, _spread(d, s, h), h)), pa.array(pieces, pa.binary()), pa.array(d),
                 pa.array(prints[i]), pa.array(s, pa.int64()), pa.array(e, pa.int64())], names=_PIECE)


_PIECE = ["h", "piece", "doc_id", "print", "s", "e"]


def _order(numbers: np.ndarray, bits: int) -> np.ndarray:
    """Stable order of small numbers: one plain sort, the place in the low bits."""
    return np.sort((numbers << bits) | np.arange(len(numbers))) & ((1 << bits) - 1)


def _dense(numbers: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Rank of each number, given their order; equal numbers, equal rank."""
    by = numbers[order]
    rank = np.empty(len(numbers), np.int64)
    rank[order] = np.cumsum(np.concatenate(([0], by[1:] != by[:-1])))
    return rank


def _shard(eight: np.ndarray) -> np.ndarray:
    """Suffix order, to a depth of 64, of one shard read as a circle; given
    the rank of the 8 bytes from each place on."""
    n = len(eight)
    bits = n.bit_length()
    order = _order(eight, bits)
    rank, depth = _dense(eight, order), 8
    while depth < LENGTH and int(rank[order[-1]]) < n - 1:
        both = (rank << bits) | np.roll(rank, -depth)
        order = _order(both, bits)
        rank = _dense(both, order)
        depth *= 2
    return order


def _ranks(shards: list[np.ndarray]) -> np.ndarray:
    """Rank of the 8 bytes from each place on, every shard read as a circle."""
    n = sum(map(len, shards))
    bits = n.bit_length()

    def joined(each):
        return np.concatenate([each(x) for x in shards])
    x = joined(lambda x: x).astype(np.int64)
    circle = lambda step: joined_roll(np.arange(n), shards, step)
    two = (x << 8) | x[circle(-1)]
    four = (two << 16) | two[circle(-2)]
    four = _dense(four, _order(four, bits))
    wide = int(four.max()).bit_length()
    if 2 * wide + bits > 63:                 # nearly all of them differ: no room for the place
        _, rank = np.unique(joined(lambda x: _eights(np.concatenate((x, np.resize(x, 7))))), return_inverse=True)
        return rank.astype(np.int64)
    eight = (four << wide) | four[circle(-4)]
    return _dense(eight, _order(eight, bits))


def joined_roll(x: np.ndarray, shards: list[np.ndarray], step: int) -> np.ndarray:
    """``x`` by place, moved on by ``step`` inside each shard."""
    return np.concatenate([np.roll(p, step) for p in np.split(x, np.cumsum([len(y) for y in shards])[:-1])])


def merged(shards: list[np.ndarray], length: int = LENGTH, live=None) -> tuple[np.ndarray, np.ndarray]:
    """(places, opens) over the bytes of all shards laid end to end: the
    places in the order of their first ``length`` bytes, and where that order
    passes on to other bytes.

    ``live(places, opens, depth)`` tells after each round which entries can
    still matter; the others leave the interleave, and with them every suffix
    that starts before them (its interval is part of theirs)."""
    sizes = [len(x) for x in shards]
    offs = np.cumsum([0, *sizes[:-1]])
    eight = _ranks(shards)
    orders = [_shard(x) for x in np.split(eight, np.cumsum(sizes)[:-1])]
    every = np.concatenate([o + off for o, off in zip(orders, offs)]).astype(np.int32)
    suffix = every                                                      # of all shards, each in its order
    n = len(every)
    bits = n.bit_length()
    shard_of = np.repeat(np.arange(len(shards), dtype=np.uint16), sizes)
    which = shard_of                                                    # the interleave
    group = np.zeros(n, np.int32)                                       # equal so far: equal number
    place = np.arange(n, dtype=np.int32)

    def entries():
        """The k-th entry of a shard in the interleave is its k-th suffix."""
        out = np.empty(len(which), np.int32)
        out[np.argsort(which, kind="stable")] = suffix
        return out

    depth, opens = 0, np.zeros(0, bool)
    before = joined_roll(place, shards, 8)
    while depth < length and len(which):
        short = length % 8 if not depth else 0
        if short:
            # the first round deals by fewer bytes, as one number
            here, deal = joined_roll(place, shards, short), np.zeros(n, np.int64)
            for k in range(short):
                deal = (deal << 8) | joined_roll(np.concatenate(shards), shards, -k)
        else:
            here, deal = before, eight
        at = here[entries()]                                            # what stands before each suffix
        dealt = np.sort((deal[at] << bits) | np.arange(len(at)))        # stable: the place in the low bits
        order = dealt & ((1 << bits) - 1)
        dealt >>= bits
        at, group, depth = at[order], group[order], depth + (short or 8)
        opens = np.concatenate(([True], (dealt[1:] != dealt[:-1]) | (group[1:] != group[:-1])))
        group = np.cumsum(opens, dtype=np.int32)
        if live is not None and (depth > 8 or depth >= length):
            kept = np.flatnonzero(live(at, opens, depth))
            at, group = at[kept], group[kept]
            opens = np.concatenate(([True], group[1:] != group[:-1]))[:len(kept)]
            some = np.zeros(n, bool)
            some[at] = True
            suffix = every[some[every]]
        which = shard_of[at]
    return entries(), opens


def _in_documents(raw: np.ndarray, ends: np.ndarray, docs: np.ndarray):
    """(from, to) of the parts of pieces laid end to end, in order of their
    documents, that can hold a window of two documents: each ``ANCHOR`` bytes
    of such a window stand in two.  Strings of one hash count as equal, so
    some parts too many may be kept, none is lost."""
    n, start = len(raw), ends - np.diff(np.append(0, ends))
    e = _eights(raw)
    h = e[:n - ANCHOR + 1] * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h += e[ANCHOR - 8:]
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    slot = (h >> np.uint64(64 - SLOTS)).astype(np.int32)
    doc = np.repeat(docs, ends - start)[:len(slot)]
    first, last = np.zeros(1 << SLOTS, np.int32), np.zeros(1 << SLOTS, np.int32)
    last[slot] = doc                          # the last of equal slots stays
    first[slot[::-1]] = doc[::-1]
    one = np.ones(n, np.int32)
    one[:len(slot)] = first[slot] == last[slot]
    # strings of a window that only one document has
    many = LENGTH - ANCHOR + 1
    have = np.concatenate(([0], np.cumsum(one, dtype=np.int32)))
    window = np.zeros(n + 1, np.int8)
    window[:n - many + 1] = have[many:] == have[:-many]
    left = np.repeat(ends, ends - start) - np.arange(n)
    window[:n][left < LENGTH] = 0
    edge = np.diff(window, prepend=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + LENGTH - 1
    # runs of windows less than a window apart share bytes
    apart = np.flatnonzero(begin[1:] >= end[:-1])
    return begin[np.append(0, apart + 1)[:len(begin)]], end[np.append(apart, len(end) - 1)[:len(end)]]


def settle(raw: np.ndarray, ends: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(piece, from, to) as arrays: bytes of each of the pieces laid end to
    end, in order of their documents, that are covered by windows also in a
    piece of a smaller document."""
    number = np.unique(docs, return_inverse=True)[1].astype(np.int32)
    begin, end = _in_documents(raw, ends, number)
    piece = np.searchsorted(ends, begin, side="right")
    size = end - begin
    if not len(size):
        return (np.zeros(0, np.int64),) * 3
    stop = np.cumsum(size)
    inner = np.arange(stop[-1]) - np.repeat(stop - size, size)
    raw = raw[np.repeat(begin, size) + inner]
    cuts = stop[np.searchsorted(stop, np.arange(SHARD, len(raw), SHARD))]
    doc_of = np.repeat(number[piece], size)
    room = np.minimum(np.repeat(stop, size) - np.arange(len(raw)), 1 << 20).astype(np.int32)   # to the part's end

    def least(place, opens, inside):
        """Smallest document of each interval, whether it has another, and its size."""
        first, doc = np.flatnonzero(opens), doc_of[place]
        low = np.minimum.reduceat(np.where(inside, doc, _MOST), first)
        high = np.maximum.reduceat(np.where(inside, doc, -1), first)
        return low, low < high, np.diff(np.append(first, len(place)))

    def live(place, opens, depth):
        inside = room[place] >= depth
        _, two, many = least(place, opens, inside)
        return inside & np.repeat(two, many)

    place, opens = merged([x for x in np.split(raw, np.unique(cuts)) if len(x)], live=live)
    gone = np.zeros(len(raw) + 1, bool)
    if len(place):
        low, _, many = least(place, opens, np.True_)
        gone[place[np.repeat(low, many) < doc_of[place]]] = True
    # runs of removed windows, within a part: a window never starts at a part's last bytes
    edge = np.flatnonzero(np.diff(np.concatenate(([False], gone)).astype(np.int8)))
    first, last = edge[::2], edge[1::2] - 1
    of = np.searchsorted(stop, first, side="right")
    back = begin[of] - (stop - size)[of] - (ends - np.diff(np.append(0, ends)))[piece[of]]
    return piece[of], first + back, last + back + LENGTH


_OUT = ["doc_id", "print", "s", "e", "window"]


def _settled(batches: Iterator[pa.RecordBatch], max_group: int) -> Iterator[pa.RecordBatch]:
    """Rows (h, piece, doc_id, print, s, e) sorted by h, piece and doc_id ->
    (doc_id, print, s, e) removed, or with ``window`` set: a window to settle
    elsewhere.  Rows without a piece are settled already."""
    def out(doc, prints, s, e, window=None):
        window = pa.nulls(len(doc), pa.binary()) if window is None else pa.array(window, pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, prints, s, e)] + [window], names=_OUT)

    def windows(t):
        pieces, doc, prints, s = t[1].to_pylist(), *(t[i].to_numpy() for i in (2, 3, 4))
        many = np.array([len(x) - LENGTH + 1 for x in pieces], np.int64)
        at = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        begin = np.repeat(s, many) + at
        return out(np.repeat(doc, many), np.repeat(prints, many), begin, begin + LENGTH,
                   [x[i:i + LENGTH] for x in pieces for i in range(len(x) - LENGTH + 1)])

    def settle_block(block):
        t = [pa.concat_arrays(c) for c in zip(*block)]
        t = [c.take(pc.array_sort_indices(t[2])) for c in t]
        lengths = pc.binary_length(t[1]).to_numpy().astype(np.int64)
        raw = np.frombuffer(b"".join(t[1].to_pylist()), np.uint8)
        doc, prints, s = (t[i].to_numpy() for i in (2, 3, 4))
        of, a, b = settle(raw, np.cumsum(lengths), doc)
        return out(doc[of], prints[of], s[of] + a, s[of] + b)

    def firsts(t):
        """Drop the copies of a piece in later documents; (rows left, spans)."""
        h, doc = t[0].to_numpy(), t[2].to_numpy()
        same = np.concatenate(([False], (h[1:] == h[:-1]) & pc.equal(t[1][1:], t[1][:-1]).to_numpy(zero_copy_only=False)))
        run = np.cumsum(~same) - 1
        copy = doc != doc[np.flatnonzero(~same)][run]
        later, size = np.flatnonzero(copy), pc.binary_length(t[1]).to_numpy()
        spans = out(doc[later], t[3].to_numpy()[later], t[4].to_numpy()[later], t[4].to_numpy()[later] + size[later])
        left = np.flatnonzero(~copy)
        return [c.take(pa.array(left)) for c in t], run[left], spans

    # rest: rows of the anchor that may go on; hot: it is settled elsewhere,
    # and rest is one row, already sent, that tells the copies of its piece
    block, size, rest, hot = [], 0, None, False
    for last, t in _with_last(_grouped(batches)):
        told = t[1].is_null()
        if pc.any(told).as_py():
            done = [c.filter(told).to_numpy() for c in t[2:]]
            yield out(*done)
            t = [c.filter(pc.invert(told)) for c in t]
        if not len(t[0]) and rest is None:
            if last and size:
                yield settle_block(block)
            continue
        if rest is not None:
            t = [pa.concat_arrays([a, b]) for a, b in zip(rest, t)]
        t, run, spans = firsts(t)
        if spans.num_rows:
            yield spans
        h = t[0].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        end = np.append(begin[1:], len(h))
        kinds, rows = run[end - 1] - run[begin] + 1, end - begin
        apart = rows > max_group
        together = (kinds > 1) & ~apart
        apart &= kinds > 1
        goes_on = hot and len(begin) == 1 and not last
        if hot:
            together[0], apart[0] = False, True
        if not last and not goes_on:
            together[-1], apart[-1] = False, rows[-1] > max_group
        elsewhere = np.repeat(apart, rows)
        if hot:
            elsewhere[0] = False
        if elsewhere.any():
            yield windows([c.take(pa.array(np.flatnonzero(elsewhere))) for c in t])
        if together.any():
            pick = [c.take(pa.array(np.flatnonzero(np.repeat(together, rows)))) for c in t]
            block.append(pick)
            size += int(pc.sum(pc.binary_length(pick[1])).as_py())
        hot = bool(apart[-1]) and not last
        keep = np.flatnonzero(run == run[-1])[:1] if hot else np.arange(begin[-1], len(h))
        rest = [c.take(pa.array(keep)) for c in t]
        if size >= BLOCK or (last and size):
            yield settle_block(block)
            block, size = [], 0


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of some batches together."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= NARROW_ROWS:
            yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held))]
            held, rows = [], 0
    if rows:
        yield [pa.concat_arrays(c) for c in zip(*(x.columns for x in held))]


def _with_last(items):
    """(whether it is the last, item) of each."""
    items = iter(items)
    for held in items:
        for x in items:
            yield False, held
            held = x
        yield True, held


def removed_spans(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """(doc_id, print, s, e): byte spans to remove, which may overlap; print
    is the text's hash, which tells rows of one doc_id apart."""
    ready(docs.sparkSession)
    every = _printed(docs).where("doc_id is not null")
    prints = written(every.select("doc_id", "print", F.xxhash64(F.lit(1), "text").alias("print2"),
                                  F.octet_length("text").alias("n")).where(F.col("n") >= LENGTH), "prints")
    firsts = prints.groupBy("print", "print2", "n").agg(F.min("doc_id").alias("first"))
    copies = written(prints.join(firsts, ["print", "print2", "n"]).where("doc_id > first")
                     .select("doc_id", "print", "n").distinct(), "copies")
    texts = every.join(small_side(copies.select("doc_id", "print"), 32), ["doc_id", "print"], "left_anti")
    anchors = texts.select("doc_id", "print", "text").mapInArrow(_anchors, "h long, doc_id long, print long, s long, kind tinyint")
    shared = (anchors.repartition("h").sortWithinPartitions("h", "doc_id")
              .mapInArrow(_in_two, "doc_id long, print long, s long"))
    shared = written(shared, "shared_anchors", NARROW_ROWS)
    places = shared.groupBy("doc_id", "print").agg(F.collect_set("s").alias("places"))
    pieces = (texts.join(places, ["doc_id", "print"]).select("doc_id", "print", "text", "places")
              .mapInArrow(_contents, "h long, piece binary, doc_id long, print long, s long, e long"))
    settled = written(pieces.repartition("h").sortWithinPartitions("h", "piece", "doc_id")
                      .mapInArrow(partial(_settled, max_group=max_group),
                                  "doc_id long, print long, s long, e long, window binary"), "settled")
    done = settled.where("window is null").drop("window")
    late = settled.where("window is not null")
    first = late.groupBy("window").agg(F.min("doc_id").alias("first"))
    late = late.join(first, "window").where("first < doc_id").select("doc_id", "print", "s", "e")
    return done.unionByName(late).unionByName(
        copies.select("doc_id", "print", F.lit(0).cast("long").alias("s"), F.col("n").cast("long").alias("e")))


def _printed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("print", F.xxhash64("text"))


def _make_cut():
    def run(texts, spans):
        n_removed, n_spans, sha, kept = [], [], [], []
        for raw, sp in zip(_bytes(texts), spans.to_pylist()):
            parts, at, runs, gone = [], 0, 0, 0
            end = -1
            for x in sorted((x["s"], x["e"]) for x in sp or ()):
                if x[0] > end:
                    if end >= 0:
                        at = end
                    parts.append(raw[at:x[0]])
                    runs, end = runs + 1, x[1]
                    gone += x[1] - x[0]
                elif x[1] > end:
                    gone, end = gone + x[1] - end, x[1]
            parts.append(raw[max(end, 0):])
            left = b"".join(parts)
            n_removed.append(gone)
            n_spans.append(runs)
            sha.append(hashlib.sha256(left).hexdigest())
            kept.append(left)
        return [n_removed, n_spans, sha, pa.array(kept, pa.binary())]
    return run


def remove_repeats(docs: DataFrame, max_group: int = MAX_GROUP) -> DataFrame:
    """doc_id, text, n_removed, n_spans, kept_sha256 and ``kept`` (the bytes
    that are left) of each row."""
    spans = removed_spans(docs, max_group).groupBy("doc_id", "print").agg(
        F.collect_set(F.struct("s", "e")).alias("spans"))
    rows = _printed(docs).join(spans, ["doc_id", "print"], "left").select("doc_id", "text", "spans")
    return append_columns(rows, ["text", "spans"], _make_cut, [
        field("n_removed", "long"), field("n_spans", "long"), field("kept_sha256", "string"), field("kept", "binary")])


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return remove_repeats(docs).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_removed",
                                       "n_spans", "kept_sha256")
