"""Operators 4, 5, 9: decontamination, SimHash, repeated strings."""

import hashlib
import random
from itertools import combinations

import numpy as np
import pytest
import xxhash

from articleflow.llm import decontaminate, simhash, suffix_dedup
from articleflow.llm.components import components


def odd_docs(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    long = " ".join(rng.choice(words) for _ in range(400))
    rows = [(1, long), (2, long), (3, long.replace("w7 ", "W7 ")), (4, ""), (5, None), (6, " \n\t"), (7, "one two"),
            (8, "one  two\n"), (None, "one two"), (None, "alone here with five words"), (9, long + " tail"), (9, long),
            (10, "ÄB c d e f"), (11, "Äb c d e f"), (12, "x" * 100_000), (13, "x" * 60_000)]
    return spark.createDataFrame([(i, t, 1, "k", 2, 3) for i, t in rows],
                                 "doc_id long, text string, fp int, print string, h int, root int"), rows


def brute_simhash(rows, bits=4):
    def fp(t):
        words = [w for w in (t or "").encode().lower().split()]
        if not words:
            return 0
        grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
        h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    fps = [fp(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i, j in combinations(range(len(rows)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits:
            parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, f"{f:016x}", low.get(root(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def test_simhash_against_brute_force(spark, sf_small):
    docs, rows = odd_docs(spark)
    table = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    for df, plain in ((docs, rows), (table, [tuple(r) for r in table.collect()])):
        assert sorted((tuple(r) for r in simhash.fingerprint_report(df).collect()), key=repr) == brute_simhash(plain)
    assert simhash.fingerprint_report(docs.limit(0)).count() == 0


def close_values(n=600, seed=5):
    """Clusters of values around a few centres, so that many are close."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(n // 6):
            x = centre
            for b in rng.sample(range(64), rng.randint(0, 6)):
                x ^= 1 << b
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("max_bucket", [16_384, 20])
def test_links_connect_what_close_pairs_connect(spark, max_bucket):
    """Also where a full block goes by the midpoints."""
    values = close_values()
    signed = [x - (1 << 64) if x >> 63 else x for x in values]
    links = simhash.close_links(spark.createDataFrame([(x,) for x in signed], "fp long"), max_bucket=max_bucket)
    got = {r["node"]: r["root"] for r in components(links).collect()}
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in combinations(signed, 2):
        if ((a ^ b) & (2**64 - 1)).bit_count() <= 4 and root(a) != root(b):
            hi, lo = sorted((root(a), root(b)))[::-1]
            parent[hi] = lo
    assert {x: got.get(x, x) for x in signed} == {x: root(x) for x in signed}
    assert len({root(x) for x in signed}) < len(signed)


def test_every_close_pair_shares_a_block():
    masks = [m & (2**64 - 1) for m in simhash.block_masks(6, 4)]
    rng = random.Random(1)
    for _ in range(2000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)
    x = np.array([rng.getrandbits(64) for _ in range(50)], np.uint64)
    assert sum(len(b) for _, b in simhash.forest(np.concatenate((x, x ^ np.uint64(7))), 4)) == 50


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(500, 500)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 7 for i in range(200, 260)}}


def test_one_of_each_keeps_one(spark):
    docs, rows = odd_docs(spark)
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"], r["text"]) for r in kept.where("doc_id is not null").collect())
    assert [i for i, _ in ids] == [1, 4, 7, 10, 12, 13]
    assert [r["text"] for r in kept.where("doc_id is null").collect()] == ["alone here with five words"]


def test_one_of_each_decides_by_row(spark):
    """Rows of one id in two groups do not remove each other's group."""
    a, b = "one two three four five six seven", "completely other words stand in this second text here"
    rows = [(5, a), (9, a), (5, b), (3, b), (3, b), (3, "a third text that nothing else is like at all")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fp string")
    got = sorted(tuple(r)[:2] for r in simhash.one_of_each(docs).collect())
    assert got == sorted([(5, a), (3, b), (3, rows[5][1])])


def brute_contaminated(docs, items):
    import re
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    first = {}
    for i, t in items:
        w = tuple(cut(t))
        if w:
            first[w] = min(first.get(w, i), i)
    out = {}
    for d, t in docs:
        words = cut(t)
        for w, i in first.items():
            n, size = len(w), min(13, len(w))
            for shift in range(-n, len(words)):
                same = [0 <= shift + k < len(words) and words[shift + k] == w[k] for k in range(n)]
                good = [g for g in range(n - size + 1) if sum(same[g:g + size]) >= (11 if n >= 13 else -(-4 * n // 5))]
                if good:
                    m = sum(same[k] and any(g <= k < g + size for g in good) for k in range(n))
                    out[d, i] = max(out.get((d, i), (0, n)), (m, n))
    return sorted((d, i, *v) for (d, i), v in out.items())


def test_decontamination_against_brute_force(spark):
    rng = random.Random(9)
    vocab = [f"v{i}" for i in range(60)]
    say = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, " ".join(say(rng.choice([4, 5, 8, 12, 13, 14, 20, 40])))) for i in range(25)]
    items += [(100, items[5][1].upper()), (101, ""), (102, None), (103, "a, b. c; d: e!")]
    docs = [(0, ""), (1, None), (2, "A b C d E"), (3, "a b c x d e")]
    for d in range(4, 120):
        words = say(rng.randint(1, 40))
        if d % 2:
            w = rng.choice(items[:25])[1].split()
            w = w[rng.randint(0, 3):len(w) - rng.randint(0, 3)]
            for k in rng.sample(range(len(w)), min(len(w), rng.randint(0, 4))):
                w[k] = "other"
            words[len(words) // 2:len(words) // 2] = w
        docs.append((d, (" " if d % 3 else ", ").join(words)))
    a = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, words string")
    b = spark.createDataFrame([(*r, 5) for r in items], "item_id long, text string, n int")
    got = sorted(tuple(r) for r in decontaminate.contaminated(a, b).collect())
    assert got == brute_contaminated(docs, items) and len(got) > 20
    for least in (1, 2, 13):
        kept = {r["doc_id"] for r in decontaminate.drop_contaminated(a, b, least).collect()}
        assert kept == {d for d, _ in docs} - {r[0] for r in got if r[3] >= least}
    assert decontaminate.contaminated(a, b.limit(0)).count() == 0
    assert decontaminate.contaminated(a.limit(0), b).count() == 0


def test_the_mask_meets_every_pattern_of_two_substitutions():
    for mask in decontaminate.MASKS:
        for gone in combinations(range(decontaminate.WINDOW), decontaminate.WINDOW - decontaminate.NEED):
            assert any(not {s + o for o in mask} & set(gone) for s in range(decontaminate.WINDOW - mask[-1]))


def brute_repeats(rows):
    first = {}
    for d, t in rows:
        raw = (t or "").encode()
        for i in range(len(raw) - 49 if d is not None else 0):
            first[raw[i:i + 50]] = min(first.get(raw[i:i + 50], d), d)
    out = []
    for d, t in rows:
        raw = (t or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - 49 if d is not None else 0):
            if first[raw[i:i + 50]] < d:
                gone[i:i + 50] = b"\1" * 50
        left = bytes(x for x, y in zip(raw, gone) if not y)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(raw), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("max_group", [suffix_dedup.MAX_GROUP, 0])
def test_repeats_against_brute_force(spark, sf_small, max_group):
    docs, rows = odd_docs(spark)
    rng = random.Random(4)
    periodic = [(20 + i, "".join(rng.choice("ab") for _ in range(200)) + "abc" * rng.randint(20, 60) + "é" * 40) for i in range(20)]
    more = spark.createDataFrame(periodic, "doc_id long, text string")
    table = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").limit(60)
    for df in (docs.select("doc_id", "text").unionByName(more), table):
        plain = [tuple(r) for r in df.collect()]
        got = suffix_dedup.remove_repeats(df, max_group).selectExpr(
            "doc_id", "octet_length(text)", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted((tuple(r) for r in got), key=repr) == brute_repeats(plain)
    assert suffix_dedup.removal_report(docs.limit(0)).count() == 0


def test_merged_shards_order_all_windows():
    """The interleave equals sorting every place by its 50 bytes."""
    rng = random.Random(2)
    shards = [np.array([rng.choice(b"ab") for _ in range(n)], np.uint8) for n in (300, 5, 120, 77)]
    place, opens = suffix_dedup.merged(shards)
    circles = [bytes(np.resize(s, len(s) + 60)) for s in shards]
    window = [c[i:i + 50] if len(s) >= 50 else (bytes(s) * 60)[i:i + 50]
              for s, c in zip(shards, circles) for i in range(len(s))]
    assert sorted(place.tolist()) == list(range(len(window)))
    found = [window[p] for p in place]
    assert found == sorted(found)
    assert [i == 0 or found[i] != found[i - 1] for i in range(len(found))] == opens.tolist()


def test_long_texts_are_scanned_in_parts(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CHUNK", 200)
    texts = [bytes(random.Random(i).choices(b"abc", k=n)) for i, n in enumerate((30, 900, 50, 49, 0, 201, 200))]
    seen = sorted((int(i), int(s) + k) for _, ii, ss, rr in suffix_dedup._scan(texts)
                  for i, s, r in zip(ii, ss, rr) for k in range(r))
    assert seen == sorted((i, k) for i, t in enumerate(texts) for k in range(len(t) - 49))


@pytest.mark.parametrize("max_group", [0, 3, 1000])
@pytest.mark.parametrize("rows_at_once", [1, 4, 1000])
def test_settling_a_stream_of_stretches(monkeypatch, max_group, rows_at_once):
    """Whatever the batches are and whichever anchors are settled apart."""
    import pyarrow as pa
    monkeypatch.setattr(suffix_dedup, "NARROW_ROWS", rows_at_once)
    rng = random.Random(11)
    rows = []
    for h in range(6):
        cores = [bytes(rng.choices(b"xyz", k=60)) for _ in range(2)]
        for _ in range(rng.choice([1, 2, 12])):
            c = rng.choice(cores)
            rows.append((h, c[rng.randint(0, 5):rng.randint(55, 60)], rng.randint(1, 9), 0, rng.randint(0, 3) * 1000))
    rows = sorted(set(rows), key=lambda r: r[:3])
    first, want = {}, set()
    for h, p, d, _, s in rows:
        for i in range(len(p) - 49):
            first[h, p[i:i + 50]] = min(first.get((h, p[i:i + 50]), d), d)
    for h, p, d, _, s in rows:
        want |= {(d, s + i + k) for i in range(len(p) - 49) if first[h, p[i:i + 50]] < d for k in range(50)}
    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i:i + 5]), types)],
                                          names=["h", "piece", "doc_id", "print", "s"]) for i in range(0, len(rows), 5)]
    got, apart = set(), []
    for b in suffix_dedup._settled(iter(batches), max_group):
        for r in b.to_pylist():
            if r["window"] is None:
                got |= {(r["doc_id"], x) for x in range(r["s"], r["e"])}
            else:
                apart.append(r)
    # windows sent on are compared by their bytes; those of settled anchors are not among them
    low = {}
    for r in apart:
        low[r["window"]] = min(low.get(r["window"], 99), r["doc_id"])
    for r in apart:
        if low[r["window"]] < r["doc_id"]:
            got |= {(r["doc_id"], x) for x in range(r["s"], r["e"])}
    assert got == want
