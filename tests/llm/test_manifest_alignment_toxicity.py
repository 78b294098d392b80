"""Operators 11, 12 and 13 against brute force and held-out accuracy."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from articleflow.llm import alignment, merkle, toxicity
from tests.llm.brute_merkle import brute_manifest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EDGES = [(1, "a\nb", "en", "s", 3), (1, "a\nb", "en", "s", 3), (1, "zz", None, "s", None), (None, None, None, None, None),
         (5, "", "", "", 0), (2, "x" * 200_000 + "\n", "de", "s", 200_001), (7, "é🙂\n", "fr", None, 3), (-4, "\n\n", "en", "s", 2)]


def odd_rows(n):
    return EDGES + [(i, f"text {i}\nline", "en", "hot" if i % 3 else f"s{i % 5}", 12) for i in range(100, 100 + n)]


@pytest.mark.parametrize("levels,n", [(6, 30), (1, 95), (0, 61)])
def test_manifest_against_brute_force(spark, monkeypatch, levels, n):
    """Small blocks make the exchange run over ragged trees of many sizes."""
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", levels)
    rows = odd_rows(n)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], DOCS + ", root string, pos int").repartition(5)
    got = sorted(map(tuple, merkle.manifest_report(docs).collect()), key=repr)
    assert got == sorted(brute_manifest(rows), key=repr)
    # a row fails where its tampered line ends had been there
    bad = {r[0] for r in got if not r[6]}
    assert bad == {r[0] for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and "\n" in (r[1] or "")}


def test_manifest_of_no_rows_and_of_one(spark):
    docs = spark.createDataFrame(EDGES[:1], DOCS)
    assert merkle.manifest(docs.limit(0)).count() == 0
    (r,) = merkle.manifest(docs).collect()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof"] == []
    assert r["leaf"] == hashlib.sha256(b"1:11:s2:en1:33:a\nb").hexdigest()


def test_proofs_bind_place_and_text(spark):
    docs = spark.createDataFrame(odd_rows(40), DOCS)
    m = merkle.manifest(docs)
    assert m.where(merkle.folded(F.col("leaf"), F.col("proof")) != F.col("root")).count() == 0
    other = m.withColumn("leaf", F.sha2(F.concat("leaf", F.lit("!")), 256))
    assert other.where(merkle.folded(F.col("leaf"), F.col("proof")) == F.col("root")).count() == 0


TEXTS = [(-1, None), (-2, ""), (-3, "a" * 3000), (-4, "▁x"), (-5, "日本語のテキスト。" * 60), (-6, "<|endoftext|></s> hi"),
         (-7, " lead  two\n\n\ttab "), (-8, "🙂é́" * 80), (-8, "🙂é́" * 80), (-9, "x\x00y\r\n"),
         (None, "b64" + "QWxhZGRpbjpvcGVuIHNlc2FtZQ==" * 30), (-10, "Straße ö ﬁ ½ 　  x")]


def brute_alignment(rows):
    import public_tokenizers as P
    tok = alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    docs, held = [], Counter()
    for d, t in rows:
        a, b = [], []
        if t:
            a, b = tok.a.encode(" " + t, add_special_tokens=False).ids, tok.b.encode(t)
            if any(b"".join(by[i] for i in x) != (" " + t).encode() for x, by in ((a, tok.bytes_a), (b, tok.bytes_b))):
                a, b = [], []
        ends = [[sum(len(by[i]) for i in x[:k + 1]) for k in range(len(x))] if len(x) < 3000 else
                list(np.cumsum([len(by[i]) for i in x])) for x, by in ((a, tok.bytes_a), (b, tok.bytes_b))]
        groups, i, j = [], 0, 0
        for c in sorted(set(ends[0]) & set(ends[1])):
            ga = [x for x, e in zip(a[i:], ends[0][i:]) if e <= c]
            gb = [x for x, e in zip(b[j:], ends[1][j:]) if e <= c]
            i, j = i + len(ga), j + len(gb)
            groups.append((ga, gb))
        links = Counter((x, y) for ga, gb in groups for x in ga for y in gb)
        held.update(set(links))
        docs.append((d, a, b, groups, links))
    top = defaultdict(int)
    for (x, _), n in held.items():
        top[x] = max(top[x], n)
    return [(d, len(a), len(b), len(g), sum(n.values()), sum(k for p, k in n.items() if held[p] == top[p[0]]),
             sum(k * held[p] for p, k in n.items()),
             hashlib.sha256(";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in g).encode()).hexdigest()
             if a else "") for d, a, b, g, n in docs]


def test_alignment_against_brute_force(spark, sf_small, monkeypatch):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").where("doc_id < 60").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(TEXTS, "doc_id long, text string"))
    want = sorted(brute_alignment([tuple(r) for r in docs.collect()]), key=repr)
    clash = docs.withColumn("pair", F.lit("x")).withColumn("n_a", F.lit(1)).withColumn("chunk", F.lit(None).cast("int"))
    got = alignment.alignment_report(clash)
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert alignment.alignment_report(docs.limit(0)).count() == 0


def test_pieces_chunks_and_wide_groups_change_nothing(monkeypatch):
    import public_tokenizers as P
    tok = alignment.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
    texts = [t for _, t in TEXTS]
    one = alignment.Chunk(tok, texts)
    whole = [x.tolist() for x in one.pairs()], one.digests(), one.links().tolist()
    for piece, links, wide in ((1, 7, 0), (2, 50, 3), (17, 1 << 20, 1 << 30)):
        monkeypatch.setattr(alignment, "PIECE_ENDS", piece)
        monkeypatch.setattr(alignment, "LINKS_AT_ONCE", links)
        monkeypatch.setattr(alignment, "WIDE", wide)
        monkeypatch.setattr(alignment.shared_ends, "__defaults__", (piece,))
        c = alignment.Chunk(tok, texts)
        assert ([x.tolist() for x in c.pairs()], c.digests(), c.links().tolist()) == whole


def test_diagonals_cut_equal_pieces():
    rng = np.random.default_rng(3)
    for _ in range(200):
        ea, eb = (np.unique(rng.integers(1, 60, rng.integers(0, 40))) for _ in range(2))
        piece = int(rng.integers(1, 9))
        ia, ib = alignment.diagonals(ea, eb, piece)
        assert (np.diff(ia + ib)[:-1] == piece).all() and ia[-1] == len(ea) and ib[-1] == len(eb)
        # what lies before a cut ends no later than what lies behind it
        for i, j in zip(ia, ib):
            before, after = [*ea[:i], *eb[:j]], [*ea[i:], *eb[j:]]
            assert not before or not after or max(before) <= min(after)
        a, b = alignment.shared_ends(ea, eb, piece)
        assert ea[a].tolist() == eb[b].tolist() == sorted(set(ea.tolist()) & set(eb.tolist()))


def test_alignments_keep_texts_and_columns(spark):
    docs = spark.createDataFrame([(1, "Hello world", "k"), (2, None, "k")], "doc_id long, text string, a string")
    got = {r["doc_id"]: r["groups"] for r in alignment.alignments(docs).collect()}
    assert [(g["start"], g["stop"]) for g in got[1]] == [(0, 6), (6, 12)] and got[2] == []
    with pytest.raises(ValueError):
        alignment.alignments(docs, out="a")


def test_chunk_rows_and_their_row_groups_stay_small(spark, monkeypatch):
    import pyarrow.parquet as pq

    from articleflow.llm import common
    monkeypatch.setitem(common.LARGE_ROWS, "parquet.block.size", str(64 << 10))
    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}{c}" for a in ("stone", "river", "old", "Mountain") for b in ("ly", "ness", "er", "-") for c in range(40)])
    rows = [(i, " ".join(rng.choice(words, 800))) for i in range(400)]
    parts = alignment.chunks(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    got = parts.selectExpr("length(at) + length(times) + 12 * size(pair) + 120 * size(doc_id) AS b", "size(doc_id) AS n",
                           "aggregate(kinds, 0, (x, y) -> x + y) AS links", "length(at) + length(times) AS packed").collect()
    assert sum(r["n"] for r in got) == len(rows) and len(got) > 1 and max(r["b"] for r in got) < 1 << 20
    assert all(r["packed"] <= 4 * r["links"] for r in got)          # numbers below 65,536, two bytes each at most
    for f in parts.inputFiles():
        m = pq.ParquetFile(f.removeprefix("file://")).metadata
        assert [m.row_group(i).num_rows for i in range(m.num_row_groups)] == [1] * m.num_rows


def test_documents_without_text_close_chunks(spark):
    docs = spark.range(20_000).coalesce(1).selectExpr("id AS doc_id", "IF(id % 2 = 0, '', NULL) AS text")
    sizes = [r[0] for r in alignment.chunks(docs).selectExpr("size(doc_id)").collect()]
    assert sum(sizes) == 20_000 and max(sizes) <= alignment.CHUNK_BYTES // alignment.DOC_BYTES
    got = alignment.alignment_report(docs)
    assert got.count() == 20_000 and got.distinct().where("n_a + n_b + n_groups + n_links + n_best + count_sum = 0 "
                                                          "AND groups_sha256 = ''").count() == 20_000


def test_packed_numbers_come_back():
    for x in ([], [0], [0, 255], [256, 0], [65_536], [3, 2 ** 32 - 1], [2 ** 32, 1], [2 ** 62]):
        x = np.array(x, np.int64)
        raw = alignment._packed(x)
        back = alignment._unpacked(raw, len(x))
        assert back.dtype == np.int64 and back.tolist() == x.tolist()
    assert len(alignment._packed(np.array([0, 255]))) == 2 and len(alignment._packed(np.array([256, 0]))) == 4


INSULT = ["stupid", "worthless", "moron", "pathetic"]
HIDDEN = ["5tup1d", "st*pid", "s t u p i d", "s.t.u.p.i.d", "stuuuupid", "$tupid", "w0rthl3ss", "m0r0n", "m-o-r-o-n", "p4thetic"]
PLAIN = "the quick brown fox walks over some old stones and the people of this town see it as they stand there".split()


def prose(i, extra=""):
    words = [PLAIN[(i * 7 + k * (3 + i % 5)) % len(PLAIN)] for k in range(40)]
    return " ".join(words[:20] + ([extra] if extra else []) + words[20:])


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, prose(i, INSULT[i // 4 % 4] if i % 4 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.language_model(docs)
    train = spark.createDataFrame([(t, int(i % 4 == 0)) for i, t in rows], "text string, toxic int")
    return model, *toxicity.fit(train, model)


def test_language_model_against_brute_force(spark):
    texts = ["ab abc", "É-b", None, "", "日本 a"]
    counts = Counter()
    for t in texts:
        for w in (t or "").replace("-", " ").split():
            s = [0, 0, 0] + [{"é": 5, "É": 5}.get(c, ord(c.lower()) - 96 if "a" <= c.lower() <= "z" else 27) for c in w] + [0]
            counts.update(tuple(s[i - 3:i + 1]) for i in range(3, len(s)))
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    got = toxicity.language_model(docs)
    c = np.zeros((28,) * 4)
    for k, n in counts.items():
        c[k] = n
    p = np.full(28, 1 / 28)
    for k in range(4):
        m = c.sum(axis=tuple(range(3 - k)))
        p = (m + 8 * p) / (m.sum(-1, keepdims=True) + 8)
    assert np.allclose(got, -np.log(p), atol=1e-5)


def test_decoding_is_the_best_path(judged):
    """Viterbi against all paths of small lattices."""
    import itertools
    model = judged[0]
    r = toxicity.Restorer(model)
    code = toxicity._code()
    for span in ["1d", "s0m3", "t.h.e", "th33", "ooold", "$t0n3", "a b", "*ld"]:
        best = None
        for path in itertools.product(*toxicity._slots(span)):
            cost, ctx = 0.0, (0, 0, 0)
            for text, extra in [*path, (" ", 0.0)]:
                cost += extra
                if text:
                    s = int(code[ord(text)])
                    cost += float(model[(*ctx, s)]) if s or ctx[2] else 0.0
                    ctx = (ctx[1], ctx[2], s) if s else (0, 0, 0)
            if best is None or cost < best[0] - 1e-9:
                best = (cost, "".join(t for t, _ in path))
        assert r.decode(span) == best[1]


def test_hidden_insults_are_restored_and_caught(spark, judged):
    model, weights, constant = judged
    r = toxicity.Restorer(model)
    assert [r.restore(f"you {x} fox") for x in HIDDEN] == [
        f"you {x} fox" for x in ["stupid"] * 6 + ["worthless", "moron", "moron", "pathetic"]]
    for same in ["the### old$$$", "10,000 of 3.5", "see it, as they stand...", "schön"]:
        assert r.restore(same) == same
    docs = spark.createDataFrame([(i, prose(900 + i, x), "q") for i, x in enumerate(HIDDEN + INSULT)]
                                 + [(100 + i, prose(700 + i), "q") for i in range(20)]
                                 + [(200, None, "q"), (201, "", "q"), (202, "", "q")], "doc_id long, text string, toxic string")
    got = {x["doc_id"]: x["score"] for x in toxicity.score(docs, model, weights, constant).collect()}
    assert len(got) == len(HIDDEN + INSULT) + 23 and all(0 <= v <= 1 for v in got.values())
    assert [i for i, v in got.items() if v >= 0.5] == list(range(len(HIDDEN + INSULT)))
    shown = toxicity.restored(docs, model).where("doc_id in (0, 200)").orderBy("doc_id").collect()
    assert "stupid" in shown[0]["restored"] and shown[1]["restored"] is None
    with pytest.raises(ValueError):
        toxicity.score(docs, model, weights, constant, out="toxic")


def test_spans_take_linear_time(judged):
    import time
    r = toxicity.Restorer(judged[0])
    t = time.time()
    for long in ("語" * 100_000 + "2024" + "語" * 100_000, "ab" * 100_000 + "123x", "a " * 20_000, "x1" * 20_000, "." * 100_000):
        r.restore(long)
    assert time.time() - t < 30


def test_toxicity_without_labels_and_of_no_rows(spark):
    docs = spark.createDataFrame([(1, "x y"), (1, "x y"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([(9, 1), (1, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_report(docs, none).collect()
    assert len(got) == 3 and all(r["score"] < 1e-9 and r["predicted"] == 0 for r in got)
    assert toxicity.toxicity_report(docs.limit(0), none).count() == 0


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity_report(docs.repartition(8), labels).where("held_out").join(labels.select("doc_id", "toxic"), "doc_id")
    n = Counter((r["toxic"], r["predicted"]) for r in got.collect())
    assert n[1, 1] / (n[1, 1] + n[0, 1]) > 0.9 and n[1, 1] / (n[1, 1] + n[1, 0]) > 0.75
    assert n[0, 0] / (n[0, 0] + n[0, 1]) > 0.99
