"""Operators 6, 7, 10, the SQL of all, and the pipeline."""

import hashlib
import math
import random
import re

import pytest

from articleflow.llm import licenses, quality, secrets

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.I | re.A), lambda m: len(m[2]) >= 6),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
        ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24)]

SECRETS = ["", None, "token = abc", "secret: token = abcdefgh", 'Password="hunter22" é passwd:: x', "api_key='a.b-c/d=' apikey=1234567",
           "AKIA" + "A" * 16, "AKIAAKIA" + "B1" * 8, "AKIA12 AKIA" + "Z" * 40, "0" * 24, "0" * 23, "🙂" + "ab" * 20 + "é token: " + "f" * 30,
           "user_name: joe", "user_name: joe\npwd = x1y2z", "user_name: joe" + " " * 400 + "pwd = x1y2z",
           "https://db.example.org:99 login=bob1 pwd: s3cr", "https://db.example.org:99 login=bob1", "TOKEN:abcdef\ntoken:abcdef", "x" * 100_000,
           ("token = " + "a1" * 15 + "\n") * 300]


def test_base_secrets_against_brute_force(spark):
    rows = [(i if i != 7 else None, t, "spans", 1, 2) for i, t in enumerate(SECRETS)] + [(0, SECRETS[4], "spans", 1, 2)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, kind string, rid int, start int")
    got = sorted((tuple(r)[:5] for r in secrets.secret_report(docs).collect()), key=repr)
    want = []
    for d, t, *_ in rows:
        found = sorted((m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(BASE) for m in p.finditer(t or "") if ok(m))
        n = [sum(x[1] == i for x in found) for i in range(3)]
        want.append((d, *n, hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in found).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert secrets.secret_report(docs.limit(0)).count() == 0


def test_weak_parts_need_their_complement(spark):
    docs = spark.createDataFrame(list(enumerate(SECRETS)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    assert spans[12] == spans[14] == spans[16] == ""
    assert spans[13] == "weak_id:0:14,weak_secret:15:26"
    assert [x.split(":")[0] for x in spans[15].split(",")] == ["endpoint", "weak_id", "weak_secret"]


def test_redaction(spark):
    rows = [(i, t, len(t or ""), "x") for i, t in enumerate(SECRETS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, cuts string")
    out = {r["doc_id"]: r for r in secrets.redact(docs).collect()}
    assert secrets.redact(docs).columns == docs.columns and len(out) == len(rows)
    assert out[1]["text"] is None and out[0]["text"] == ""
    assert out[13]["text"] == "[SECRET]\n[SECRET]" and out[13]["n_chars"] == 17
    assert out[11]["text"] == "🙂[SECRET]é [SECRET]" and out[2]["text"] == "token = abc"
    assert out[19]["text"] == "[SECRET]\n" * 300


def brute_counts(t):
    t = t or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 3)}
    lines, dup, seen = 0, 0, set()
    for x in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += 1
            dup += x in seen
            seen.add(x)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), dup, len(hit), lines, sum("A" <= c <= "Z" for c in t))


TEXTS = ["", None, "a b c a b c", "a b c a b c a b", "x\nx\n\n \nx\r\n", "Ünï|<> #*\x0b\x0cz\x85y\xa0z", "a a a a", "\n".join(["l m"] * 40), "w " * 300,
         "UP! | " * 100, "a\x1cb"]


def test_quality_counts_against_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, n_words int")
    rng = random.Random(1)
    for t in TEXTS + [" ".join(rng.choices("abcd", k=60)) for _ in range(50)]:
        assert quality.text_counts(t) == brute_counts(t)
    labels = spark.createDataFrame([(1, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_report(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        n, chars, sym, dup, rep, *_ = brute_counts(t)
        failed = n < 50 or 100 * rep > 50 * n
        assert tuple(got[i])[1:] == (n, chars, sym, dup, rep, failed, not failed)
    assert quality.quality_report(docs.limit(0), labels).count() == 0
    assert quality.keep_good(docs, labels.limit(0)).columns == docs.columns


def test_binomial_tail_is_exact():
    for n, p in ((10, 0.3), (200, 0.05), (1000, 0.005)):
        for k in range(int(n * p)):
            want = sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(want, rel=1e-9)
    assert quality.binomial_tail(5, 10, 0.3) == 1.0 and quality.binomial_tail(0, 0, 0.1) == 1.0


def test_cutoffs_need_evidence_in_each_stratum(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(6000):
        lang = ("en", "de", None)[i % 3] if i % 30 else "rare"
        bad = i % 5 == 0
        words = [rng.choice("abcdefghij") + str(rng.randint(0, 9999)) for _ in range(60)]
        rows.append((i, (" | " if bad else " ").join(words), lang))
        labels.append((i, 0 if bad else 1, 0))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    marks = spark.createDataFrame(labels + [(0, 1, 0)], "doc_id long, quality int, toxic int")
    counted = quality.with_counts(docs)
    cutoffs = {r["stratum"]: r["cutoffs"] for r in quality.fit_cutoffs(counted, marks, risk=0.04).collect()}
    assert set(cutoffs) == {"en", "de", ""} and all("symbols" in c for c in cutoffs.values()), cutoffs
    strict = quality.fit_cutoffs(counted, marks, risk=0.001)
    assert strict.count() == 0
    kept = quality.judge(counted, quality.fit_cutoffs(counted, marks, risk=0.04)).where("__kept")
    good = {i for i, q, _ in labels if q}
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert good <= ids
    assert {lang for i, _, lang in rows if i in ids - good} == {"rare"}


def test_patience_alignment():
    t = licenses.words_of(licenses.TEMPLATES["GPL-3.0"])
    assert len(licenses.align(t, t)) == len(t)
    swapped = t[:]
    swapped[3] = "governed"
    assert len(licenses.align(["x", "the", *swapped, "the"], t)) == len(t) - 1
    pairs = licenses.align("the b the c the".split(), "the b the c".split())
    assert pairs == [(0, 0), (1, 1), (2, 2), (3, 3)]
    rng = random.Random(8)
    for _ in range(200):     # increasing(): longest, by brute force over subsets
        perm = list(enumerate(rng.sample(range(9), 7)))
        picks = [[perm[i][1] for i in range(7) if m >> i & 1] for m in range(128)]
        best = max(len(x) for x in picks if x == sorted(x))
        got = licenses.increasing(perm)
        assert len(got) == best and all(a < b for (_, a), (_, b) in zip(got, got[1:]))


def test_license_rows(spark):
    mit, gpl = licenses.TEMPLATES["MIT"], licenses.TEMPLATES["GPL-3.0"]
    filler = " ".join(f"f{i}" for i in range(300))
    rows = [(1, None), (2, ""), (3, filler), (4, f"{filler}\n{mit}.\n{filler} {mit.upper()} end"), (5, gpl.replace("work", "code")),
            (6, "the MIT of released under"), (7, licenses.TEMPLATES["MIT-notice"]), (None, mit), (4, mit), (8, filler * 50)]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, licenses string, license int")
    got = sorted((tuple(r)[:2] for r in licenses.license_report(docs).collect()), key=repr)
    assert got == sorted([(4, "MIT"), (4, "MIT"), (5, "GPL-3.0"), (7, "MIT-notice"), (None, "MIT"), (4, "MIT")], key=repr)
    assert licenses.license_report(docs.limit(0)).count() == 0
    for r in licenses.license_report(docs).where("doc_id = 5").collect():
        assert r["coverage"] == pytest.approx(11 / 12)


def test_hints_lose_no_text():
    cut = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    hints = licenses.hint_words(cut, 0.8)
    rng = random.Random(0)
    for words in cut.values():
        for _ in range(200):
            gone = rng.sample(range(len(words)), int(0.2 * len(words) + 1e-9))
            assert hints.search(" ".join(w for i, w in enumerate(words) if i not in gone))


@pytest.mark.parametrize("name", ["op3", "op4", "op6", "op7"])
def test_sql_gives_the_same_rows(spark, sf_small, name):
    from tools.oracle_check import check
    res = check(spark, sf_small, [name], verbose=False)
    assert res and all(v.startswith("ok") for v in res.values()), res


def test_pipeline_against_its_stages_by_brute_force(spark, sf_small):
    import corpus_pipeline
    import duckdb
    from articleflow.llm import sentencepiece_codec
    from articleflow.llm.oracle import ORACLE
    import os, sys
    sys.path.insert(0, os.path.dirname(__file__))
    from test_duplicates import brute_contaminated, brute_simhash

    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_small}/{t}.parquet'")
    texts = dict(con.execute("SELECT doc_id, text FROM documents").fetchall())
    kept = {d for d, k in con.execute(f"SELECT doc_id, kept FROM ({ORACLE['op7_quality']})").fetchall() if k}
    rows = [(d, texts[d]) for d in sorted(kept)]
    rows = [(d, texts[d]) for d, _, c in brute_simhash(rows) if d == c]
    bad = {r[0] for r in brute_contaminated(rows, con.execute("SELECT item_id, text FROM benchmark").fetchall())}
    rows = [(d, t) for d, t in rows if d not in bad]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    want = {}
    for d, t in rows:
        cuts = sorted(tuple(map(int, x.split(":")[1:])) for x in spans[d].split(",") if x)
        out, at = "", 0
        for s, e in cuts:
            if s >= at:
                out += t[at:s] + secrets.MASK
            at = max(at, e)
        want[d] = out + t[at:]
    got = {r["doc_id"]: r["decoded"] for r in sentencepiece_codec.decode(corpus_pipeline.run(spark, sf_small)).collect()}
    assert got == want and 0 < len(got) < len(texts)
