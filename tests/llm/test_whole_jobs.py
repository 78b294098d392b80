"""Cases that earlier versions of the operators left out."""

import random
from itertools import combinations

import pytest

from articleflow.llm import decontaminate, licenses, secrets


@pytest.fixture(scope="module")
def scan():
    cut = {k: licenses.words_of(v) for k, v in licenses.TEMPLATES.items()}
    must = {k: [licenses.words_of(x) for x in v] for k, v in licenses.KEYS.items()}
    hints = licenses.hint_words(cut, 0.8)
    return lambda text: [(x["license"], x["coverage"]) for x in licenses.find(text, cut, hints, 0.8, must)]


@pytest.mark.parametrize("text, name", [
    ("Released under the BSD License", "BSD"), ("Licensed under CC BY 4.0", "CC-BY-4.0-name"),
    ("Licensed under CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
    ("This work is licensed under the GNU General Public License, version 2. See chapter 3", "GPL-2.0"),
    (licenses.TEMPLATES["GPL-3.0-notice"].replace("version 3", "version 2"), "GPL-2.0-notice"),
    (licenses.TEMPLATES["GPL-3.0-notice"].replace("program", "library").replace("GNU", "GNU Lesser"), "LGPL-3.0-notice"),
    ("SPDX-License-Identifier: MPL-2.0", "MPL-2.0-spdx")])
def test_other_licenses_are_not_taken_for_known_ones(scan, text, name):
    assert [x for x, _ in scan(f"foreign words before it. {text}. and after")] == [name]


def test_each_template_finds_itself_alone(scan):
    for name, text in licenses.TEMPLATES.items():
        assert scan(text) == [(name, 1.0)]
    pair = "{}. And {}".format(licenses.TEMPLATES["Apache-2.0"], licenses.TEMPLATES["GPL-3.0"])
    assert [x for x, _ in scan(pair)] == ["Apache-2.0", "GPL-3.0"]


@pytest.mark.parametrize("name", ["MIT-notice", "BSD-2-Clause-notice", "ISC-notice"])
def test_a_notice_with_words_between_is_found(scan, name):
    words = licenses.words_of(licenses.TEMPLATES[name])
    lines = [f"l{i} zz " + " ".join(words[i:i + 3]) for i in range(0, len(words), 3)]
    assert name in [x for x, _ in scan("\n".join(lines))]
    spread = [f"{w} x{i} y{i}" if i < 20 else w for i, w in enumerate(words)]
    assert [x for x, _ in scan(" ".join(spread))] == [name]


@pytest.mark.parametrize("secret", ["private_key: " + "Ab1/" * 100, "Zx9" * 90])
def test_a_long_secret_is_masked_on_either_side_of_its_identifier(spark, secret):
    texts = [f"{secret} client_id: robot77", f"client_id: robot77 {secret}", f"{secret}\nlogin=bob1 end", f"{secret}{' ' * 300}login=bob1"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r["doc_id"]: r["spans"] for r in secrets.secret_report(docs).collect()}
    assert all("weak_id" in spans[i] for i in range(3)) and "weak_id" not in spans[3]
    out = [r["text"] for r in secrets.redact(docs).orderBy("doc_id").collect()]
    assert out == ["[SECRET] [SECRET]", "[SECRET] [SECRET]", "[SECRET]\n[SECRET] end", texts[3]]


def test_short_masks_meet_every_allowed_pattern():
    for n in range(1, decontaminate.WINDOW):
        spots = [{s + o for o in m} for m in decontaminate.short_masks(n) for s in range(n - m[-1])]
        for gone in combinations(range(n), n - decontaminate.short_need(n)):
            assert any(not x & set(gone) for x in spots), (n, gone)


def test_short_and_unspaced_items(spark):
    rng = random.Random(4)
    say = lambda n: [f"v{rng.randrange(40)}" for _ in range(n)]
    items = [(i, say(i % 15 + 1)) for i in range(45)]
    docs = [(d, say(rng.randint(1, 30))) for d in range(150)]
    for d, w in docs:
        _, item = rng.choice(items)
        item = list(item)
        for k in rng.sample(range(len(item)), min(len(item), rng.randint(0, 3))):
            item[k] = "other"
        w[len(w) // 2:len(w) // 2] = item
    first = {}
    for i, w in items:
        first.setdefault(tuple(w), i)
    want = {}
    for d, words in docs:
        for w, i in first.items():
            n, size = len(w), min(13, len(w))
            need = 11 if n >= 13 else -(-4 * n // 5)
            for s in range(-n, len(words)):
                same = [0 <= s + k < len(words) and words[s + k] == w[k] for k in range(n)]
                good = [g for g in range(n - size + 1) if sum(same[g:g + size]) >= need]
                if good:
                    m = sum(same[k] and any(g <= k < g + size for g in good) for k in range(n))
                    want[d, i] = max(want.get((d, i), (0, n)), (m, n))
    table = lambda rows, key: spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{key} long, text string")
    got = decontaminate.contaminated(table(docs, "doc_id"), table(items, "item_id"))
    assert sorted(map(tuple, got.collect())) == sorted((*k, *v) for k, v in want.items())
    assert {n for m, n in want.values() if m < n} >= {5, 6, 9, 10, 12}

    question, thai = "今年的春节晚会在哪一天举行呢", "ประเทศไทยอยู่ที่ไหนในโลกนี้"
    b = spark.createDataFrame([(1, question), (2, thai), (3, "日本"), (4, "")], "item_id long, text string")
    a = spark.createDataFrame([(1, f"请问{question.replace('晚', '早')}谢谢"), (2, f"xx{thai}yy"), (3, "在日本国"), (4, "日 x 本"), (5, None)],
                              "doc_id long, text string")
    rows = {tuple(r)[:2] for r in decontaminate.contaminated(a, b).collect()}
    assert rows == {(1, 1), (2, 2), (3, 3)}
    assert {r["doc_id"] for r in decontaminate.drop_contaminated(a, b).collect()} == {4, 5}
