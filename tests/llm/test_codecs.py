"""Operators 1, 2, 3, 8: codecs, language, chats, token counts."""

import hashlib

import pytest

from articleflow.llm import chat_format, language_id, sentencepiece_codec, token_count
from articleflow.llm.pieces import load
from articleflow.llm.queries import QUERIES

ODD = ["", None, " ", "  a  b", "a\n\n b\t", "<s> hi </s>", "日本 x", "\x00a", "é́", "<0x0A>", "　x", "xyzzy" * 300,
       "ab " * 200, "🙂🙂 ok", "a" * 5000, "\n", "same", "same"]


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Odd texts, a null id, repeated rows and columns with clashing names."""
    rows = [(None if i == 3 else i // 2 if i > 15 else i, t, "x", i, [1]) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, score int, decoded array<int>")


def test_token_counts_equal_the_library(spark, sf_small, odd, model):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    got = sorted((tuple(r) for r in token_count.token_report(docs).collect()), key=repr)
    want = sorted(((d, len((t or "").encode()), n := len(lib.encode(t or "")), n > 4096)
                   for d, t in docs.collect()), key=repr)
    assert got == want
    assert token_count.token_report(odd).count() == len(ODD)
    assert token_count.token_report(docs.limit(0)).count() == 0


def test_viterbi_equals_a_unigram_model(spark, sf_small, odd, model, tmp_path):
    """The library's own unigram encoder on the same pieces and scores."""
    import sentencepiece
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    proto = pb.ModelProto()
    with open(model, "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    for p in proto.pieces:
        if p.type == 1 and p.score < -1e6:   # sums of these are not exact in single precision
            p.score = -32000
    path = str(tmp_path / "uni.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    short = [(d, " ".join((t or "").split(" ")[:60])[:400]) for d, t in docs.collect()]
    df = spark.createDataFrame(short, "doc_id long, text string")
    for r in sentencepiece_codec.encode(df, model_path=path).collect():
        assert list(r["ids"]) == lib.encode(r["text"])


def test_sentencepiece_round_trip(spark, sf_small, odd, model):
    import sentencepiece
    lib = sentencepiece.SentencePieceProcessor(model_file=model)
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text").unionByName(odd.select("doc_id", "text"))
    rows = sentencepiece_codec.encoded_documents(docs).collect()
    assert len(rows) == docs.count() and all(r["round_trip"] for r in rows)
    best = load(model).scores
    for r in rows[:50]:      # the best path is no worse than the byte-pair one
        ids = list(r["ids"])
        text = lib.decode(ids)
        total = sum(best.get(lib.id_to_piece(i), -2e9) for i in ids)
        assert total >= sum(best.get(lib.id_to_piece(i), -2e9) for i in lib.encode(text)) - 1e-6
    marked = spark.createDataFrame([(1, "a▁b")], "doc_id long, text string")
    assert sentencepiece_codec.encoded_documents(marked).first()["round_trip"] is False
    assert sentencepiece_codec.encoded_documents(docs.limit(0)).count() == 0


def test_shared_prefixes_give_the_same_paths(model):
    pieces = load(model)
    tails = {p[i:] for p in pieces.ids for i in range(len(p))}
    words = sorted({"▁the", "▁there", "▁thereof", "▁them", "▁", "x", "▁日本", "▁thematic", "tttt", "ttttt"})
    together = sentencepiece_codec.viterbi_sorted(words, pieces, tails)
    assert together == {w: sentencepiece_codec.viterbi_sorted([w], pieces, tails)[w] for w in words}


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op2_language_id"](spark, sf)
    rows = got.join(docs.select("doc_id", "lang", "n_chars"), "doc_id").where("held_out and n_chars >= 40").collect()
    assert len(rows) > 200
    assert sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) >= 0.99
    assert all(0 <= r["score"] <= 1 for r in got.collect()) and got.count() == docs.count()


def test_language_odd_rows(spark):
    rows = [(1, "der die das und nicht", "de", "a"), (2, "the of and to in that", "en", "b"), (3, None, "en", "c"), (4, "", "de", "d"),
            (5, "12 + 34 !", "en", "e"), (5, "the and the", None, "f"), (None, "und die der", "de", "g"), (6, "x" * 200_000, "en", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string")
    train = docs.where("doc_id in (1, 2)")
    prototypes = language_id.fit(train)
    got = {r["text"]: (r["guess"], r["score"]) for r in language_id.predict(docs, prototypes, lang_out="guess").collect()}
    assert got[None] == got[""] == got["12 + 34 !"] == ("und", 0.0)
    assert got["the and the"][0] == "en" and got["und die der"][0] == "de"
    assert set(language_id.fit(train.limit(0))) == set()
    none = language_id.predict(docs, {}, lang_out="guess").select("guess").distinct().collect()
    assert [r[0] for r in none] == ["und"]
    assert language_id.language_report(docs).count() == len(rows)
    assert language_id.language_report(docs.limit(0)).count() == 0


def brute_vector(text):
    """The sum over all letter 3-grams, letter by letter."""
    import numpy as np
    letter = lambda c: language_id.letter_vectors(np.array([c]), 7)[0].astype(int)
    codes = [0]
    for c in text.lower():
        if c.isalpha() or codes[-1]:
            codes.append(ord(c) if c.isalpha() else 0)
    codes += [0] if codes[-1] else []
    return sum((np.roll(letter(a), 2) * np.roll(letter(b), 1) * letter(c) for a, b, c in zip(codes, codes[1:], codes[2:])),
               np.zeros(language_id.DIM, int))


def test_language_vectors_follow_the_definition():
    p = language_id.Profiler()
    for text in ["ab c", "é, É!", "日本 語x", "a" * 5000]:
        (_, got), = p.vectors([text])
        assert (got[0] == brute_vector(text)).all()


def test_letters_of_all_scripts_have_their_own_vectors():
    import numpy as np
    points = np.array([0, *map(ord, "aàäeéjöwыж日本語กข")])
    v = language_id.letter_vectors(points, 7).astype(int)
    cos = v @ v.T / language_id.DIM
    assert set(np.unique(v)) == {-1, 1} and np.abs(cos - np.eye(len(points))).max() < 0.2


def test_languages_against_brute_force(spark):
    import numpy as np
    train = [("the cat and the dog", "en"), ("and then the end", "en"), ("der hund und die katze", "de"), ("кот и собака", "ru"),
             ("été à la plage", "fr"), ("no lang", None), (None, "en"), ("123", "de")]
    ask = ["the hound", "die hunde", "котик", "à l'été", "", None, "42", "ete a la"]
    unit = lambda x: x / max(np.linalg.norm(x), 1e-9)
    sums = {}
    for t, lang in train:
        if lang and t and any(c.isalpha() for c in t):
            sums[lang] = sums.get(lang, 0) + unit(brute_vector(t))
    names = sorted(sums)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(ask)], "doc_id long, text string")
    prototypes = language_id.fit(spark.createDataFrame(train, "text string, lang string").repartition(3))
    got = {r["doc_id"]: r for r in language_id.predict(docs, prototypes).collect()}
    for i, t in enumerate(ask):
        if not t or not any(c.isalpha() for c in t):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0.0)
            continue
        cos = [float(unit(brute_vector(t)) @ unit(sums[n])) for n in names]
        assert got[i]["lang_pred"] == names[int(np.argmax(cos))] and abs(got[i]["score"] - max(0, max(cos))) < 1e-4
    with pytest.raises(ValueError):
        language_id.predict(docs.withColumnRenamed("text", "score"), prototypes, text_col="score")


CHATS = [(1, 0, "system", "be </s> kind"), (1, 1, "user", "a[INST]"), (1, 2, "user", None), (1, 3, "assistant", r"<\/s><\s>"),
         (1, 4, "assistant", "<|im_end|>x<|im_turn|>"), (1, 5, "user", ""), (2, 0, "assistant", ""), (3, 1, "user", "b"),
         (3, 1, "user", "a"), (3, None, None, "first"), (None, 0, "assistant", "null id"), (4, 0, "a\nb<s>", "odd role"),
         (4, 1, "assistant", "[[/INST]] \\\\ <<SYS>> <<\\/SYS>>"), (5, 0, "user", "dup"), (5, 0, "user", "dup"),
         (6, 0, "assistant", "é日🙂" * 1000)]


def test_chats_read_back(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in CHATS],
                               "conv_id long, turn long, role string, text string, formatted string, t int")
    want = {}
    for c in {r[0] for r in CHATS}:
        rows = sorted(((t is not None, t or 0, r or "", x or "") for k, t, r, x in CHATS if k == c))
        loss = "".join(x for _, _, r, x in rows if r == "assistant")
        want[c] = (len(rows), hashlib.sha256("".join(f"{r}\n{x}\n" for _, _, r, x in rows).encode()).hexdigest(), len(loss),
                   hashlib.sha256(loss.encode()).hexdigest())
    probe = "</s>[INST] ok [/INST]"
    want[-7] = (2, hashlib.sha256(f"user\n{probe}\nassistant\n{probe}\n".encode()).hexdigest(), len(probe),
                hashlib.sha256(probe.encode()).hexdigest())
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat_format.chat_report(df).collect()}
    assert got == want
    assert chat_format.chat_report(df.limit(0)).count() == 1      # the probe
    blocks = {r["conv_id"]: len(r["blocks"]) for r in chat_format.with_blocks(chat_format.sorted_turns(df)).collect()}
    assert blocks[1] == 4 and blocks[5] == 1
    for r in chat_format.format_chats(df).collect():
        assert sum(s["chars"] for s in r["segments"]) == len(r["formatted"])


def test_escape_is_reversible_and_leaves_no_mark(spark):
    from hypothesis import given, settings
    from hypothesis import strategies as st
    found = []
    part = st.sampled_from(["<", "[", "\\", "/", "s>", "|", "|im_end|>", "INST]", "/INST]", "<</SYS>>", "a", "\n", "SYS>>"])

    @settings(max_examples=300, database=None)
    @given(st.lists(part, max_size=12).map("".join))
    def collect(s):
        found.append(s)
    collect()
    df = spark.createDataFrame([(s,) for s in found], "s string").select(
        "s", chat_format.escape("s").alias("e")).select("s", "e", chat_format.unescape("e").alias("u"))
    for r in df.collect():
        assert r["u"] == r["s"]
        assert not any(m in r["e"] for m in ("<s>", "</s>", "[INST]", "[/INST]", "<|im_end|>"))
