import random

import pytest
from pyspark.sql import functions as F

from cuecraft.llm import garbled, langid, linking, mixing, pairs, splitting, tokens
from cuecraft.llm.sentences import sentences, spans

HAVE_TOKENIZER = __import__("os").path.exists(tokens.vocabulary())
needs_tokenizer = pytest.mark.skipif(not HAVE_TOKENIZER, reason="no tokenizer files")


def units(text):
    return [text[a:b] for a, b in spans(text)]


@pytest.mark.parametrize(("text", "expected"), [
    ("Dr. A met Mr. B at 3 p.m. Then they left.", ["Dr. A met Mr. B at 3 p.m.", "Then they left."]),
    ('She said, "Let it be. Now," and left. Ok!', ['She said, "Let it be. Now," and left.', "Ok!"]),
    ("Er schrieb „Ist sie offen? Nein!“ neben x und ging. Die 1. und 2. Ableitung, z. B. hier.", ["Er schrieb „Ist sie offen? Nein!“ neben x und ging.", "Die 1. und 2. Ableitung, z. B. hier."]),
    ("Die Übung fällt aus am 7. 5. Am 4. Mai war sie im 10. Kapitel.", ["Die Übung fällt aus am 7. 5.", "Am 4. Mai war sie im 10. Kapitel."]),
    ("The rate is 3.14. J. K. Velmar agrees, cf. Fig. 3. And the choice of A. The end.", ["The rate is 3.14.", "J. K. Velmar agrees, cf. Fig. 3.", "And the choice of A.", "The end."]),
    ("¿Y si no existe?, preguntó la Dra. Ruiz. «Es cerrado. También.»", ["¿Y si no existe?, preguntó la Dra. Ruiz.", "«Es cerrado. También.»"]),
    ("老师说：“它是闭的。它也有界。”然后继续讲。“这是什么？”没有人说话。", ["老师说：“它是闭的。它也有界。”然后继续讲。", "“这是什么？”", "没有人说话。"]),
    ("先生は「閉じています。」と言った。「何ですか？」次です．", ["先生は「閉じています。」と言った。", "「何ですか？」", "次です．"]),
    ("มีทั้งหมด 29 กรณี ถ้าลำดับมีขอบเขต", ["มีทั้งหมด 29 กรณี", "ถ้าลำดับมีขอบเขต"]),
    ("यह बंद है। वह नहीं?", ["यह बंद है।", "वह नहीं?"]),
    ("لماذا؟ هذا مغلق.", ["لماذا؟", "هذا مغلق."]),
    ("Then\nwe stop.\n4. Variance\n\nA first. \n- One\n- Two. Three\n\nEnd", ["Then\nwe stop.", "4. Variance", "A first.", "- One", "- Two. Three", "End"]),
    ("Well... the end is near... Yes.", ["Well... the end is near...", "Yes."]),
    ("computed.Take it, see a.b.com/x.html now.", ["computed.", "Take it, see a.b.com/x.html now."]),
    ("", []), (" \n\xa0", []), ("34)+=(", ["34)+=("]), (None, []),
])
def test_sentences(text, expected):
    assert units(text) == expected


def test_units_cover_all_but_white_space():
    rng = random.Random(1)
    alphabet = list('ab C.?!…"“”„«»()（）。，、！「」\n\r\t -–—*1๙กข 7:;\'’') + ["Dr. ", "e.g. ", "\r\n\r\n", "1. ", "z. B. ", "मै।", " "]
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(0, 60)))
        found = spans(text)
        assert all(a < b and text[a:b] == text[a:b].strip() for a, b in found) and all(x[1] <= y[0] for x, y in zip(found, found[1:]))
        rest = list(text)
        for a, b in found:
            rest[a:b] = " " * (b - a)
        assert not "".join(rest).strip()


def test_very_long_texts_are_cut_in_linear_time():
    assert len(spans("The norm is closed. " * 20_000)) == 20_000
    assert len(spans("(" * 30_000 + "x")) == 1 and len(spans("x" * 200_000)) == 1 and len(spans('"' * 20_000)) >= 1


def test_sentences_table(spark):
    df = spark.createDataFrame([(1, "A b. C d.", 9), (1, "A b. C d.", 9), (2, None, 1), (3, "", 1)], "chunk_id bigint, text string, starts int")
    assert sorted(map(tuple, sentences(df, "chunk_id", "text").collect())) == [(1, 0, 4), (1, 5, 9)]
    assert sentences(df.limit(0), "chunk_id", "text").count() == 0
    assert {r["sentence"] for r in sentences(df, "chunk_id", "text", True).collect()} == {"A b.", "C d."}


def test_pieces_keep_all_their_promises():
    rng = random.Random(2)
    for _ in range(400):
        text = "".join(rng.choice(["word ", "x" * rng.randrange(1, 40), ". New ", "\n\n", ", ", "。", "é"]) for _ in range(rng.randrange(1, 120)))
        low, high, overlap = rng.choice([(20, 60, 10), (0, 30, 0), (50, 50, 5), (10, 200, 40), (5, 9, 100)])
        found = splitting.pieces(text, low, high, overlap)
        real = min(overlap, high // 2) if len(text) > high else 0
        assert all(0 < b - a <= high for a, b in found)
        assert found[0][0] == 0 and found[-1][1] == len(text)
        assert all(y[0] == max(0, x[1] - real) for x, y in zip(found, found[1:]))


def test_pieces_cut_at_natural_boundaries():
    text = "One two three. " * 4 + "\n\n" + "Four five six. " * 4
    found = splitting.pieces(text, 10, 70, 0)
    assert text[found[0][0] : found[0][1]].strip().endswith("three.") and all(text[a:b].strip().endswith(".") for a, b in found)


def test_splitting_table(spark):
    chunks = spark.createDataFrame([(1, "word " * 100, 7, "c"), (1, "word " * 100, 7, "c"), (2, "short", 7, "c"), (3, None, None, "c"), (4, "y" * 851, None, "c"), (5, "z" * 900, 99, "c")], "chunk_id bigint, text string, request_id bigint, max_chunk_size string")
    req = spark.createDataFrame([(7, 20, 60, True, 10), (7, 20, 60, True, 10), (8, 9, 3, None, None)], "request_id bigint, min_chunk_size int, max_chunk_size int, overlap boolean, overlap_chars int")
    rows = splitting.split_oversized(chunks, req).collect()
    assert {r["chunk_id"] for r in rows} == {1, 4, 5}
    one = sorted((r["piece_no"], r["piece"]) for r in rows if r["chunk_id"] == 1)
    assert all(len(p) <= 60 for _, p in one) and all(b[1].startswith(a[1][-10:]) for a, b in zip(one, one[1:]))
    assert splitting.split_oversized(chunks.limit(0), req).count() == 0
    assert {r["chunk_id"] for r in splitting.split_oversized(chunks, req.limit(0)).collect()} == {4, 5}


ENTITIES = [("spectral operator", "e1", "A"), ("spectral operator", "e2", "B"), ("compact kernel", "e3", "A"), ("beschränkte hülle", "e4", "A"), ("CKN", "e3", "A"), ("convex kernel", "e5", "A")]


@pytest.mark.parametrize(("text", "label", "expected"), [
    ("Spectral Operator", "b", "e2"), ("spectral operator", None, "e1"), ("kernel (compact)", "A", "e3"), ("kernels, compact", "A", "e3"), ("the compactkernel", "A", "e3"),
    ("$\\mathrm{compact_kernel}$", "A", "e3"), ("ｃｏｍｐａｃｔ ｋｅｒｎｅｌ", "A", "e3"), ("соmрасt kеrnеl", "A", "e3"), ("comp. kernel", "A", "e3"), ("beschraenkte huelle", "A", "e4"), ("ckn", "A", "e3"),
    ("spectral kernel", "A", "UNMATCHED"), ("kernel", "A", "UNMATCHED"), ("compact convex kernel", "A", "UNMATCHED"), ("homework", "A", "UNMATCHED"), ("12", "A", "UNMATCHED"), ("...", "A", "UNMATCHED"),
    (" ", "A", None), (None, "A", None), ("x" * 5000, "A", "UNMATCHED"), ("conv3x kernal", "A", "e5"),
])
def test_linking(text, label, expected):
    assert linking.Matcher(ENTITIES).link(text, label) == expected


def test_linking_table(spark):
    ent = spark.createDataFrame([("e1", "compact kernel", "A", [("CKN", "A")]), ("e2", "open ball", "B", None)], "entity_id string, name string, label string, entity_instances array<struct<text string, label string>>")
    men = spark.createDataFrame([(1, "ckn", None, 1), (1, "ckn", None, 1), (2, None, "A", 1), (3, "opem ball", "A", 1)], "seq bigint, text string, label string, entity_id int")
    assert sorted(map(tuple, linking.link(men, ent).collect())) == [(1, "e1"), (3, "e2")]
    assert {r["entity_id"] for r in linking.link(men, ent.limit(0)).collect()} == {"UNMATCHED"} and linking.link(men.limit(0), ent).count() == 0


def test_distance_against_a_plain_table():
    rng = random.Random(5)

    def plain(a, b):
        d = {(i, j): i + j if not i * j else 0 for i in range(len(a) + 1) for j in range(len(b) + 1)}
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
                if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                    d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
        return d[len(a), len(b)]

    for _ in range(600):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 8))) for _ in range(2))
        assert linking.distance(a, b, 3) == min(plain(a, b), 4)


PROSE = {
    "en": "We look at the kernel and the norm of the space, because they will be needed in the proof. Nobody claims that it has to be unique. ",
    "de": "Wir schauen uns den Kern und die Norm des Raumes an, weil wir sie für den Beweis brauchen. Niemand behauptet, dass er eindeutig ist. ",
    "fr": "Nous regardons le noyau et la norme de l'espace, car ils seront utiles dans la démonstration. Personne ne prétend que c'est unique. ",
    "es": "Miramos el núcleo y la norma del espacio, porque harán falta en la demostración. Nadie dice que tenga que ser único, ¿verdad? ",
    "it": "Guardiamo il nucleo e la norma dello spazio, perché serviranno nella dimostrazione. Nessuno dice che debba essere unico, però. ",
    "ru": "Мы рассмотрим ядро и норму пространства, потому что они понадобятся в доказательстве. Никто не утверждает, что это единственный ответ. ",
    "zh": "今天我们来看一下核与范数，因为后面的证明里要用到它们。没有人说它必须是唯一的。",
    "ja": "今日は核とノルムについて考えてみましょう。証明で使うからです。一意であるとは誰も言っていません。",
}


@pytest.fixture(scope="module")
def models():
    ends = pairs.EndModel.train([p.strip() for p in PROSE.values()] * 5 + ["Yes.", "Never"] * 3)
    return ends, pairs.LanguageModel.train([(t * 3, lang) for lang, t in PROSE.items()])


@pytest.mark.parametrize(("question", "answer", "expected"), [
    ("Why is it unique?", None, "empty"), ("Why?", " ​", "empty"), ("Why?", "n/a", "empty"), ("Why?", '{"answer": ""}', "empty"), ("Why?", "```\n```", "empty"), ("Why?", "Answer:", "empty"),
    ("Why is the kernel closed?", "why is teh kernel closed", "copy"), ("Why is the kernel closed?", "Your question was: Why is the kernel closed?", "copy"),
    ("Why is it so?", "I'm sorry, but I can't help with that.", "refusal"), ("Warum?", "Dazu möchte ich mich nicht äußern.", "refusal"), ("Pourquoi ?", "Je suis désolé, je ne peux pas répondre à cette question.", "refusal"),
    ("Why is it so?", "We look at the kernel and the no", "truncated"), ("Why?", '{"answer": "We look', "truncated"), ("Why?", "```\nfor i in range(", "truncated"), ("Why?", "We see that $a_{1", "truncated"),
    ("Why is the norm of the space needed in the proof?", PROSE["de"].strip(), "language"), ("Why is the norm of the space needed in the proof? (answer in German)", PROSE["de"].strip(), None),
    ("Why is the norm of the space needed in the proof?", PROSE["en"].strip(), None), ("Why is it so?", "Yes.", None), ("Why?", "$a+b$", None), ("Why?", "52", None), (None, PROSE["de"].strip(), None),
    ("Why?", "I am sorry to say that the norm is not unique.", None), ("Why?", "We cannot help ourselves and divide by zero here.", None), ("Why is it?", '{"answer": "We look at the kernel and the norm of the space."}', None),
])
def test_defects(models, question, answer, expected):
    assert pairs.defect(question, answer, *models) == expected


def test_defects_table(spark):
    labelled = spark.createDataFrame([(t, lang) for lang, t in PROSE.items()] + [(None, "en"), ("x", None)], "text string, lang string")
    log = spark.createDataFrame([(1, "Why?", None, 0.9), (1, "Why?", None, 0.9), (2, None, "Yes.", None)], "ask_id bigint, question string, answer string, defect double")
    assert [tuple(r) for r in pairs.find_defects(log, labelled).collect()] == [(1, "empty")]
    assert pairs.find_defects(log.limit(0), labelled.limit(0)).count() == 0


def test_suffix_automaton_gives_greedy_longest_phrases():
    import numpy as np

    rng = random.Random(7)
    for _ in range(60):
        sources = [[rng.randrange(1, 4) for _ in range(rng.randrange(3, 40))] for _ in range(2)]
        table = langid.suffix_automaton(np.array([*sources[0], 0, *sources[1]]), 4)
        words = {tuple(s[i:j]) for s in sources for i in range(len(s)) for j in range(i + 1, len(s) + 1)}
        for _ in range(30):
            w = tuple(rng.randrange(1, 4) for _ in range(rng.randrange(1, 7)))
            state = 1
            for c in w:
                state = table[state, c] if state else 0
            assert bool(state) == (w in words)


def test_languages_and_segments():
    model = langid.Identifier.train([(t * 2, lang) for lang, t in PROSE.items()] * 3)
    texts = [PROSE["en"], PROSE["de"] * 2 + PROSE["en"] * 2, "$a+b$", "", PROSE["ru"], PROSE["zh"], PROSE["ja"] + PROSE["zh"], "4. Kernel\n\n" + PROSE["de"] * 2]
    assert [[s[0] for s in x] for x in model.identify(texts)] == [["en"], ["de", "en"], [], [], ["ru"], ["zh"], ["ja", "zh"], ["de"]]
    assert all(0 <= s[3] <= 1 for x in model.identify(texts) for s in x)
    assert [langid.label_language(x) for x in ("en-US", "Deutsch", "zho", "und", "n/a", " ", None, "PT-br")] == ["en", "de", "zh", None, None, None, None, "pt"]


def test_languages_table(spark):
    rows = [(1, PROSE["en"], "de"), (1, PROSE["en"], "de"), (2, PROSE["de"], "DE"), (3, None, "en"), (4, PROSE["ru"], None), (5, "12+3", None)] + [(100 + i, t, lang) for i, (lang, t) in enumerate(PROSE.items())]
    df = spark.createDataFrame(rows, "chunk_id bigint, text string, lang string").withColumn("seg_no", F.lit("x"))
    taught = spark.createDataFrame([(t, lang) for lang, t in PROSE.items()], "text string, lang string")
    found = langid.identify(df, "chunk_id", "text", "lang", taught, only_cases=True).select("chunk_id", "seg_no", "lang").collect()
    assert sorted(map(tuple, found)) == [(1, 0, "en"), (4, 0, "ru")]
    assert langid.identify(df.limit(0), "chunk_id", "text", "lang").count() == 0


@needs_tokenizer
def test_tokens_round_trip(spark):
    texts = ["", None, "Hello  world\n", "naïve 🙂👍🏽 日本語 ไทย", "<|endoftext|> is text", "x" * 50_000, "\u0000퟿﻿"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit(1))
    rows = {r["doc_id"]: r for r in tokens.encode(df, "doc_id", "text", spans=True).collect()}
    assert rows[0]["ids"] == rows[1]["ids"] == [] and 50256 not in rows[4]["ids"]
    assert all(0 <= a <= b <= len(texts[3]) for a, b in zip(rows[3]["starts"], rows[3]["ends"]))
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, "doc_id", "text"), "doc_id", "ids").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert tokens.encode(df.limit(0), "doc_id", "text").count() == 0 and len(tokens.byte_of_character()) == 256


def test_mixing(spark):
    rng = random.Random(8)
    sizes = spark.createDataFrame([(i, "big" if i < 1500 else "small" if i < 1560 else None if i == 1560 else "mid", 0 if i % 50 == 0 else rng.randrange(5, 400)) for i in range(2000)], "doc_id bigint, source string, n_tokens int")
    plan = spark.createDataFrame([("m", " Big ", 6.0, 1, 0.3), ("m", "big", 6.0, 1, 0.3), ("m", "SMALL", 2.0, 3, 0.3), ("m", "mid", 2.0, 2, 0.3), ("m", "none", 5.0, 2, 0.3), ("m", "zero", 0.0, 2, 0.3)], "mix_id string, source string, target_weight double, max_repeats int, budget_frac double")
    rows = {r["source"]: r for r in mixing.report(plan, sizes).collect()}
    assert set(rows) == {"big", "small", "mid", "none"}
    for name, share in (("big", 0.6), ("small", 0.2), ("mid", 0.2), ("none", 0.0)):
        assert abs(rows[name]["target_share"] - share) < 1e-9 and abs(rows[name]["actual_share"] - share) < 0.03
        assert rows[name]["most_copies"] <= rows[name]["max_repeats"]
    assert 0 < rows["big"]["budget_used"] <= 1.03
    # Four fifths of all tokens are more than the small source can share in.
    large = plan.withColumn("budget_frac", F.lit(0.8))
    shrunk, filled = ({r["source"]: r for r in mixing.report(large, sizes, how).collect()} for how in ("shrink", "fill"))
    assert abs(shrunk["small"]["actual_share"] - 0.2) < 0.03 and shrunk["small"]["budget_used"] < 0.9
    assert filled["small"]["actual_share"] < 0.17 and filled["small"]["most_copies"] == 3 and filled["big"]["budget_used"] > shrunk["big"]["budget_used"]
    picked = mixing.sample(sizes, mixing.shares(plan, sizes)).collect()
    assert len({(r["mix_id"], r["doc_id"]) for r in picked}) == len(picked) and all(r["copies"] > 0 and r["n_tokens"] > 0 for r in picked)
    assert mixing.report(plan, sizes.limit(0)).count() == 4 and mixing.report(plan.limit(0), sizes).count() == 0


@pytest.fixture(scope="module")
def classifier():
    from collections import Counter

    words = Counter()
    for t in PROSE.values():
        for w in garbled._words(t * 1):
            words[w] += 20
    return garbled.Classifier.train(words)


@pytest.mark.parametrize("chain", [c for c in garbled.CHAINS if c[0][0] == "utf-8" and c[0][1] in ("latin-1", "cp1252", "cp437", "mac-roman", "cp1251")])
def test_garbled_words_come_back(classifier, chain):
    for word in ("für", "démonstration", "понадобятся"):
        bad = garbled.garble(word, chain)
        assert bad is not None
        name, before, _ = classifier.judge(bad)
        assert name != garbled.SOUND
        if garbled.invert(bad, chain) is not None:
            assert before == word


@pytest.mark.parametrize("word", ["für", "ÂGE", "SÃO", "√2", "├──", "naïve", "🙂", "日本", "&auml;", "Ã", "C++-", "a+b-c"])
def test_sound_words_stay(classifier, word):
    assert classifier.judge(word)[0] == garbled.SOUND


def test_garbled_table(spark):
    text = PROSE["de"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*PROSE.values()] * 4)] + [(100, garbled.garble(text, garbled.CHAINS[0])), (101, text.replace("ü", "�")), (102, None), (103, ""), (104, "plain")], "doc_id bigint, text string")
    docs = docs.unionByName(docs.where("doc_id = 100")).withColumn("passages", F.lit("x"))
    rows = {r["doc_id"]: r for r in garbled.find_garbled(docs, "doc_id", "text").collect()}
    assert set(rows) == {100, 101} and rows[100]["restored_text"] == text and rows[100]["whole"] and not rows[101]["whole"]
    assert garbled.find_garbled(docs.limit(0), "doc_id", "text").count() == 0


def test_garbled_words_are_counted_in_all_texts(spark):
    """The word that speaks for the restored form is in texts beyond the sample that trains the classifier."""
    hashed = F.pmod(F.xxhash64("text"), F.lit(1 << 30))
    made = spark.createDataFrame([(i, f"{PROSE['de']} {i} Größenmaßstäbe") for i in range(60)], "doc_id bigint, text string")
    beyond = made.where(hashed > (1 << 29)).limit(10)
    plain = spark.createDataFrame([(100 + i, f"{t} {i}") for i, t in enumerate([*PROSE.values()] * 12)], "doc_id bigint, text string")
    docs = spark.createDataFrame(beyond.unionByName(plain).collect(), "doc_id bigint, text string")
    counts = garbled.training_words(docs, "text", docs.count() // 2)
    assert "Größenmaßstäbe" not in counts
    held = spark.sparkContext.broadcast((garbled.Classifier.train(counts).weights, {}, 1.0, 1))
    found = {r["w"]: r["n"] for r in garbled.word_counts(docs.select("text"), held).collect()}
    assert found["Größenmaßstäbe"] == 10


def test_rules_are_relative_to_the_corpus(classifier):
    word, bad = "für", "für".encode("cp1252").decode("cp850")
    small = garbled.Classifier(classifier.weights, {word: 3, bad: 1}, 1.0, 1)
    large = garbled.Classifier(classifier.weights, {word: 300, bad: 100}, 100.0, 1)
    one = garbled.Classifier(classifier.weights, {word: 3, bad: 1}, 100.0, 1)
    assert small.judge(bad)[:2] == large.judge(bad)[:2] != one.judge(bad)[:2]
    assert {word, bad} <= small.lookups(bad) and not small.lookups("plain")


def test_long_runs_are_inverted_as_wholes(classifier):
    text = "今日は核とノルムについて考えてみましょう" * 40
    bad = garbled.garble(text, garbled.CHAINS[0])
    assert garbled.invert(bad, garbled.CHAINS[0]) == text and len(bad) > 2_000
    assert [(a, b, before) for a, b, _, before, _ in classifier.passages(bad)] == [(0, len(bad), text)]
    # A run that breaks in one place is restored up to the stretch of the break.
    broken = bad[:1500] + "\u0081\u0152" + bad[1500:]
    found = classifier.passages(broken)
    assert sum(b - a for a, b, _, before, _ in found if before is not None) > len(bad) - 1_200
    assert len(garbled.features("é" * 5_000)) > 9_000


def test_ends_are_counted_in_all_answers(spark):
    made = [(i, f"Question {i}?", f"{PROSE['en']} number {i}\nIt is a norm") for i in range(40)] + [(100 + i, f"Question {i}?", f"It holds {i}: It is a norm.") for i in range(40)]
    log = spark.createDataFrame(made, "ask_id bigint, question string, answer string")
    labelled = spark.createDataFrame([(t, lang) for lang, t in PROSE.items()], "text string, lang string")
    counts = {r["gram"]: (r["total"], r["ends"]) for r in pairs.end_counts(log.select("answer")).collect()}
    ends = pairs.EndModel.train([a for _, _, a in made])
    assert counts == {g: (n, ends.at_end[g]) for g, n in ends.anywhere.items()}
    # However few rows the languages are learned from, the same answers break off.
    few, all_rows = (sorted(map(tuple, pairs.find_defects(log, labelled, rows=n).collect())) for n in (4, 8_000))
    assert few == all_rows


def test_an_end_counts_without_the_answer_itself(spark):
    own = [{"g": "m", "t": 2, "e": 1}]
    asked = spark.createDataFrame([(__import__("json").dumps(own),), (__import__("json").dumps([own[0] | {"t": 0, "e": 0}]),)], "asked string")
    counts = spark.createDataFrame([("m", 2, 1)], "gram string, total bigint, ends bigint")
    assert sorted(r["unlikely"] for r in pairs.unlikely_ends(asked, counts).collect()) == [False, True]


@pytest.mark.parametrize("text", [
    "Keep this in mind. We continue now.", "The cat sat. It slept.", "We walk in the sun. It is warm.", "This is modern art. It is fine.", "Open the tab. Then close it.", "He wore a cap. It was red.",
    "Wir brauchen es. Dann gehen wir.", "Er ist da. Wir gehen.", "De fles is vol. Daarna gaan we.",
])
def test_abbreviations_of_other_languages_are_words(text):
    cut = text.index(". ") + 1
    assert spans(text) == [(0, cut), (cut + 1, len(text))]


@pytest.mark.parametrize("text", ["Wir sehen die Reihe inkl. Rand und den Kern.", "We met Gen. Brown and Dr. Smith in Jan. 2020.", "O valor está na pág. 5, cf. fig. 3."])
def test_abbreviations_of_the_language_go_on(text):
    assert spans(text) == [(0, len(text))]


@pytest.mark.parametrize("text", ["Բարև։ Ինչպես ես։", "བོད་ཡིག། གཉིས་པ།", "ܫܠܡܐ܀ ܬܪܝܢ܀", "ߒ ߓߊ߹ ߞߋ߹", "यह है। वह है।"])
def test_terminators_of_all_scripts(text):
    assert len(spans(text)) == 2


def test_units_do_not_depend_on_length():
    quoted = 'He said: "' + "This is one. " * 400 + 'That was it," and left.'
    assert spans(quoted + " Then more.") == [(0, len(quoted)), (len(quoted) + 1, len(quoted) + 11)]
    heading = "# " + "very " * 60 + "long"
    assert spans(heading + "\n\nText here.")[0] == (0, len(heading))
    assert len(spans("x. " + "+-" * 600 + "\n\nText.")) == 3 and len(spans("-" * 900 + "\nText here.")) == 2
    assert len(spans("(" * 20_000 + "a")) == 1 and len(spans('"a ' * 5_000)) == 1


def test_long_questions_given_back_are_copies():
    words = [f"word{i}" for i in range(300)]
    changed = [w + "x" if i % 20 == 0 else w for i, w in enumerate(words)]
    assert pairs.is_copy(" ".join(words) + "?", " ".join(changed))
    assert not pairs.is_copy(" ".join(words) + "?", " ".join(reversed(changed)))
    assert not pairs.is_copy(" ".join(words), " ".join(words[:200] + [f"other{i}" for i in range(100)]))


def test_banded_alignment_is_the_whole_one():
    def whole(a, q):
        row = [0] * (len(q) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(q, 1):
                last, row[j] = row[j], last + 1 if pairs._alike(x, y) else max(row[j], row[j - 1])
        return bool(q) and 0.8 <= len(a) / len(q) <= 1.25 and row[-1] >= 0.85 * max(len(a), len(q))

    rng = random.Random(3)
    for _ in range(400):
        q = [rng.choice("abcdefgh") * 4 for _ in range(rng.randrange(1, 30))]
        a = [w for w in q if rng.random() > 0.08]
        for _ in range(rng.randrange(0, 4)):
            a.insert(rng.randrange(len(a) + 1), rng.choice("abcdefgh") * 4)
        assert pairs._given_back(a, q) == whole(a, q), (a, q)


def test_hashed_end_counts_are_those_of_strings():
    from collections import Counter

    texts = ["It is a norm.", "aaaa", "x", "日本 is 12.", "It is a norm"]
    anywhere, at_end = Counter(), Counter()
    for t in texts:
        s = pairs.EndModel.shape(t)
        for n in range(1, 7):
            grams = [s[i : i + n] for i in range(len(s) - n + 1)]
            anywhere.update(grams)
            if grams and pairs.EndModel.ended(t, s):
                at_end[grams[-1]] += 1
    model = pairs.EndModel.train(texts)
    assert sorted(model.anywhere.values()) == sorted(anywhere.values()) and sorted(model.at_end.values()) == sorted(at_end.values())
    for t in texts:
        s = pairs.EndModel.shape(t)
        assert [model.anywhere[g] for g in pairs.EndModel.grams(t)] == [anywhere[s[-n:]] for n in range(1, min(6, len(s)) + 1)]


def test_unknown_languages_are_less_sure():
    arabic = "سنرى اليوم لماذا تكون هذه الدالة متصلة ومحدودة في كل فترة مغلقة. ثم نثبت أن المتتالية تتقارب."
    model = langid.Identifier.train([(t * 2, lang) for lang, t in (PROSE | {"ar": arabic}).items()] * 3)
    sure = lambda t: model.identify([t])[0][0]
    ru, uk = sure(PROSE["ru"]), sure("Сьогодні ми розглянемо, чому ця функція є неперервною та обмеженою.")
    ar, fa = sure(arabic), sure("امروز می‌خواهیم ببینیم که چرا این تابع پیوسته و کراندار است.")
    assert (ru[0], ar[0]) == ("ru", "ar") and uk[3] < 0.7 * ru[3] and fa[3] < 0.7 * ar[3]


def test_formulas_are_in_no_language():
    model = langid.Identifier.train([(t * 2, lang) for lang, t in PROSE.items()] * 3)
    found = model.identify([PROSE["de"] + " " + "y+" * 200 + "y", PROSE["en"] + " ((x1+x2+x3)^2) " + PROSE["en"]])
    assert [[s[0] for s in x] for x in found] == [["de"], ["en"]]


@pytest.mark.parametrize("bad, good", [("far.Â\xa0Well", "far.\xa0Well"), ("â€œso", "“so")])
def test_garbled_spaces_and_marks(classifier, bad, good):
    name, before, _ = classifier.judge(bad)
    assert name != garbled.SOUND and before == good


@pytest.mark.parametrize("overlap", [0, 10, 59, 90])
def test_overlaps_are_kept_as_asked(overlap):
    text = " ".join(f"Sentence number {i} is here." for i in range(60))
    found = splitting.pieces(text, 20, 100, overlap)
    assert found[0][0] == 0 and found[-1][1] == len(text) and all(b - a <= 100 for a, b in found)
    assert all(a == end - overlap for (_, end), (a, _) in zip(found, found[1:]))


def test_requests_with_an_impossible_overlap_are_refused(spark):
    req = spark.createDataFrame([(7, 20, 60, True, 60), (8, 20, 60, True, 59), (9, 20, 60, False, 60)], "request_id bigint, min_chunk_size int, max_chunk_size int, overlap boolean, overlap_chars int")
    assert sorted((r["request_id"], r["overlap_chars"]) for r in splitting.settings(req).collect()) == [(8, 59), (9, 0)]


def test_long_misspelt_names_are_linked():
    names = [("strong uniform law of large random numbers theorem", "e1", "THEOREM_RULE"), ("kernel", "e2", "CONCEPT")]
    m = linking.Matcher(names)
    assert m.link("strong uniform law of large random numbrs theorem", None) == "e1" and m.link("strong law of large numbers theorem", None) == linking.UNMATCHED
    assert m.link("x" * 200, None) == linking.UNMATCHED


def test_dirty_inputs_of_pairs_and_languages(spark):
    none = spark.createDataFrame([], "text string, lang string")
    log = spark.createDataFrame([(1, None, None), (3, "q", ""), (4, None, "A fine answer here."), (None, "a", "b")], "ask_id bigint, question string, answer string").withColumn("_k", F.lit(1)).withColumn("defect", F.lit(2))
    assert sorted(map(tuple, pairs.find_defects(log, none).collect())) == [(1, "empty"), (3, "empty")] and pairs.find_defects(log.limit(0), none).count() == 0
    rows = [(1, "x" * 100_000, None), (2, None, "en"), (3, "", "de"), (4, PROSE["en"], "en"), (4, PROSE["en"], "en")]
    found = langid.identify(spark.createDataFrame(rows, "chunk_id bigint, text string, lang string").withColumn("_t", F.lit(1)), "chunk_id", "text", "lang").collect()
    assert [(r["chunk_id"], r["lang"]) for r in found] == [(4, "en")]
