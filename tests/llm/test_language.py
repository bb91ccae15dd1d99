from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

language = pytest.importorskip("siftwire.llm.language")

TEXT = {
    "en": "the bank said on monday that it had completed a deal worth millions and analysts expect demand to rise before the end of june",
    "fr": "la banque a annoncé lundi avoir conclu une opération de plusieurs millions et les analystes prévoient une hausse de la demande avant la fin de juin",
    "de": "die bank hat am montag nach eigenen angaben ein geschäft über millionen abgeschlossen und analysten rechnen bis ende juni mit mehr nachfrage",
    "tr": "banka pazartesi günü milyonlarca liralık bir işlemi tamamladığını açıkladı ve analistler talebin haziran sonuna kadar artmasını bekliyor",
    "ar": "أعلن البنك يوم الاثنين إتمام صفقة بملايين الجنيهات ويتوقع المحللون ارتفاع الطلب قبل نهاية يونيو",
    "fa": "بانک روز دوشنبه اعلام کرد معامله‌ای میلیونی را به پایان رسانده است و تحلیلگران انتظار دارند تقاضا تا پایان ژوئن بیشتر شود",
}
LABEL = {"en": ["en", "English", "en-GB", "eng"], "fr": ["fr", "French", "fra"], "de": ["de", "German"], "tr": ["tr", "TUR"], "ar": ["ar", "عربي", "ar-EG"], "fa": ["fa", "Persian"]}


def line(lang, r):
    w = TEXT[lang].split()
    at = r.randrange(len(w) - 8)
    return " ".join(w[at : at + 8]) + "."


@pytest.fixture(scope="module")
def rows():
    r = random.Random(2)
    return [(f"{k}{i}", LABEL[k][i % len(LABEL[k])], "\n".join(line(k, r) for _ in range(4))) for k in TEXT for i in range(20)]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "clash", 9) for x in rows], "id string, language string, content string, label string, line_no int")


def test_wrong_labels_and_foreign_lines(spark, rows):
    r = random.Random(3)
    extra = [
        ("w1", "fr", "\n".join(line("en", r) for _ in range(4)), {(0, "en")}), ("w2", None, "\n".join(line("fa", r) for _ in range(4)), {(0, "fa")}),
        ("w3", "unknown", line("de", r), {(0, "de")}), ("w4", "ur", "\n".join(line("ar", r) for _ in range(3)), {(0, "ar")}),
        ("m1", "en", "\n".join([line("en", r), line("en", r), TEXT["fr"] + ".", *[line("en", r) for _ in range(4)]]), {(3, "fr")}),
        ("m2", "ar", "\n".join([line("ar", r), line("ar", r), TEXT["en"] + ".", *[line("ar", r) for _ in range(4)]]), {(3, "en")}),
        ("n1", "", "", set()), ("n2", None, None, set()), ("n3", None, "123 456", set()), ("q1", "en", "\n".join([line("en", r), "The bank « une opération » said that it had completed a deal on monday.", line("en", r)]), set()),
    ]
    got = {}
    for x in language.mislabelled(frame(spark, rows + [e[:3] for e in extra] + [extra[0][:3]])).collect():
        got.setdefault(x.article_id, set()).add((x.line_no, x.lang))
    assert {e[0]: got.get(e[0], set()) for e in extra} == {e[0]: e[3] for e in extra}
    assert sum(1 for k in got if k[:2] in TEXT) == 0


def test_confidence(spark, rows):
    s = language.segments(frame(spark, rows)).collect()
    assert all(0 <= x.confidence <= 1 for x in s) and sum(x.confidence > 0.9 for x in s) > 0.9 * len(s)


def test_empty(spark):
    assert language.segments(frame(spark, [])).count() == 0


def test_code_lengths_are_probabilities():
    t = language.Tree()
    for w in (b"the", b"then", b"that"):
        t.add(w, 3)
    tree = t.freeze()
    assert language.code_length(tree, b"the") < language.code_length(tree, b"xyz")
    # In every context, the seen bytes and the escape share the whole probability.
    for escape, seen in tree.values():
        assert abs(2**-escape + sum(2**-b for b in seen.values()) - 1) < 1e-9


def test_labels(spark):
    df = spark.createDataFrame([(x,) for x in ("EN", "en_GB", "English", "عربي", "xx", "", None, "fr-FR")], "l string")
    assert [r[0] for r in df.select(language.label_language(F.col("l"))).collect()] == ["en", "en", "en", "ar", None, None, None, "fr"]


def test_words_are_read_whole_and_weigh_exactly():
    tree = language.Tree()
    tree.add(b"abc" * 50, 70)
    frozen = tree.freeze()
    scorer = language.Scorer({"en": frozen, "de": language.Tree().freeze()})
    word = "abc" * 50
    exact = [language.code_length(frozen, word.encode()), language.code_length({}, word.encode())]
    assert scorer.word(word).tolist() == [0.0, exact[1] - exact[0]] and exact[1] == 8 * 151


def test_texts_of_lost_letters_have_no_language():
    assert language.damaged("???? ??????? Matanin Credit ?? ??????? ??? ???????") and not language.damaged("Why? Who knows?") and not language.damaged("")
