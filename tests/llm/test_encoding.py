from __future__ import annotations

import re

import pytest

encoding = pytest.importorskip("siftwire.llm.encoding")

CLEAN = [
    "Le crédit à la consommation a progressé de 17,0 % en été.", "Yeni kurallara göre küçük krediler için müşterinin şubeye gelmesi gerekiyor; üçü öldü.",
    "Für Kleinkredite müssen Kunden persönlich erscheinen, heißt es.", "وقسمت السندات إلى ثلاث شرائح، لمدد ٥٢ و٣١ شهرا.", "سود خالص به ۶٬۱۱۸ میلیون رسید، چشم‌انداز خوب است.",
    "The study drew on São Tirsolo, Ørbyvik and Ångamala.", "L'étude cite SÃO TIRSOLO et la société CÂBLES D'ÂMELIN.", "capital call ½ 21 °C m²", "ماذا بعد؟؟؟ نعم", "What now??? Really?", "see https://n.example/a?id=7&b=c", None, "", "   ",
]
WRONG = [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp850"), ("utf-8", "mac_roman")]


def misread(t, written, read):
    out = []
    for b in t.encode(written):
        try:
            out.append(bytes([b]).decode(read))
        except UnicodeDecodeError:
            out.append(chr(b))
    return "".join(out)


@pytest.mark.parametrize("text", CLEAN)
def test_clean_text_stays(text):
    assert encoding.repair(text) == (text, False)


@pytest.mark.parametrize("written, read", WRONG)
@pytest.mark.parametrize("text", [CLEAN[0], CLEAN[1], CLEAN[2], CLEAN[3], "The firm’s “final” terms – £5"])
def test_multibyte_is_restored(text, written, read):
    assert encoding.repair(misread(text, written, read)) == (text, True)


def test_twice_and_in_part():
    twice = misread(misread(CLEAN[3], "utf-8", "cp1252"), "utf-8", "cp1252")
    assert encoding.repair(twice) == (CLEAN[3], True)
    half = CLEAN[3] + "\n" + misread(CLEAN[3], "utf-8", "latin-1")
    assert encoding.repair(half) == (CLEAN[3] + "\n" + CLEAN[3], True)


@pytest.mark.parametrize("written, read", [("cp1256", "cp1252"), ("iso8859-6", "latin-1")])
def test_single_byte_arabic(written, read):
    t = "مجلس إدارة البنك يقر زيادة رأس المال"
    assert encoding.repair(misread(t, written, read)) == (t, True)


def test_single_byte_latin():
    assert encoding.repair("ortaklýðý görüþüyor, þubesi için") == ("ortaklığı görüşüyor, şubesi için", True)
    assert encoding.repair("Les commerþants prÚvoient une hausse de la dÚpense")[0].startswith("Les commerçants prévoient")


def test_lost_text_is_found():
    for t in ("L�accord a �t� sign�", "????? ???????? ??? ???? ??????", "d?penses arr?t?es"):
        assert encoding.repair(t)[1]


def test_fields(spark):
    df = spark.createDataFrame([("a", "CrÃ©dit", None, 1), ("a", "CrÃ©dit", None, 1), ("b", "Crédit", "x" * 200_000 + "â€™s", 2), (None, "Ã©", "Ã©", 3), ("c", None, "", 4)], "id string, title string, content string, field int")
    got = {(r.article_id, r.field, r.restored[-8:]) for r in encoding.garbled_fields(df).collect()}
    assert got == {("a", "title", "Crédit"), ("b", "content", "xxxxxx’s")}
    assert encoding.garbled_fields(df.limit(0)).count() == 0


CYRILLIC, HAN, KANA, HANGUL = "Центральный банк повысил ключевую ставку до двадцати процентов.", "中国人民银行今天宣布下调利率，这是今年以来的第二次。", "日本銀行は今日、政策金利を引き上げると発表しました。", "한국은행은 오늘 기준금리를 인상한다고 발표했다."


@pytest.mark.parametrize("text, written, read", [(HAN, "gbk", "latin-1"), (HAN, "gbk", "cp1252"), (KANA, "shift_jis", "latin-1"), (CYRILLIC, "koi8-r", "cp1251"), (CYRILLIC, "koi8-r", "latin-1"), (CYRILLIC, "cp1251", "latin-1"), (CYRILLIC, "utf-8", "gb18030")])
def test_other_scripts(text, written, read):
    wrong = text.encode(written).decode(read, "replace")
    fixed, bad = encoding.repair(wrong)
    assert bad and fixed.replace(" ", "")[:30] == text.replace(" ", "")[:30]
    assert re.search(encoding.SUSPECT.replace("\\\\", "\\"), wrong)


@pytest.mark.parametrize("text", [CYRILLIC, HAN, KANA, HANGUL, "日本銀行は", "Çok güzel öğretmenler ığdır", "Les élèves français « été à Évian »", "Größe, Füße, Übermaß"])
def test_clean_text_stays(text):
    assert encoding.repair(text) == (text, False)


@pytest.mark.parametrize("times", [1, 2, 4, 6])
def test_text_read_wrongly_many_times(times):
    text = wrong = "Société Générale – l’été à Paris"
    for _ in range(times):
        wrong = wrong.encode("utf-8").decode("latin-1")
    assert encoding.repair(wrong) == (text, True)


@pytest.mark.parametrize("wrong", ["ï»¿Board approves", "ï¼¡ï¼¢", "kar≈üƒ± alƒ±m", "l?économie a crû", "¬´Board¬ª"])
def test_what_is_repaired_is_also_searched(wrong):
    assert not encoding.repair(wrong)[1] or re.search(encoding.SUSPECT.replace("\\\\", "\\"), wrong)
