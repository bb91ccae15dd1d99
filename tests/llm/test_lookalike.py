from __future__ import annotations

import pytest

lookalike = pytest.importorskip("siftwire.llm.lookalike")

SAME = [
    ("Board of Bank", "Boаrd of Bаnk"), ("EGP 42", "ＥＧＰ ４２"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b"), ("ab", "a­b"), ("café", "café"),
    ("مجلس إدارة", "ﻣﺠﻠﺲ إدارة"), ("أسهم", "أسهم"), ("توفيجور", "توفیجور"), ("شركة", "شر‏كة"), ("Port Said", "Ροrt Said"), ("credit", "сredіt"),
]
DIFFERENT = [("Bank", "bank"), ("cafe", "café"), ("إلى", "الى"), ("m2", "m²"), ("52", "٥٢"), ("٥٢", "۵۲"), ("إدارة", "إداره"), ("علي", "علی"), ("علي", "على"), ("a\nb", "a b"), ("firm's", "firm’s")]


@pytest.fixture(scope="module")
def lattice():
    text = "board of bank credit port said signs facility for small ticket loans a see access case cosy"
    n: dict = {}
    for w in text.split() * 5:
        for a, b in zip("\0" + w, w + "\0"):
            k = (0 if a == "\0" else ord(a), 0 if b == "\0" else ord(b))
            n[k] = n.get(k, 0) + 1
    return lookalike.Lattice(n)


@pytest.mark.parametrize("a, b", SAME)
def test_same(lattice, a, b):
    assert lattice.form(a) == lattice.form(b)


@pytest.mark.parametrize("a, b", DIFFERENT)
def test_different(lattice, a, b):
    assert lattice.form(a) != lattice.form(b)


def test_words_of_another_script_stay(lattice):
    assert lattice.form("London газета wins") == "London газета wins"
    assert lattice.form("Boаrd") == "Board"


def test_path_does_not_depend_on_the_spelling(lattice):
    assert lattice.form("the сase of see") == lattice.form("the cаse of sее") == "the case of see"


def test_pairs(spark):
    rows = [("3", "Bank deal", "x"), ("1", "Bаnk deal", "x"), ("2", "Bank deal", "x"), ("2", "Bank deal", "x"), ("4", None, " "), ("5", "", None), ("6", "Bank Deal", "y​"), (None, "Bаnk deal", None), ("7", "Вank deal", "y")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id string, title string, content string, form string")
    got = {tuple(r) for r in lookalike.lookalike_pairs(df).collect()}
    assert got == {("title", "1", "3"), ("title", "1", "2"), ("title", "1", "7"), ("title", "2", "7"), ("title", "3", "7"), ("content", "6", "7")}
    assert lookalike.lookalike_pairs(df.limit(0)).count() == 0


def test_long_text(lattice):
    assert lattice.form("Bаnk " * 40_000) == "Bank " * 40_000


def test_a_hot_spelling_costs_its_pairs_only(spark):
    """10^5 equal rows and one odd one: 10^5 pairs, from as many candidates."""
    from pyspark.sql import functions as F

    odd = "Board of L\u0430zokir approves"
    df = spark.range(100_000).select(F.format_string("a%06d", "id").alias("id"), F.lit("Board of Lazokir approves").alias("title"), F.lit(None).cast("string").alias("content"))
    df = df.unionByName(spark.createDataFrame([("b", odd, None)], df.schema))
    got = lookalike.lookalike_pairs(df)
    assert got.count() == 100_000 and got.filter("id_b = 'b' and field = 'title'").count() == 100_000
