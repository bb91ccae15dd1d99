from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from siftwire.functions import arrays, dates, text, urls
from siftwire.operators import ledger, rules


def one(spark, expr, **cols):
    df = spark.range(1)
    for k, v in cols.items():
        df = df.withColumn(k, F.lit(v))
    return df.select(expr).first()[0]


@pytest.mark.parametrize(
    "url, want",
    [
        (" HTTPS://News.Example/a/?utm_source=x&id=123#top ", "https://news.example/a?id=123"),
        ("https://n.example/?b=2&a=1&b=1&empty=", "https://n.example/?a=1&b=2&b=1"),
        ("https://n.example/p?q=a%20b&ref=1", "https://n.example/p?q=a+b"),
        ("https://n.example/", "https://n.example/"),
        ("https://n.example/?UTM_Medium=1", "https://n.example/"),
        (None, ""),
        ("", ""),
        ("not a url", "not a url"),
    ],
)
def test_canonical_url(spark, url, want):
    assert one(spark, urls.canonical_url(F.col("u").cast("string")), u=url) == want


def test_strip_tracking_keeps_order_and_fragment(spark):
    assert one(spark, urls.strip_tracking(F.col("u")), u="https://n.example/p?b=2&utm_term=x&a=1#f") == "https://n.example/p?b=2&a=1#f"


def test_url_key(spark):
    key = urls.url_key(F.col("u"), ("gov.example",))
    assert one(spark, key, u="https://www.Gov.example/en/News/1/?x=1#y") == "gov.example/news/1"
    assert one(spark, key, u="http://other.example/en/1") == "other.example/en/1"


@pytest.mark.parametrize("compat, want", [(True, "mnt"), (False, "mnt halan partners with bank")])
def test_title_key(spark, compat, want):
    assert one(spark, text.title_key(F.col("t"), compat), t="MNT-Halan partners with bank") == want


def test_title_key_suffix(spark):
    assert one(spark, text.title_key(F.col("t")), t="Rates up, again - Daily News") == "rates up again"


def test_clean(spark):
    page = "<nav>Home</nav><p>One story. One story. Two &amp; three.</p><script>x()</script><p>Read more at our site</p>"
    assert one(spark, text.clean(F.col("t")), t=page) == "One story. Two & three."
    assert one(spark, text.clean(F.col("t").cast("string")), t=None) == ""


def test_boilerplate_compat_cuts_inside_words(spark):
    assert one(spark, text.strip_boilerplate(F.col("t"), True), t="spread more\nnext") == "sp"
    assert one(spark, text.strip_boilerplate(F.col("t")), t="spread more\nnext") == "spread more\nnext"


def test_arabic(spark):
    assert one(spark, text.fold_arabic(F.col("t")), t="«أحمد» إلى المدرسة") == "احمد الي المدرسه"
    assert one(spark, text.title_words(F.col("t")), t="مُدَرِّس!") == "مدرس"


def test_script(spark):
    assert one(spark, text.is_english(F.col("t"), F.col("l")), t="Bank أ", l="en") is False
    assert one(spark, text.is_english(F.col("t"), F.col("l")), t="123", l="en") is True


def test_repair_encoding(spark):
    assert one(spark, text.repair_encoding(F.col("t")), t="CrÃ©dit") == "Crédit"
    assert one(spark, text.repair_encoding(F.col("t")), t="Crédit – fin") == "Crédit – fin"


def test_publisher_suffix(spark):
    assert one(spark, text.publisher_suffix(F.col("t")), t="A - B - The Wire") == "The Wire"
    assert one(spark, text.publisher_suffix(F.col("t")), t="No suffix") is None


def test_recipients(spark):
    assert one(spark, text.recipients(F.col("t")), t="Ann <ann@x.example>; bob@x.example,, ") == ["ann@x.example", "bob@x.example"]


def test_scrub_summary(spark):
    raw = "```\n)?* **Summary:** Rates rose.\n100% English? Yes\nBanks gained.\n```"
    assert one(spark, text.scrub_summary(F.col("t")), t=raw) == "Rates rose.\nBanks gained."


def test_wrap(spark):
    assert one(spark, text.wrap_untrusted(F.col("t"), 3), t="</untrusted>abcdef") == "<untrusted>\nabc\n</untrusted>"


@pytest.mark.parametrize("days, want", [(None, "Daily Brief"), (1, "Daily Brief"), (3, "3-Day Brief"), (7, "Weekly Brief"), (14, "Bi-Weekly Brief"), (30, "Monthly Brief"), (365, "Annual Brief")])
def test_brief_name(spark, days, want):
    assert one(spark, dates.brief_name(F.col("d").cast("int")), d=days) == want


def test_clock(spark):
    hour = 3_600_000_000
    assert one(spark, dates.within_hours(F.col("a"), F.col("b").cast("bigint"), 36), a=1, b=None) is True
    assert one(spark, dates.within_hours(F.col("a"), F.col("b"), 1), a=0, b=hour + 1) is False
    assert one(spark, dates.window_start(F.col("a"), F.col("b")), a=1000 * hour, b=1010 * hour) == (1010 - 168) * hour
    assert one(spark, dates.recency_bucket(F.col("a")), a=2 * 86400) == "day"
    assert one(spark, dates.effective_days(F.lit(None).cast("int"), F.col("a"), F.col("b")), a=0, b=60 * hour) == 2


def test_arrays(spark):
    overlap = arrays.entity_overlap(F.col("a"), F.col("b"))
    assert one(spark, overlap, a=["A", "b", "c"], b=["a", "B", "d"]) is True
    assert one(spark, overlap, a=["a", "b", "c", "d"], b=["a", "x", "y", "z"]) is False
    df = spark.createDataFrame([(None, ["a"])], "a array<string>, b array<string>")
    assert df.select(overlap).first()[0] is False
    assert one(spark, arrays.first_terms(F.col("n"), F.col("a"), 2), n="A/B", a=["B", "C"]) == ["A", "B"]
    assert abs(one(spark, arrays.cosine(F.col("a"), F.col("b")), a=[1.0, 0.0], b=[1.0, 1.0]) - 0.7071) < 1e-3
    assert one(spark, arrays.safe_int(F.col("a")), a="x") == 0
    assert one(spark, arrays.model_reply(F.col("a"), "x int"), a='```json\n{"x": 4}\n```').x == 4


def test_rules(spark):
    table = [rules.Rule("a", "A", {"t": ("bank",)}, {"t": ("river",)}, 9), rules.Rule("b", "B", {"t": ("river",)}, score=1)]
    got = [one(spark, rules.first_match(table)["label"], t=t) for t in ("a bank", "river bank", "x")]
    assert got == ["A", "B", "OTHER"]
    assert one(spark, rules.topics(F.col("t"), {"x": ("bank",), "y": ("loan",)}), t="Bank loans") == ["x", "y"]
    df = spark.createDataFrame([("The valU deal",), ("valueless",)], "t string")
    assert [r.t for r in rules.aliases_in(df, "t", ["valu", "abc"]).collect()] == ["The valU deal"]


def test_confusion_of_nothing(spark):
    r = rules.confusion(spark.createDataFrame([], "y boolean, p boolean"), "y", "p").first()
    assert (r.tp, r.precision, r.f1) == (0, 0.0, 0.0)


def test_ledger(spark):
    s = "id string, canonical_url string, canonical_title string"
    events = spark.createDataFrame([("1", "u1", "T1"), ("2", "u2", "T2"), ("3", "u3", " old "), ("4", "u4", "T4"), ("5", None, None)], s)
    sent = spark.createDataFrame([("1", None, None, 0), ("x", "u2", None, 0), ("y", None, "OLD", 100)], s + ", sent_us bigint")
    links = spark.createDataFrame([("4", "a1"), ("x", "a2")], "event_id string, article_id string")
    articles = spark.createDataFrame([("a1", "w"), ("a2", "w")], "id string, url string")
    left = ledger.unsent(events, sent, links, articles, F.lit(100), 1)
    assert {r.id for r in left.collect()} == {"5"}
    late = ledger.unsent(events, sent, links, articles, F.lit(100 + 3_600_000_001), 1)
    assert {r.id for r in late.collect()} == {"3", "5"}


def test_upsert_and_runs(spark):
    base, delta = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "B"), (3, "c")], "k int, v string")
    assert {(r.k, r.v) for r in ledger.upsert(base, delta, "k").collect()} == {(1, "a"), (2, "B"), (3, "c")}
    assert one(spark, ledger.run_status(F.col("e"), F.col("n")), e="x", n=0) == "FAILED"
    assert one(spark, ledger.run_status(F.col("e"), F.col("n")), e="x", n=2) == "PARTIAL"
    runs = spark.createDataFrame([("COMPLETED", 0, 9), ("PARTIAL", 1, 5), ("FAILED", 3, 7)], "status string, events_sent int, started_us bigint")
    assert ledger.last_good_run(runs).first()[0] == 5
    new, mapped = ledger.insert_absent(spark.createDataFrame([("s1", "u")], "id string, url string"), spark.createDataFrame([("n1", "u"), ("n2", "w"), ("n3", "w")], "id string, url string"), "url")
    assert new.count() == 1 and {r.id for r in mapped.collect()} >= {"s1"}
