from __future__ import annotations

import pytest

linking = pytest.importorskip("siftwire.llm.linking")

ORGS = [
    (1, "Tonikhumn Savings Bank", ["تونيخومن للادخار"]), (2, "Fabanzux Digital Wallet Services", ["FDWS"]), (3, "Tonikhumn Microfinance", None), (4, "Lazokir Investment Group", ["لازوكير جروب للاستثمار"]),
    (5, "Sanzonli Payments", []), (6, "Wokusin Savings Bank", None), (7, "Qebitram Digital Wallet Services", None), (8, "Kenbrobra Payments", None), (9, "Nammesis Savings Bank", None), (10, "Vitivan Payments", None),
    (11, "Rudibam Investment Group", None), (12, "Trishoti Investment Group", None), (13, "Bulzarun Digital Wallet Services", None), (14, "Huganda Microfinance", None), (15, "Fomnusix Microfinance", None), (20, "Savings Bank - Tonikhunm", None), (21, None, None),
]
PEOPLE = [(1, "Mohamed Wagdy Elfulisa", "محمد الفوليسا"), (2, "Robert Zaki Bohiban", None), (3, "Katherine Navinqir", None)]
CASES = [
    ("Tonikhunm Savings Bank", "c1"), ("Tonikhumn Svgs Bk", "c1"), ("Bank Savings Tonikhumn", "c1"), ("TONIKHUMN SAVINGS BANK", "c1"), ("تونيخومنللادخار", "c1"), ("شركة تونيخومن للادخار", "c1"), ("TonikhumnSavingsBank", "c1"),
    ("Tonikhumn Micro-fin", "c3"), ("Fabanzux Dig. Wlt Svcs", "c2"), ("F.D.W.S.", "c2"), ("Al Lazokir", "c4"), ("Lazokir Grp", "c4"), ("The Sanzonlee Payments", "c5"), ("Sanzonli Payments S.A.E.", "c5"), ("Payments, Sanzonli", "c5"),
    ("Rob Bohiban", "p2"), ("Bohiban, Robert", "p2"), ("R. Bohiban", "p2"), ("R.Z. Bohiban", "p2"), ("Dr. Bohiban", "p2"), ("Muhammad El Fulisa", "p1"), ("mohamed elfuleesa", "p1"), ("محمدالفوليسا", "p1"), ("Kate Navinqir", "p3"), ("Katherine A. Navinkir", "p3"),
    ("Tonikhumn", None), ("Sanzonli Microfinance", None), ("Salma Bohiban", None), ("inflation", None), ("digital wallet", None), ("Bikegix Insurance Brokerage", None), ("", None), ("  ", None), ("x" * 20000, None),
    ("Tonikhumn Savings Bank", None), ("FDWS", None), ("Robert Zaki Bohiban", None),
]


def test_variants(spark):
    c = spark.createDataFrame(ORGS, "id int, name string, aliases array<string>")
    p = spark.createDataFrame(PEOPLE, "id int, full_name string, full_name_ar string")
    a = spark.createDataFrame([(i, [m, None, m], "clash") for i, (m, _) in enumerate(CASES)] + [(99, None, ""), (100, [], ""), (0, [CASES[0][0]], "")], "id bigint, entities array<string>, entity string")
    rows = linking.variant_names(a, c, p).collect()
    got = {r.row_id: r.entity_key for r in rows if r.tbl == "article_classifications"}
    assert [(m, e, got.get(i)) for i, (m, e) in enumerate(CASES) if got.get(i) != e] == []
    assert len(rows) == len({(r.tbl, r.row_id, r.mention) for r in rows})
    assert [(r.row_id, r.mention, r.entity_key) for r in rows if r.tbl == "competitors"] == [(20, "Savings Bank - Tonikhunm", "c1")]


def test_empty(spark):
    c = spark.createDataFrame([], "id int, name string, aliases array<string>")
    p = spark.createDataFrame([], "id int, full_name string, full_name_ar string")
    a = spark.createDataFrame([(1, ["x"])], "id bigint, entities array<string>")
    assert linking.variant_names(a, c, p).count() == 0
    assert linking.variant_names(a.limit(0), c, p).count() == 0


@pytest.mark.parametrize("a, b", [("abcde", "abde"), ("", "x"), ("kitten", "sitting"), ("aaaa", "aa")])
def test_lcs(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert linking._lcs(a, b) == best[-1][-1] if a and b else linking.lcs_ratio(a, b) == 0.0


def _again(spark, names):
    c = spark.createDataFrame([*[(i, n, None) for i, n in names], *[(100 + i, n, a) for i, n, a in ORGS if n]], "id int, name string, aliases array<string>")
    return {r.id: r.first for r in linking.repeated_entries(c, linking.line_words(c)).collect() if r.id < 100}


def test_rows_of_one_organisation_are_no_ambiguity(spark):
    names = [(1, "Nuvora Leasing"), (3, "Nuvora Leasng"), (4, "Qal Leasing"), (5, "Wam Leasing"), (6, "Hib Leasing")]
    assert _again(spark, names) == {3: 1}
    assert _again(spark, [*names, (2, "Nuvora  Leasing Co")]) == {2: 1, 3: 1}
    assert _again(spark, [*names, (2, "Nuvora  Leasing Co"), (7, "Nuvora Lesing"), (8, "NUVORA LEASING")]) == {2: 1, 3: 1, 7: 1, 8: 1}


def test_an_organisation_entered_often_is_no_line_of_business(spark):
    c = spark.createDataFrame([(i, n) for i, n in enumerate(["Nuvora Leasing", "Nuvora  Leasing Co", "Nuvora Leasng", "Qal Leasing", "Wam Leasing", "Hib Leasing"])], "id int, name string")
    assert linking.line_words(c) == {"leasing"}


def test_long_names_meet_by_their_beginning(spark):
    c = spark.createDataFrame(ORGS, "id int, name string, aliases array<string>")
    p = spark.createDataFrame(PEOPLE, "id int, full_name string, full_name_ar string")
    a = spark.createDataFrame([(1, ["fabanzuxdigitalwalletservicse"]), (2, ["tonikhumnsavingsbnak"])], "id bigint, entities array<string>")
    assert {(r.row_id, r.entity_key) for r in linking.variant_names(a, c, p).collect() if r.tbl != "competitors"} == {(1, "c2"), (2, "c1")}


def test_nicknames_are_an_option(spark):
    c = spark.createDataFrame(ORGS, "id int, name string, aliases array<string>")
    p = spark.createDataFrame(PEOPLE, "id int, full_name string, full_name_ar string")
    a = spark.createDataFrame([(1, ["Bobby Bohiban"]), (2, ["Roberto Bohiban"])], "id bigint, entities array<string>")
    got = [{r.row_id for r in linking.variant_names(a, c, p, n).collect() if r.tbl != "competitors"} for n in (linking.NICKNAMES, {})]
    assert got == [{1, 2}, {2}]
