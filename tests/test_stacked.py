"""Stacked catalogs and facets by predicate: each as by its definition."""

import re

import pytest
from pyspark.sql import functions as F

from recordloom.operators import match as M
from recordloom.operators import results as R
from recordloom.vocab import DEFAULT

NAMES = ["Siêu âm tim", "Siêu âm ổ bụng", "Cắt ruột thừa", "Cắt gan", "Khâu vết thương", "Chụp x quang", "Chụp x quang phổi", "Đo đường huyết", "Đặt ống thông", "Rút ống thông", "Nội soi dạ dày"]


def test_catalogs_in_one_pass_equal_two_links(spark, monkeypatch):
    src = spark.createDataFrame([(i, n) for i, n in enumerate([*NAMES, "Siêu âm tim thai", "Nội soi", "", "zzz"])], "q long, name string")
    targets = [spark.createDataFrame([(i, f"{k}{i}", n) for i, n in enumerate(names, 1)], "idx long, code string, name string") for k, names in (("a", NAMES[::2] + NAMES[:1]), ("b", [n + " một bên" for n in NAMES[1::3]] + ["Cắt gan"]))]
    stages = []
    monkeypatch.setattr(M, "meet", lambda *a, f=M.meet: (stages.append(1), f(*a))[1])
    got = {r.q: (r.code_1, r.name_1, r.score_1, r.code_2, r.name_2, r.score_2) for r in M.link_catalogs(src, *targets, DEFAULT, 0.5).collect()}
    assert len(stages) == 1
    one, two = ({r.q: (r.match_code, r.match_name, r.match_score) for r in M.link(src, t, DEFAULT, 0.5).collect()} for t in targets)
    assert got == {q: one[q] + two[q] for q in one}
    assert sum(v[0] != "" for v in got.values()) >= 5 and sum(v[3] != "" for v in got.values()) >= 3


LABELS = [(None, None), ("", ""), ("", "tim"), (None, "van tim, mạch"), ("IX. Tai - Mũi - Họng", None), ("tai/mũi", "họng"), ("Tim mạch", "gan"), ("da", None), ("Nội khoa > Tim mạch", None), ("Sản", "tử cung"), ("Tim mạch", "gan")]
ENTRIES = ["Tai - Mũi - Họng", "Tim mạch", "Mắt", "Da - Mô mềm", "Sản - Phụ khoa", "X", "Tiêu hóa", "-"]


def belongs(s, a, w):
    label = lambda x: re.sub(r"\s+", " ", re.sub("[-/,]", " ", (x or "").lower())).strip()
    if not s and not a:
        return False
    s, a, w = label(s), label(a), label(w)
    long = [t for t in w.split(" ") if len(t) >= 3]
    return w in s or s in w or w in a or bool(long) and sum(t in s or t in a for t in long) >= min(2, len(long))


def test_ontology_facets_equal_the_predicate(spark):
    rows = spark.createDataFrame(LABELS, "specialty string, anatomy string")
    want = {e: n for e in ENTRIES if (n := sum(belongs(s, a, e) for s, a in LABELS))}
    assert {r.entry: r.n for r in R.facet_ontology(rows, spark.createDataFrame([(e,) for e in [*ENTRIES, ENTRIES[0]]], "entry string")).collect()} == want
    for e in ENTRIES:
        assert rows.filter(R.specialty_matches(F.col("specialty"), F.col("anatomy"), F.lit(e), True)).count() == want.get(e, 0)
    assert R.facet_ontology(rows.limit(0), spark.createDataFrame([("x",)], "entry string")).collect() == []


@pytest.mark.parametrize(("s", "a", "w", "want"), [("IX. Tai mũi họng", None, "Tai mũi họng", True), ("Sản > SAU SINH", None, "sau sinh", True), ("Sản", "tử cung", "Tử", True), (None, None, "x", False), ("Mắt", None, "mat", False), ("Nội", None, "Ngoại", False), (None, "gan", "Gan", True)])
def test_specialty_of_a_source(spark, s, a, w, want):
    got = spark.createDataFrame([(s, a)], "s string, a string").select(R.specialty_matches(F.col("s"), F.col("a"), F.lit(w), False)).first()[0]
    assert got is want
