"""Fuzzy pairs: no pair that has the ratio is lost, and those kept have the characters in common."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from recordloom.operators import fuzzy, match, search


def words(seed, n):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("aabcdeé 𝄞") for _ in range(rnd.randrange(1, 18))) for _ in range(n // 3)]
    out = list(base)
    for _ in range(n - len(base)):
        w = list(rnd.choice(base))
        for _ in range(rnd.randrange(4)):
            w.insert(rnd.randrange(len(w) + 1), rnd.choice("abcxyz"))
        out.append("".join(w[rnd.randrange(2) :]))
    return [*out, "", "a", "aaaa"]


@pytest.mark.parametrize(("ratio", "most"), [(0.6, 2.2), (0.7, None), (1.0, None), (0.3, None)])
def test_overlapping_equals_brute_force(spark, ratio, most):
    asked, items = words(1, 60), words(2, 80)
    got = {(r.q, r.idx): r.common for r in fuzzy.overlapping(spark.createDataFrame(list(enumerate(asked)), "q long, wanted string"), spark.createDataFrame(list(enumerate(items)), "idx long, text string"), ratio, most).collect()}
    want = {}
    for q, a in enumerate(asked):
        for i, b in enumerate(items):
            common = sum((Counter(a) & Counter(b)).values())
            if a and b and 2 * common >= ratio * (len(a) + len(b)) - 1e-9 and (most is None or len(b) <= most * len(a)):
                want[q, i] = common
    assert got == want
    for q, a in enumerate(asked):
        for i, b in enumerate(items):
            if a and b and (most is None or len(b) <= most * len(a)) and SequenceMatcher(None, a, b, autojunk=False).ratio() >= ratio:
                assert (q, i) in got


def test_distance_loses_no_pair(spark):
    pairs = [(a, b) for a in words(3, 30) for b in words(4, 30) if a and b]
    kept = {(r.a, r.b) for r in spark.createDataFrame(pairs, "a string, b string").filter(fuzzy.distance_allows(fuzzy.F.col("a"), fuzzy.F.col("b"), 0.6)).collect()}
    assert all((a, b) in kept for a, b in pairs if SequenceMatcher(None, a, b, autojunk=False).ratio() >= 0.6)


def test_close_match_equals_brute_force(spark):
    rnd = random.Random(6)
    names = [" ".join(rnd.choice(["ring", "gear", "rign", "plate", "large", "small"]) for _ in range(rnd.randrange(1, 4))) for _ in range(40)]
    src, tgt = list(enumerate(names[:20])), [(i, f"c{i}", n) for i, n in enumerate(names[20:])]
    got = {r.q: (r.match_name, r.match_score) for r in match.close_match(spark.createDataFrame(src, "q long, name string"), spark.createDataFrame(tgt, "idx long, code string, name string"), 0.6).collect()}
    for q, a in src:
        if any(a == n for *_, n in tgt):
            assert got[q] == (a, 100.0)
            continue
        best = max(((SequenceMatcher(None, n, a).ratio(), n) for *_, n in tgt), default=(0, ""))
        assert got[q][0] == (best[1] if best[0] >= 0.6 and SequenceMatcher(None, a, best[1]).ratio() >= 0.6 else "")


def test_search_composes_queries_and_shows_the_first_for_punctuation(spark):
    items = spark.createDataFrame([(1, "A1", "Siêu âm tim"), (2, "B2", "***"), (3, "C3", "gan"), (4, "D4", "phổi")], "idx long, code string, name string")
    queries = spark.createDataFrame([(1, "siêu âm"), (2, "--"), (3, "phoii")], "query_id long, query string")
    got = {}
    for r in search.search(queries, items).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.idx, r.score, r.match_type))
    assert got[1][0][0] == 1 and got[1][0][2] == "PREFIX" and got[2] == [(2, 100.0, "EXACT"), (3, 95.0, "PREFIX"), (4, 95.0, "PREFIX"), (1, 95.0, "PREFIX")]
