"""Bounded candidates: the first rows of every source as by meeting all pairs, with far fewer of them met."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import bounded as B


def first_rows(probes, index, sizes, top):
    """By definition: (q, idx) of targets of which a row can be among the first."""
    out = set()
    for q in {r[0] for r in probes}:
        own = {}
        for _, t, w, pos in (r for r in probes if r[0] == q):
            own[t] = (w, pos)
        met = {}
        for idx, t in index:
            if t in own:
                w, pos = met.get(idx, (0, 1 << 30))
                met[idx] = (w + own[t][0], min(pos, own[t][1]))
        ranked = sorted(met.items(), key=lambda m: (-m[1][0], m[1][1]))
        rows = 0
        for i, (idx, value) in enumerate(ranked):
            if rows >= top and value != ranked[i - 1][1]:
                break
            out.add((q, idx, *value))
            rows += sizes[idx]
    return out


def catalog(seed, names, words, longest):
    rnd = random.Random(seed)
    index = {(i, f"t{int(rnd.paretovariate(0.7)) % words}") for i in range(names) for _ in range(rnd.randint(1, longest))}
    sizes = {i: rnd.choice([1, 1, 1, 7]) for i in range(names)}
    probes = []
    for q in range(60):
        tokens = list(dict.fromkeys(f"t{int(rnd.paretovariate(0.7)) % (words + 5)}" for _ in range(rnd.randint(1, longest))))
        probes += [(q, t, rnd.choice([1, 1, 2, 8]), pos) for pos, t in enumerate(tokens)]
    return probes, sorted(index), sizes


@pytest.mark.parametrize(("names", "words", "longest", "short", "levels", "long", "block"), [(300, 30, 8, 10, 3, 20, 4096), (300, 12, 8, 3, 3, 20, 16), (200, 40, 12, 2, 2, 4, 7), (200, 40, 25, 5, 3, 3, 4096), (120, 6, 6, 0, 3, 20, 5)])
def test_bounded_equals_all_pairs(spark, monkeypatch, names, words, longest, short, levels, long, block):
    for k, v in {"SHORT": short, "LEVELS": levels, "LONG": long, "BLOCK": block}.items():
        monkeypatch.setattr(B, k, v)
    probes, index, sizes = catalog(names + words, names, words, longest)
    frames = (spark.createDataFrame(probes, "q long, token string, w int, pos int"), spark.createDataFrame(index, "idx long, token string"), spark.createDataFrame(list(sizes.items()), "idx long, n int"))
    got = [tuple(r) for r in B.meet(*frames, 10).select("q", "idx", "weight", "pos").collect()]
    assert len(got) == len(set(got)) and first_rows(probes, index, sizes, 10) <= set(got)


def test_bounded_of_empty_tables(spark):
    none = spark.createDataFrame([], "q long, token string, w int, pos int")
    index, sizes = spark.createDataFrame([(1, "a")], "idx long, token string"), spark.createDataFrame([(1, 1)], "idx long, n int")
    assert B.meet(none, index, sizes, 5).collect() == []
    asked = spark.createDataFrame([(1, "a", 1, 0)], "q long, token string, w int, pos int")
    assert B.meet(asked, index.limit(0), sizes.limit(0), 5).collect() == []
    assert [tuple(r) for r in B.meet(asked, index, sizes, 5).collect()] == [(1, 1, 1, 0)]


def test_frequent_tokens_are_not_opened_for_all(spark, monkeypatch):
    """Names of three parts out of 8 x 8 x 6: of the pairs that share a token a tenth is met, and the lists of hot tokens are cut."""
    index = [(i, t) for i in range(384) for t in (f"a{i % 8}", f"b{i // 8 % 8}", f"c{i // 64}")]
    probes = [(q, t, 1, pos) for q in range(384) for pos, t in enumerate((f"a{q % 8}", f"b{q // 8 % 8}", f"c{q // 64}"))]
    seen = []
    met = B.met
    monkeypatch.setattr(B, "met", lambda o, lists: (lambda r: (seen.append(r.distinct().count()), r)[1])(met(o, lists)))
    B.meet(spark.createDataFrame(probes, "q long, token string, w int, pos int"), spark.createDataFrame(index, "idx long, token string"), spark.createDataFrame([(i, 26) for i in range(384)], "idx long, n int"), 50)
    sharing = 384 * (384 - 5 * 7 * 7)
    assert seen[0] * 10 <= sharing
    monkeypatch.setattr(B, "BLOCK", 10)
    hot = spark.createDataFrame([("k", i, 100) for i in range(100)], "key string, idx long, names long")
    asked = spark.createDataFrame([(q, "k", 100) for q in range(3)], "q long, key string, names long")
    pairs = met(asked, hot)
    assert pairs.distinct().count() == pairs.count() == 300
    blocks = hot.select(F.pmod(F.xxhash64("idx"), F.ceil(F.col("names") / 10).cast("int")).alias("b")).groupBy("b").count()
    assert blocks.count() == 10
