"""Terms found by a trie are those found one by one, whatever the table's length."""

import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import decompose as D
from recordloom.functions import terms as T
from recordloom.vocab import DEFAULT, Vocabulary, spellings

LETTERS = ["a", "b", "c", "ab", "é"]


def phrases(seed, n, longest=4):
    rnd = random.Random(seed)
    return [" ".join(rnd.choice(LETTERS) for _ in range(rnd.randint(1, longest))) for _ in range(n)]


def one_by_one(text, listed):
    return [(k, p) for k, p in dict.fromkeys(listed) if p and f" {p} " in f" {text or ''} "]


@pytest.mark.parametrize("seed", range(4))
def test_trie_equals_looking_one_by_one(seed):
    rnd = random.Random(seed)
    listed = [(rnd.choice("xy"), p) for p in phrases(seed, 120)] + [("x", ""), ("y", "a")]
    made = T.trie(listed)
    for text in [*phrases(seed + 9, 200, 12), "", None, "a  b", " a ", "none of them", "ab ab ab ab ab"]:
        assert [made.terms[n] for n in made.found(text)] == one_by_one(text, listed)


@pytest.mark.parametrize("most", [T.MOST, 5])
def test_tables_short_and_long(spark, most):
    listed = list(dict.fromkeys((f"k{i % 3}", p) for i, p in enumerate(phrases(3, 40))))
    terms = spark.createDataFrame([(i, k, p) for i, (k, p) in enumerate(listed)], "rank int, kind string, phrase string")
    texts = [*phrases(5, 60, 9), "", None, "a"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(4)
    got = {r.id: [tuple(h) for h in r.found] for r in T.hits_of_table(rows, terms, "id", "text", most).collect()}
    assert got == {i: one_by_one(t, listed) for i, t in enumerate(texts)}
    assert all(r.found == [] for r in T.hits_of_table(rows, terms.limit(0), "id", "text", most).collect())


def site(n):
    """A site's vocabulary with n terms of anatomy in ten categories, and as many actions."""
    rnd = random.Random(n)
    word = lambda: "".join(rnd.choice("bcdghklmnprst") + rnd.choice("aeiou") for _ in range(2))
    some = [f"{word()} {word()}" if i % 3 else word() for i in range(n)]
    return Vocabulary(ontology={f"C{k}": (f"Category {k}", some[k::10]) for k in range(10)}, actions=[f"{word()} {t}" for t in some[:50]] + some[:20], modalities={"M": some[5:40], "N": some[30:60]}, excluded={"M": [(some[5], [some[6]])]}, modifiers=some[60:90])


def test_decomposition_by_a_site_of_many_terms(spark):
    vocab = site(600)
    assert sum(len(t) for _, t in vocab.ontology.values()) == 600
    rnd = random.Random(2)
    every = [p for _, p in D.terms_of(vocab)]
    names = [" ".join(rnd.choice([*rnd.choices(every, k=3), "xx"]) for _ in range(rnd.randint(1, 6))) for _ in range(80)] + ["", None]
    rows = D.decompose(spark.createDataFrame(list(enumerate(names)), "id long, clean string"), "clean", vocab)
    for r in rows.select("id", "anatomy", "category", "modifiers", "actions", "modalities").collect():
        text = names[r.id] or ""
        has = lambda p: f" {p} " in f" {text} "  # noqa: E731, B023
        by = {c: [t for t in vocab.terms(c) if has(t)] for c in vocab.ontology}
        assert r.anatomy == list(dict.fromkeys(t for v in by.values() for t in v))
        assert r.category == next((c for c, v in by.items() if v), None)
        assert r.modifiers == [m for m in spellings(vocab.modifiers) if has(m)]
        kept = []
        for a in sorted(spellings(vocab.actions), key=lambda a: -len(a)):
            if has(a) and not any(a in k for k in kept):
                kept.append(a)
        assert r.actions == kept
        barred, words = vocab.excluded["M"][0]
        m = any(has(s) for p in vocab.modalities["M"] if p != barred for s in spellings([p])) or (has(barred) and not any(w in text for w in words))
        assert r.modalities == [k for k, x in (("M", m), ("N", any(has(p) for p in vocab.modalities["N"]))) if x]


def test_plan_does_not_grow_with_the_terms(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, clean string")
    size = lambda v: len(D.decompose(rows, "clean", v)._jdf.queryExecution().optimizedPlan().toString())
    assert size(site(1200)) < 1.3 * size(site(120))
    assert D.decompose(rows.limit(0), "clean", DEFAULT).count() == 0 and D.decompose(rows, "clean", Vocabulary()).select(F.size("anatomy")).first()[0] == 0
