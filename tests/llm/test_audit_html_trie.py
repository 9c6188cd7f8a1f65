"""Operators 11 to 13 on small fixtures: brute force, edge cases, held-out accuracy."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import filter_audit, html_text, lookup, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
AUDIT = "filter_order part step kept removed redundant unique_fails good_lost toxic_lost shapley".split()


def audited(rows, labels):
    """All orders applied one after another to the rows themselves."""
    fails = []
    for doc_id, text, _ in rows:
        t = text or ""
        w = WORDS.findall(t)
        same = [i for i, u, _ in rows if i is not None and (u or "") == t]
        fails.append({f for f, x in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), doc_id is not None and min(same) < doc_id), strict=True) if x})
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    out = []
    for part in {p or "" for *_, p in rows}:
        own = [(i, f) for (i, _, p), f in zip(rows, fails, strict=True) if (p or "") == part]
        removed = {}
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [i for i, x in left if f in x]
                left = [(i, x) for i, x in left if f not in x]
                removed["".join(order), step] = (f, len(left), len(gone), sum(f in x for _, x in own) - len(gone), sum(x == {f} for _, x in own), sum(i in good for i in gone), sum(i in toxic for i in gone))
        for (order, step), (f, *counts) in removed.items():
            out.append((order, part, step, *counts, sum(v[2] for v in removed.values() if v[0] == f)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    texts = ["", None, "#", "ABC", "é " * 60, " ".join(f"w{i}" for i in range(60)), " ".join(f"w{i}" for i in range(60)) + " #", "A" * 100 + " b" * 60, "x\x0by " * 30, "a\x1cb " * 200]
    texts += [" ".join(f"{rnd.choice(['w', 'W', 'w', '$'])}{rnd.randrange(90)}" for _ in range(rnd.randrange(30, 120))) for _ in range(15)]
    ids = [*range(55), None, None, 7, 7]
    return [(i, rnd.choice(texts), rnd.choice([None, "", "s1", "s2", "all gone"])) for i in ids] + [(3, "#", "all gone"), (100, "word " * 100_000, "s1")]


@pytest.fixture(scope="module")
def said(rows):
    return [(i, i % 3 - 1 if i % 4 else None, i % 2) for i in range(0, 120, 1)] + [(5, 1, None), (5, 0, 1), (None, 1, 1)]


def tables(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, p, "x", "y") for i, t, p in rows], "doc_id long, text string, source string, part string, fails string")
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("first", F.lit(1))


def found(df):
    return sorted(tuple(r) for r in df.select(*AUDIT).collect())


def test_audit_equals_brute_force(spark, rows, said):
    docs, labels = tables(spark, rows, said)
    want = audited(rows, said)
    assert found(filter_audit.audit(docs.repartition(5), labels)) == want
    assert found(filter_audit.audit(docs.coalesce(1), labels)) == want


def test_audit_of_empty_tables(spark, rows, said):
    docs, labels = tables(spark, rows, said)
    assert found(filter_audit.audit(docs.limit(0), labels)) == []
    assert found(filter_audit.audit(docs, labels.limit(0))) == audited(rows, [])


def test_audit_shares_states(spark, monkeypatch):
    """32 states, each persisted or counted once, however many orders meet them."""
    named = []
    keep = filter_audit.materialize
    monkeypatch.setattr(filter_audit, "materialize", lambda df, name: (named.append(name), keep(df, name))[1])
    root = spark.createDataFrame([("p", f, 0, 0) for f in range(8)], "part string, fails int, good int, toxic int")
    got = filter_audit.interactions(filter_audit.edges(root, 3), "XYZ").filter("step = 3").select("filter_order", "removed", "kept").collect()
    assert len(got) == 6 and all(tuple(r)[1:] == (1, 1) for r in got)
    assert sorted(n for n in named if "count" in n) == [f"audit-count-{s}" for s in range(7)] and len(set(named)) == len(named)


@pytest.mark.parametrize("hot", [1, 3, 10_000])
def test_lookup_of_hot_and_rare_keys(spark, monkeypatch, hot):
    monkeypatch.setattr(lookup, "HOT", hot)
    keys = ["a"] * 20 + ["b"] * 3 + ["c", None, "none"]
    rows = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "i long, k string")
    values = spark.createDataFrame([("a", 1, 20), ("b", None, 3), ("c", 3, 1)], "k string, v int, n long")
    got = {r.i: r.v for r in lookup.look_up(rows, values, ["k"], "n", "t").collect()}
    assert got == {i: {"a": 1, "c": 3}.get(k) for i, k in enumerate(keys)}


def trie(rows):
    """The rebuilt conversations' trie by its definition."""
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest(), (role, text)))
    own = {c: [t[-1] for t in sorted(v)] for c, v in convs.items()}
    rebuilt = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        rebuilt[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    nodes = {}
    for c, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for n, members in nodes.items():
        below = [m for m in nodes if m[: len(n)] == n]
        children = {m for m in below if len(m) == len(n) + 1}
        leaves = [m for m in below if not any(k[: len(m)] == m and len(k) == len(m) + 1 for k in below)]
        saved = sum((len(nodes[m]) - 1) * len(WORDS.findall(m[-1][1])) for m in below if m)
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(n))
        out.append((min(members), len(n), min(nodes[n[:-1]]) if n else None, len(members), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def chats():
    rnd = random.Random(9)
    rows = []
    for c in [*range(0, 45), *range(61, 75), 100, 101, 10**12, 10**12 + 3]:
        for t in range(rnd.randrange(1, 7)):
            rows.append((c, rnd.choice([t, t, t, None]), rnd.choice(["user", "assistant", None]), rnd.choice(["hi", "hi", "yes  no\tx", "", None, "é"])))
    rows += rows[:5] + [(None, 0, "user", "hi"), (200, 0, "user", "w " * 3000), *((201, t, "user", "again") for t in range(60))]
    return rows


@pytest.mark.parametrize("flush", [1, 7, 50_000])
def test_trie_equals_brute_force(spark, monkeypatch, flush):
    monkeypatch.setattr(prefix_trie, "FLUSH", flush)
    rows = chats()
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, node string, depth int").repartition(4)
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(turns).collect()), key=str)
    assert got == trie(rows)


def test_trie_of_no_turns_and_of_one(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert prefix_trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    rows = [(7, None, None, None)]
    assert sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, schema)).collect()), key=str) == trie(rows)


def test_ends_are_joined_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK", 20)
    rows = [(c, 0, "user", "same") for c in range(0, 400)]
    got = sorted((tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == trie(rows)


def test_blocks_of_markup():
    page = "<div class='Main-Text'><p>one<p>two &am; &eacute;<b>x</b>y<br>z</div> tail <ul><li>a<li>b</ul><script>if(a<b){}</script>after<table><tr><td>1<td>2</table><!-- <p>no --><a href=\"x>y\">link</a><p>&lt;p&gt; 1 < 2"
    assert [b.text for b in html_text.blocks(page)] == ["one", "two &am; éxy z", "tail", "a", "b", "after", "1", "2", "link", "<p> 1 < 2"]
    assert html_text.blocks(page)[0].path == ("div main text", "p")
    assert html_text.blocks(None) == html_text.blocks("") == html_text.blocks("<!-- <p>x") == html_text.blocks("<script>x") == []
    assert [b.text for b in html_text.blocks('<p a="x>never ends<p>b')] == ["never ends", "b"]


@pytest.mark.parametrize("unit", ["<div>a", '<a "', "<!", "<x>a", "</p>", "< ", "&amp", "<!-- ", "<p>a", "a "])
def test_long_pages_take_linear_time(unit):
    assert len(html_text.blocks(unit * 40_000)) <= 40_000


def test_labeller_reads_other_layouts(spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("html").collect()]
    model = html_text.Labeller()
    model.learn(html_text.examples(pages[:30], layouts=20))
    held_out = html_text.examples(pages[30:], layouts=10, seed=2)
    right = [(s >= 0.5) == (y > 0.5) for s, (_, y) in zip(model.scores([f for f, _ in held_out]), held_out, strict=True)]
    assert np.concatenate(right).mean() >= 0.98


def test_labeller_learns_by_right_gradients():
    batch = html_text.examples(["<nav><li>a b</nav><article><h1>x y z</h1><p>t u</article><footer>f</footer>"], layouts=2)
    model = html_text.Labeller()
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = [np.clip(x.astype(float), 1e-9, 1 - 1e-9) for x in model.scores([f for f, _ in batch])]
        return -np.concatenate([y * np.log(a) + (1 - y) * np.log(1 - a) for a, (_, y) in zip(s, batch, strict=True)]).mean()

    for name, g in model.gradients(batch).items():
        at = tuple(np.unravel_index(np.abs(g).argmax(), g.shape))
        old, step = model.p[name][at], 1e-2
        model.p[name][at] = old + step
        up = loss()
        model.p[name][at] = old - step
        assert (up - loss()) / (2 * step) == pytest.approx(g[at], rel=0.02, abs=1e-4)
        model.p[name][at] = old


def test_extraction_of_edge_rows(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    model = html_text.train(pages)
    long = "<nav><a>menu</a></nav><article>" + "<p>many words here</p>" * 3000 + "</article><footer>end</footer>"
    rows = [(1, "u", None), (2, "u", ""), (2, "u", ""), (3, "u", long), (None, None, "<article><p>a  b<p>c &amp; d</article>"), (4, "u", "<html><body></body></html>"), (5, "u", "<head><title>t</title><body><article><h1>x</h1>")]
    extra = spark.createDataFrame([(*r, "mine", 9) for r in rows], "page_id long, url string, html string, text string, __html2 int")
    got = sorted(((r.page_id, r.text) for r in html_text.extract(extra, model, ["page_id", "url"]).collect()), key=str)
    assert got == sorted([(1, ""), (2, ""), (2, ""), (3, " ".join(["many words here"] * 3000)), (None, "a b c & d"), (4, ""), (5, "x")], key=str)
    assert html_text.extract(extra.limit(0), html_text.train(extra.limit(0)), ["page_id"]).collect() == []
    again = html_text.train(pages.repartition(7))
    assert all((model.p[k] == again.p[k]).all() for k in model.p)
