"""The ten operators and the pipeline on small fixtures: brute force, exact round trips, edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import chat, components, decontaminate, jaccard, language, licenses, pieces, quality, secrets, token_counts, urls
from recordloom.llm import wordhash as wh

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rnd, n, vocab=400):
    return " ".join(f"w{int(rnd.paretovariate(0.6)) % vocab}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Prose, near and exact copies in groups, shared passages, empty and odd texts."""
    rnd = random.Random(5)
    out = [prose(rnd, rnd.randint(5, 200), 4000) for _ in range(60)]
    passage = prose(rnd, 60, 4000)
    for k in range(12):
        words = out[k].split()
        for copy in range(k):
            w = words.copy()
            for _ in range(copy % 4):
                w[rnd.randrange(len(w))] = f"x{rnd.randrange(9999)}"
            out.append(" ".join(w))
    out += [f"{passage} {prose(rnd, 30, 4000)}" for _ in range(8)]
    out += [None, "", "  \n\t ", "one", "one", "ONE", "a b c", "a b c d", "é à ü", "x " * 3000, "!" * 5000, "\x00\x1c\x85   y"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, None if i % 17 == 0 else "en", None if i % 13 == 0 else f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text, lower=False):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]+", lambda m: m[0].lower(), text)
    return SPLIT.findall(text)


def test_word_hashes_follow_words(texts):
    seen = {}
    for part in wh.slices(pa.array(texts), limit=700):
        found = wh.words(part, fold=wh.KEEP_CASE)
        for t in range(len(part.offsets) - 1):
            own = found.hashes[found.offsets[t] : found.offsets[t + 1]].tolist()
            want = words_of(texts[part.first + t])
            assert len(own) == len(want)
            for h, w in zip(own, want, strict=True):
                assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)


def test_token_counts(spark, docs, texts, empty):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = ["Σίσυφοσ ΟΔΟΣ", "a<|endoftext|>B <|startoftext|>", "İstanbul J̌ ǰ", "Ɤ \U00032808", "é ’s 'S don't", "汉字 mixed ١٢"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *odd])], "doc_id long, text string")
    for r in token_counts.count_tokens(rows).collect():
        text = [*texts, *odd][r.doc_id] or ""
        n = len(lib.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048), text[:50]
    assert token_counts.count_tokens(empty).count() == 0


def test_token_counts_of_all_characters():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), token_counts.counter("word_bpe_49k.json")
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for k in range(0, len(every), 40_000):
        said = [f"Ab{c}cD {c}{c}" for c in every[k : k + 40_000]]
        assert [own.count(s) for s in said] == [len(e.ids) for e in lib.encode_batch(said, add_special_tokens=False)]


def test_chat_round_trip(spark):
    texts = ["plain", "", None, "<|im_end|>", "<\\|x|>", "<\\\\|", "<<|im_start|>user", "a\nb", "<|im_end|>\n<|im_start|>assistant ok", "<", "|"]
    rows = [(i % 3, i, ["user", "assistant", "sys\n\\n<|tem", None][i % 4], t) for i, t in enumerate(texts)] + [(9, 0, "assistant", "same"), (9, 0, "assistant", "same"), (9, 3, "assistant", "long <|im_end|> " * 4000), (None, 1, "user", "x")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.text_parts(table))).collect()}
    for conv in {r[0] for r in rows}:
        want = sorted(((t, role or "", text or "") for c, t, role, text in rows if c == conv))
        assert [(t.role, t.text) for t in got[conv].turns] == [x[1:] for x in want]
        assert got[conv].loss_text == "".join(x[2] for x in want if x[1] == "assistant")
    assert chat.format_chats(chat.text_parts(table.limit(0))).count() == 0
    alone = table.withColumns({"conv_id": F.lit(None).cast("long"), "formatted": F.lit(1), "turns": F.lit(2), "blocks": F.lit(3), "spans": F.lit(4)})
    got = chat.read_back(chat.format_chats(chat.text_parts(alone))).collect()
    assert sorted((t.role, t.text) for r in got for t in r.turns) == sorted((role or "", text or "") for _, _, role, text in rows) and {len(r.turns) for r in got} == {1}


def test_chat_parts(spark):
    part = "array<struct<type: string, text: string, ref: string, width: int, height: int, seconds: double, pages: int>>"
    parts = [("text", "see <|image_pad|>", None, None, None, None, None), ("image", None, "a.png", 57, 28, None, None), ("audio", None, "b.wav", None, None, 1.5, None), ("document", None, "c.pdf", None, None, None, 2), (None, "end", None, None, None, None, None), ("vi<deo", None, "d", None, None, None, None)]
    r = chat.read_back(chat.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], f"conv_id long, turn long, role string, parts {part}"))).first()
    assert r.formatted.startswith("<|im_start|>user\nsee <\\|image_pad|><|image_pad|><|audio_pad|><|document_pad|>end<|vi_deo_pad|><|im_end|>\n")
    assert [(a.turn, a.type, a.ref, a.tokens) for a in r.attachments] == [(0, "image", "a.png", 3), (0, "audio", "b.wav", 38), (0, "document", "c.pdf", 1024), (0, "vi<deo", "d", 0)]
    assert r.expanded_tokens == 1065 and r.turns[1].text == ""


def test_quality_counts(docs, texts, empty):
    for r in quality.judge(docs).collect():
        text = texts[r.doc_id] or ""
        w = words_of(text)
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in text.split("\n") if words_of(x)]
        want = (len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality.judge(empty).count() == 0


def test_quality_sketches_merge(spark):
    rnd = random.Random(2)
    values = [int(rnd.expovariate(1 / 300)) for _ in range(4000)]
    rows = spark.createDataFrame([(i % 7, v) for i, v in enumerate(values)], "g long, v long").withColumns({m: F.col("v") for m in quality.METRICS})
    got = {r.metric: r for r in quality.quantiles(quality.merge(quality.sketch(rows, ["g"]), []), [], "a").collect()}
    for m, v in quality.METRICS.items():
        low, high = (sorted(values)[-(-len(values) * k // 100) - 1] for k in (v.low, v.high))
        assert got[m].a_n == 4000 and 0 <= low - got[m].a_low <= low / 64 and 0 <= high - got[m].a_high <= high / 64


def test_quality_thresholds_are_the_groups_own(spark):
    """One text of long words is an outlier in its source of short words and common in another."""
    rnd = random.Random(3)
    said = lambda n: " ".join("".join(rnd.choice("abcdefghij") for _ in range(n)) for _ in range(80))
    rows = [(i, said(4), "en", "short") for i in range(600)] + [(1000 + i, said(9), "en", "long") for i in range(600)] + [(5000, said(9), "en", "short"), (5001, said(4), "en", "long"), (5002, said(4), None, None), (5003, None, "en", "short"), (5004, "", "en", "new")]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert got[0].high_chars_per_word < 9000 <= got[1000].high_chars_per_word and got[1000].low_chars_per_word > 4000
    assert {i for i, r in got.items() if not r.kept} == {5000, 5001, 5003, 5004}


def test_quality_method_decides_on_the_drivers_tables(spark, sf_dir):
    """Thresholds differ between groups, and rows of one length are kept in one and rejected in another or beyond it."""
    rows = quality.judge(spark.read.parquet(f"{sf_dir}/documents.parquet")).filter("NOT base_failed").collect()
    assert len({r.high_chars_per_word for r in rows}) > 5
    beyond = [r for r in rows if not r.low_chars_per_word <= r.chars_per_word <= r.high_chars_per_word]
    assert beyond and not any(r.kept for r in beyond) and any(r.kept for r in rows)
    highest = max(r.high_chars_per_word for r in rows)
    assert any(r.chars_per_word < highest for r in beyond if r.chars_per_word > r.high_chars_per_word) or any(r.chars_per_word > highest for r in beyond)


def test_license_lines(spark, empty):
    rows = [(1, "x\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0"), (2, "released UNDER the mit-license"), (3, "The MIT License was released under protest by many people there"), (4, None), (5, ""), (6, "Released under the MIT License.")]
    extra = spark.createDataFrame([*rows, rows[0]], "doc_id long, text string").withColumns({c: F.lit(1) for c in ("w", "said", "license", "template", "start", "first", "place", "b", "dice")})
    got = {r.doc_id: r for r in licenses.scan(extra).collect()}
    assert (got[1].n_license_lines, got[1].licenses, got[1].best_license, got[1].best_dice) == (2, "apache-2.0,mit", "apache-2.0", 1.0)
    assert got[2].licenses == "mit" and [got[i].n_license_lines for i in (3, 4, 5)] == [0, 0, 0]
    assert licenses.scan(empty).count() == 0 and licenses.scan(extra, templates={}).filter("licenses <> ''").count() == 0


@pytest.mark.parametrize("few", [50_000, 0])
def test_license_texts_over_line_breaks(spark, few, monkeypatch):
    monkeypatch.setattr(licenses, "FEW", few)
    rnd = random.Random(12)
    prose_of = lambda n: " ".join(rnd.choice(["theron", "in", "the", "license", "of", "erst", "hand"]) for _ in range(n))
    wrap = lambda text, mark, n: "\n".join(mark + " ".join(text.split()[i : i + n]) for i in range(0, len(text.split()), n))
    every = [(name, text) for name, texts in sorted(licenses.TEMPLATES.items()) for text in texts]
    rows = [(i, prose_of(30) + "\n" + wrap(text, rnd.choice(["# ", "// ", " * ", ""]), rnd.randint(3, 9)) + "\n" + prose_of(40)) for i, (_, text) in enumerate(every)]
    changed = licenses.TEMPLATES["mit"][-1].split()
    for k in range(5, len(changed), 19):
        changed[k] = "theron"
    rows += [(900, "This project is released under the MIT License."), (901, "We say that it is licensed under the MIT License, more or less."), (902, prose_of(20_000) + " ".join(changed) + prose_of(500)), (903, prose_of(3000)), (904, "Permission to use, copy,\nmodify, and/or distribute this software for any\npurpose with or without fee is hereby granted."), (905, "free software " * 40)]
    edge = licenses.TEMPLATES["mit"][-1]
    rows += [(1000 + k, prose_of(licenses.PART - k) + " " + edge) for k in (1, 2, 60, len(edge.split()), 200)] + [(1100, edge * 60)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert all(r.best_dice == 1.0 and "mit" in r.licenses for i, r in got.items() if i >= 1000)
    for i, (name, _) in enumerate(every):
        assert name in got[i].licenses.split(",") and got[i].best_dice == 1.0, (i, name, got[i])
    assert [got[i].licenses for i in (900, 901, 902, 903, 904, 905)] == ["mit", "mit", "mit", "", "isc", ""] and 0.8 <= got[902].best_dice < 1


def test_license_anchors_lose_no_line(spark):
    """Against every pair of a line and a template, without anchors or bounds."""
    rnd = random.Random(13)
    texts = {"a": ["one two three four five six seven", "two three"], "b": ["three four five six one two three four", "seven six five four three two one"]}
    numbers = "one two three four five six seven".split()
    lines = [" ".join(w if rnd.random() < 0.8 else rnd.choice(numbers) for w in rnd.choice([x for ts in texts.values() for x in ts]).split()[rnd.randint(0, 2) :]) for _ in range(400)]
    pairs_of = lambda w: set(zip(w, w[1:], strict=False))
    want = {}
    for i, line in enumerate(lines):
        b = pairs_of(line.split())
        scored = [(-2 * len(b & pairs_of(t.split())) / (len(b) + len(pairs_of(t.split()))), name) for name, ts in texts.items() for t in ts if b]
        hit = min((s for s in scored if s[0] <= -0.5), default=None)
        if hit:
            want[i] = (hit[1], -hit[0])
    found = licenses.license_matches(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), templates=texts, percent=50).filter("kind = 'line'").collect()
    assert {r.doc_id: (r.license, r.dice) for r in found} == want and len(want) > 100


def test_license_bounds_lose_nothing():
    for least in range(1, 30):
        low, high = licenses.size_bounds(least, least)
        for n in range(1, 80):
            if 2 * min(n, least) * 100 >= 80 * (n + least):
                assert low <= n <= high


def brute_language(model, text):
    """Score of the most probable language, n-gram by n-gram."""
    marked, counts = [0], Counter()
    for c in (text or "").lower():
        code = ord(c) if c.isalpha() else 0
        if code or marked[-1]:
            marked.append(code)
    if marked[-1]:
        marked.append(0)
    if not any(marked):
        return "und", 0.0
    keys, full = [int(k) for k in language._KEYS], 1 << 64
    for i, c in enumerate(marked):
        for n in (1, 2, 3):
            gram = marked[i : i + n]
            if len(gram) == n and not (n == 1 and not c):
                h = sum((g + (k > 0)) * keys[k] for k, g in enumerate(gram)) % full
                counts[((h ^ (h >> 29)) * keys[0] % full) >> (64 - 15)] += 1
    x = {b: (1 + np.log(n)) * model.idf[b] for b, n in counts.items()}
    norm = sum(v * v for v in x.values()) ** 0.5
    z = [sum(v / norm * model.weights[model.row[b]][k] for b, v in x.items()) / model.temperature for k in range(len(model.langs))]
    p = [np.exp(v - max(z)) / sum(np.exp(w - max(z)) for w in z) for v in z]
    return model.langs[p.index(max(p))], max(p)


def test_language_sample_is_bounded_and_by_text(spark):
    rows = spark.createDataFrame([(f"text {i}", "aa") for i in range(3000)] + [("copy", "aa")] * 3000 + [("few", "bb"), ("few", "bb"), ("zz", "bb")], "text string, lang string").repartition(7)
    got = language.sampled(rows, {"aa": 3001, "bb": 2}, 100).collect()
    counted = Counter(r.lang for r in got)
    assert counted == {"aa": 100, "bb": 2} and len({r.text for r in got}) == 102
    again = language.sampled(rows.repartition(2), {"aa": 2900, "bb": 2}, 100).collect()
    assert {r.text for r in again} == {r.text for r in got}


@pytest.mark.parametrize("kind", ["string", "long", "double"])
def test_language_takes_any_ids(spark, kind):
    rnd = random.Random(1)
    rows = [(None if i % 3 == 0 else str(i % 5), " ".join(rnd.choice(w.split()) for _ in range(12)), l) for i in range(60) for l, w in (("aa", "lano rede sibi nuto"), ("bb", "xyrk vlod grum tzak"))]
    table = spark.createDataFrame(rows, "doc_id string, text string, lang string").withColumn("doc_id", F.col("doc_id").cast(kind))
    got = language.identify(table, language.corpus_model(table)).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang for r in got)
    same = language.Model(["aa", "bb"], np.ones(language.BUCKETS), np.zeros(language.BUCKETS, np.int32), np.zeros((1, 2)), 1.0)
    assert language.predict(same, "tie") == ("aa", 0.5)


def test_language(spark, empty):
    rnd = random.Random(8)
    make = {"aa": "lano rede sibi nuto", "bb": "xyrk vlod grum tzak", "cc": "žeš čaň řiť ůmo"}
    rows = [(i, " ".join(rnd.choice(make[l].split())[::-1] + rnd.choice(make[l].split()) for _ in range(rnd.randint(5, 60))), l) for i, l in enumerate(rnd.choices(list(make), k=400))]
    rows += [(1000, None, "aa"), (1001, "", "bb"), (1002, "12 !?", "cc"), (1003, "lano rede", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.corpus_model(table)
    got = {r.doc_id: r for r in language.identify(table.withColumn("ho", language.held_out()), model).collect()}
    assert all(got[i].ho == (zlib.crc32(str(i).encode()) % 4 == 2) for i, *_ in rows)
    tested = [(got[i].lang_pred, l) for i, t, l in rows if got[i].ho and i < 1000]
    assert sum(a == b for a, b in tested) / len(tested) > 0.98
    assert [(got[i].lang_pred, got[i].score) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003].lang_pred == "aa" and all(0 <= r.score <= 1 for r in got.values())
    assert model.temperature > 0.01 and len(model.weights) < language.BUCKETS / 2
    texts = [r[1] for r in rows] + ["LANO rede!?", "čaň", "É", "a" * 50_000, "mixed lano xyrk ůmo" * 900]
    assert all(np.isclose(language.predict(model, t)[1], brute_language(model, t)[1]) and language.predict(model, t)[0] == brute_language(model, t)[0] for t in texts)
    none = language.corpus_model(empty)
    assert {r.lang_pred for r in language.identify(table, none).collect()} == {"und"}


def test_calibration_finds_the_temperature():
    rng = np.random.default_rng(1)
    logits = rng.normal(size=(4000, 3)) * 2
    y = np.array([rng.choice(3, p=p) for p in language.softmax(logits)])
    assert 0.85 < language.calibrate(logits, y) < 1.15 and 2.5 < language.calibrate(logits * 3, y) < 3.5


def test_pieces_are_the_librarys(spark, docs, texts, empty):
    import sentencepiece

    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL))
    found = pieces.encode(docs)
    got = {r.doc_id: r for r in found.collect()}
    for i, t in enumerate(texts):
        assert got[i].ids == (lib.encode(t) if t else []) and got[i].n_pieces == len(got[i].ids)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(got[i].ids, "<i4").tobytes()).hexdigest() and got[i].round_trip
    assert {r.doc_id: r.text for r in pieces.decode(found).collect()} == {i: t or "" for i, t in enumerate(texts)}
    assert pieces.encode(empty).count() == 0


def test_pieces_stream_in_a_bounded_window():
    import sentencepiece

    lib, p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL)), pieces.pieces()
    rnd = random.Random(4)
    for letters in ("the", "ab", " ", "—é漢😀", "aeiounrst .,", "0123456789abcdef", "▁ x"):
        for n in (1, 17, 500, 4000):
            text = "".join(rnd.choice(letters) for _ in range(n))
            assert np.frombuffer(p.encode(text), "<i4").tolist() == lib.encode(text), (letters, n)
    parts = list(p.search("theing" * 3000))
    assert len(parts) > 50 and max(map(len, parts)) < 200


def test_pieces_that_begin_at_a_committed_joint():
    import sentencepiece

    lib, p = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pieces.MODEL)), pieces.pieces()
    for c in "-*=_#./":
        for n in (150, 193, 400, 1700, 5000):
            for lead in range(65) if n <= 400 else (0, 1, 15, 31, 64):
                text = "a" * lead + c * n
                assert np.frombuffer(p.encode(text), "<i4").tolist() == lib.encode(text), (c, n, lead)


def test_urls(spark):
    rows = [(1, "http://A.Com/x?y"), (2, "https://www.example.com/en/1"), (3, "https://m.example.com/en/2#z"), (4, "ftp://q.net/fr/9"), (5, "net/es/"), (6, None), (7, "://"), (8, "http://netnet/es/"), (9, "http://b.net"), (10, "http://x.org//a///b7/c/d/e/f/g"), (11, "http://com/")]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(1, 10)] == [("a.com", "/x", "com/"), ("www.example.com", "/en/1", "www.example.com/en/"), ("m.example.com", "/en/2", "example.com/en/"), ("q.net", "/fr/9", "net/fr/"), ("", "", None), ("", "", None), ("", "", None), ("netnet", "/es/", None), ("b.net", "", None)]
    assert got[10].template == "/*/*/*/*/*/*/*" and got[11].verdict == "allow"
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def shape_verdicts(spark, rows):
    table = urls.shaped(spark.createDataFrame(rows, "host string, path string, label string"))
    return {(r.host, r.template): r.rejected for r in urls.template_verdicts(table).collect()}


def test_url_templates_learn_from_labels(spark):
    rows = [("h", f"/good/{i}", "allow") for i in range(60)] + [("h", f"/bad/{i}", "block" if i < 80 else None) for i in range(90)]
    assert shape_verdicts(spark, rows) == {("h", "/good/*"): False, ("h", "/bad/*"): True}
    letters = "abcdefghijklmnopqrstuvwxyz"
    slugs = [("h", f"/{x}{y}/deep/er/and/deep{z}/page", None) for x in letters for y in letters[:10] for z in "ab"]
    got = shape_verdicts(spark, rows + slugs)
    assert got["h", "/bad/*"] and not got["h", "/*/deep/er/and/deepa/page"] and not got["h", "/*/deep/er/and/deepb/page"] and len(got) == 4


def test_url_templates_keep_a_rare_branch_with_other_labels(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [("h", f"/{x}{y}/p", "allow") for x in letters for y in letters] + [("h", "/spam/p", "block")] * 8
    assert shape_verdicts(spark, rows) == {("h", "/*/p"): False, ("h", "/spam/p"): False}
    assert shape_verdicts(spark, rows + [("h", "/spam/p", "block")] * 60)["h", "/spam/p"]


def test_url_verdicts_dont_depend_on_the_number_of_children(spark):
    """Few blocked urls on a host never reject many unlabelled ones under other segments, however many those are."""
    names = [a + b for a in "abcdefgh" for b in "klmnopq"]
    for k in (5, 16, 17, 40, 56):
        rows = [("x.net", f"/es/{i}", "block") for i in range(40)] + [("x.net", f"/{names[i % k]}/{i}", None) for i in range(2000)]
        table = urls.shaped(spark.createDataFrame(rows, "host string, path string, label string"))
        assert not any(r.rejected for r in urls.template_verdicts(table).collect() if r.shape != "es/*")


def test_url_namesakes_are_a_weak_prior(spark):
    rows = [("a.com", f"/en/{i}", "block") for i in range(90)] + [("a.com", f"/de/{i}", "allow") for i in range(90)] + [(h, f"/{s}/{i}", None) for h in ("b.org", "c.org") for s in ("en", "de", "xx") for i in range(40)]
    got = shape_verdicts(spark, rows)
    assert got["a.com", "/en/*"] and not any(v for k, v in got.items() if k[0] != "a.com")
    few = [("b.org", f"/en/9{i}", "block") for i in range(8)]
    assert shape_verdicts(spark, rows + few)["b.org", "/en/*"] and not shape_verdicts(spark, rows[90:] + few)["b.org", "/en/*"]


def test_url_method_on_the_drivers_tables(spark, sf_dir):
    """Rows without a rule are judged by their own host's labels, and a template's rows alike."""
    rows = urls.judge(spark.read.parquet(f"{sf_dir}/../sf0.01/pages.parquet")).filter("rule IS NULL").collect()
    assert all((r.verdict == "block") <= (r.purity >= urls.REJECT) for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.host, r.template), set()).add(r.verdict)
    assert all(len(v) == 1 for v in by.values())


def sets_of(texts):
    out = []
    for t in texts:
        w = words_of(t, True)
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_components(texts):
    sets, parent = sets_of(texts), list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(texts))], list(map(len, sets))


@pytest.mark.parametrize("hot, shard", [(1 << 18, 1 << 20), (2, 700)])
def test_jaccard_components(docs, texts, empty, monkeypatch, hot, shard):
    monkeypatch.setattr(jaccard, "HOT_TEXTS", hot)
    monkeypatch.setattr(jaccard, "SHARD_SHINGLES", shard)
    want, sizes = brute_components(texts)
    got = {r.doc_id: r for r in jaccard.near_duplicates(docs).collect()}
    assert [got[i].component_id for i in range(len(texts))] == want and [got[i].n_shingles for i in range(len(texts))] == sizes
    kept = {r.doc_id for r in jaccard.keep_one(docs).collect()}
    assert kept == {i for i, c in enumerate(want) if i == c}
    assert jaccard.near_duplicates(empty).count() == 0


def test_jaccard_hot_shingles_are_found(docs):
    rows, frequent = jaccard.describe(docs.repartition(1), ["doc_id"], "text", 5)
    assert rows.count() == docs.count() and rows.columns == ["doc_id", "n_shingles", "cls"]
    counted = Counter(x for s in {frozenset(s) for s in sets_of([r.text for r in docs.collect()])} for x in s)
    got = {r.shingle: r.n for r in frequent.collect()}
    assert sorted(got.values()) == sorted(n for n in counted.values() if n > 1)
    assert len(jaccard.hot_shingles(frequent, jaccard.HOT_SHINGLES * 8)) == 0


def test_frequent_counts_are_low_by_the_slices_at_most():
    rng = np.random.default_rng(4)
    slices = [np.concatenate([rng.integers(0, 20, 30), rng.integers(100, 10**6, 200)]).astype(np.uint64) for _ in range(50)]
    counted, count = jaccard._Frequent(), Counter(x for s in slices for x in s.tolist())
    for s in slices:
        counted.add(s)
    got = dict(zip(*(a.tolist() for a in counted.most()), strict=True))
    assert all(n - 50 <= got[k] <= n for k, n in count.items() if n > 100) and all(got[k] <= count[k] for k in got)


def test_jaccard_near_the_border(spark):
    """Many near copies of one base that link with it but seldom with each other, and chains."""
    rnd = random.Random(9)
    base = [f"b{i}" for i in range(90)]
    texts = [" ".join(base)]
    for _ in range(150):
        w = base.copy()
        for _ in range(rnd.randint(1, 4)):
            w[rnd.randrange(90)] = f"y{rnd.randrange(10**6)}"
        texts.append(" ".join(w))
    chain = base[::-1]
    for k in range(20):
        chain = chain[2:] + [f"c{k}", f"d{k}"]
        texts.append(" ".join(chain))
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(7)).collect()}
    assert [got[i] for i in range(len(texts))] == brute_components(texts)[0]


def test_jaccard_repeated_rows(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "q"), (3, None), (3, None)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0), (r.component_id or 0)) for r in jaccard.near_duplicates(rows).collect())
    assert got == [(0, 0), (1, 1), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert sorted((r.doc_id or 0) for r in jaccard.keep_one(rows).collect()) == [0, 1, 3]


def test_keep_one_tells_texts_of_one_id_apart(spark):
    a, b, c = "a b c d e f", "k l m n o p q", "r s t u v w x y"
    near = [" ".join(f"z{i}" for i in range(60)), " ".join(f"z{i}" for i in range(60)) + " end"]
    rows = [(1, a, "s"), (2, a, "s"), (2, b, "s"), (3, b, "t"), (3, c, "s"), (None, a, "s"), (None, c, "s"), (None, "only null", "s"), (None, "only null", "t"), (7, near[0], "s"), (7, near[1], "s"), (8, None, "t"), (8, None, "s"), (9, "", "s")]
    want = {(1, a, "s"), (2, b, "s"), (3, c, "s"), (None, "only null", "s"), (8, None, "s"), (9, "", "s")}
    for parts in (1, 5):
        got = [tuple(r) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)).collect()]
        of_near = [r for r in got if r[1] in near]
        assert len(of_near) == 1 and len(got) == len(want) + 1 and set(got) - set(of_near) == want


def test_components(spark):
    rnd = random.Random(6)
    links = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(links, "a long, b long").repartition(6)).collect()}
    parent = {x: x for e in links for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(parent[a], parent[b])
            changed |= parent[a] != m or parent[b] != m
            parent[a] = parent[b] = m
    assert {n: got.get(n, n) for n in parent} == parent
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_secrets(spark, docs, empty):
    rnd = random.Random(5)
    bits = ["token", "password", "api_key", "APIkey", "=", ": ", "'", '"', " ", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH1234567", "gho_", "é", "\n", ",", "deadbeef", "==", "eyJab.", "xyz-_12345", "-----BEGIN RSA PRIVATE KEY-----", "xoxb-", "12-34-56-78-9a"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randint(0, 50))) for _ in range(1500)] + [None, "", "f" * 20_000, "token=" + "a" * 11, "token=" + "a" * 12]
    rules = [(re.compile(("(?i:%s)" if r.any_case else "(?:%s)") % r.lead + f"({r.body}+)"), r) for r in secrets.RULES]
    got = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        spans = sorted((m.start(), k, m.end()) for k, (p, r) in enumerate(rules) for m in p.finditer(t or "") if len(m[m.lastindex]) >= r.least)
        assert got[i].spans == ",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in spans)
        base = [(a, k, b) for a, k, b in spans if k < 3]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{secrets.RULES[k].kind}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
    assert secrets.find_secrets(empty).count() == 0
    clean = spark.createDataFrame([(1, "é token = 'abcdefabcdefabcdef' x", "en", "s", 1), (2, None, None, None, None)], SCHEMA)
    assert [r.text for r in secrets.redact(clean).orderBy("doc_id").collect()] == ["é [assign]' x", None]


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, empty, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    monkeypatch.setattr(decontaminate, "HOT", 100)
    rnd = random.Random(3)
    items = [(i, prose(rnd, n, 3000)) for i, n in enumerate([30, 12, 10, 9, 4, 1])] + [(10, prose(rnd, 20, 3000).upper()), (11, None), (12, "..."), (13, "the the the the the the the the the the the")]
    items.append((14, items[0][1]))
    rows = [(i, prose(rnd, rnd.randint(0, 120), 3000)) for i in range(60)]
    for k in range(60, 100):
        w = rows[k - 60][1].split()
        cut = (items[k % len(items)][1] or "").split()
        a = rnd.randrange(max(1, len(cut)))
        rows.append((k, " ".join([*w, *cut[a : a + rnd.randint(1, 15)], *w]).replace(" ", rnd.choice([" ", ", ", "\n"]))))
    rows += [(200, None), (201, ""), (202, "the " * 300), (200, None), (60, "other text")]
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    split = lambda t: word.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
    wins = {(i, tuple(w[a : a + 10])) for i, t in items if (w := split(t)) for a in range(max(1, len(w) - 9))}
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in decontaminate.contamination(table, bench).collect())
    want = Counter()
    for i, t in rows:
        w, hit, ids = split(t), set(), set()
        for item, win in wins:
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    ids.add(str(item))
        want[(i, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))] += 1
    assert got == want
    assert decontaminate.contamination(empty, bench).count() == 0
    assert {r.n_hit for r in decontaminate.contamination(table, bench.limit(0)).collect()} == {0}


def test_private_keys_are_redacted_whole(spark):
    key = "-----BEGIN RSA PRIVATE KEY-----\nMIIEow+/AAA=\nabc123\n"
    end = "-----END RSA PRIVATE KEY-----"
    rows = [(1, f"a {key}{end} b"), (2, f"a {key}. b"), (3, f"é {key}{key}{end}!"), (4, f"{key}{end}{key}{end}")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a [private_key] b", 2: "a [private_key]. b", 3: "é [private_key][private_key]!", 4: "[private_key][private_key]"}


def test_token_memo_is_bounded(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 50)
    monkeypatch.setattr(token_counts, "LONG", 1000)
    own = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    rnd = random.Random(2)
    text = " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.choice([5, 9, 90]))) for _ in range(3000))
    assert own.count(text) == len(own._library.encode(text, add_special_tokens=False).ids)
    assert len(own._memo) <= 50 + len(own.whole) and max(map(len, set(own._memo) - own.whole)) <= token_counts.MEMO_LENGTH


def test_decontamination_deals_no_words_by_token(spark, docs, capsys):
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), decontaminate.words(F.col("text")).alias("w"))
    rare = decontaminate.prefixes(decontaminate.distinct_windows(decontaminate.windows(docs.withColumnRenamed("doc_id", "item_id"))), base, False)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        decontaminate._dealt_hits(base, rare).explain("formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    dealt = re.findall(r"Exchange\nInput \[\d+\]: \[(.*)\]\nArguments: hashpartitioning\(token#", capsys.readouterr().out)
    assert len(dealt) >= 2 and not any(re.search(r"\b(w|words|said)#", columns) for columns in dealt)


def test_extra_columns_do_not_clash(spark, docs):
    extra = docs.withColumns({c: F.lit(1) for c in ("n_words", "cls", "w", "token", "score", "lang_pred", "spans", "kept", "__text", "text_key", "line", "size", "a", "b", "ids")})
    assert jaccard.keep_one(extra).columns == extra.columns
    n = docs.count()
    for f in (quality.judge, secrets.find_secrets, licenses.scan, token_counts.count_tokens, pieces.encode, jaccard.near_duplicates):
        assert f(extra).count() == n
    assert secrets.redact(extra).columns == extra.columns


CLASHING = ("n_words", "cls", "comp", "w", "token", "score", "lang_pred", "spans", "kept", "__text", "text_key", "line", "size", "a", "b", "ids", "shingle", "host", "path", "rule", "label", "shape", "formatted", "turns", "start", "window", "n")


def edge_table(spark):
    """Nulls in any column, empty and very long texts, repeated ids; every row twice, with extra columns of clashing names."""
    rnd = random.Random(14)
    long = prose(rnd, 40_000, 9000) + " token = abcdefghijklmnop\nReleased under the MIT License."
    unbroken = "ab1" * 60_000
    rows = [(1, None, "en", "s1"), (2, "", None, "s1"), (3, long, "en", None), (3, long + " more", "en", "s1"), (None, "only words and nothing else here", None, None), (None, None, None, None), (4, unbroken, "de", "s2"), (5, "\n \t", "de", "s2"), (6, "é" * 9000, "fr", "s2")]
    table = spark.createDataFrame([r for r in rows for _ in range(2)], "doc_id long, text string, lang string, source string").repartition(3)
    return table.withColumns({c: F.lit(7) for c in CLASHING})


def test_edge_rows_in_every_operator(spark):
    table = edge_table(spark)
    bench = spark.createDataFrame([(1, "only words and nothing else here"), (None, "ab1"), (2, None), (2, "")], "item_id long, text string").withColumns({c: F.lit(7) for c in CLASHING})
    model = language.corpus_model(table)
    runs = {
        "1": token_counts.count_tokens, "3": quality.judge, "4": licenses.scan, "5": lambda t: language.identify(t, model), "6": pieces.encode, "8": jaccard.near_duplicates, "9": secrets.find_secrets,
        "10": lambda t: decontaminate.contamination(t, bench), "redact": secrets.redact, "7": lambda t: urls.judge(t, "doc_id", "text"),
    }
    for name, run in runs.items():
        got = Counter(map(repr, run(table).collect()))
        assert sum(got.values()) == table.count() and all(n % 2 == 0 for n in got.values()), name
        assert run(table.limit(0)).count() == 0, name
    kept = jaccard.keep_one(table)
    texts = Counter((r.doc_id, (r.text or "").removesuffix(" more")) for r in kept.collect() if (r.text or "").strip())
    assert kept.columns == table.columns and texts == Counter({(r.doc_id, r.text.removesuffix(" more")) for r in table.collect() if (r.text or "").strip()})
    clean = decontaminate.drop_contaminated(table, bench)
    assert clean.columns == table.columns and clean.filter("text LIKE 'only words%'").count() == 0
    chats = chat.format_chats(chat.text_parts(table.withColumns({"conv_id": F.col("doc_id"), "turn": F.lit(None).cast("long"), "role": F.col("lang")})))
    assert sum(len(r.turns) for r in chat.read_back(chats).collect()) == table.count()


def test_pipeline_of_no_rows(spark, sf_dir, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/benchmark.parquet").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("n", [2, 3, 4])
def test_pipeline_rejects_texts_in_no_learned_language(spark, n):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(n)
    make = ["lano rede sibi nuto", "xyrk vlod grum tzak", "žeš čaň řiť ůmo", "thap qhuw ooje fepf"][:n]
    said = lambda k, words: " ".join(rnd.choice(make[k].split()) for _ in range(words))
    rows = [(i, said(i % n, rnd.randint(5, 60)), f"l{i % n}", "s", 1) for i in range(400)]
    rows += [(1000 + i, said(i % n, 4), None, "s", 1) for i in range(12)]
    junk = ["".join(rnd.choice("абвгдежзийклмнопрст ") for _ in range(rnd.randint(20, 300))) for _ in range(20)]
    rows += [(2000 + i, t, None, "s", 1) for i, t in enumerate(junk)]
    kept = {r.doc_id for r in pipeline.language_id(spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert kept == {r[0] for r in rows if r[0] < 2000}


def test_pipeline_against_brute_force(spark, sf_dir, tmp_path, texts):
    pipeline = pytest.importorskip("corpus_pipeline")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    passage = bench.orderBy("item_id").first().text
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(900, "some words here " + passage, "en", "s", 1), (901, "clean text token = abcdefghijklmnop", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    all_docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    named = {r.doc_id for r in pipeline.language_id(spark, all_docs, str(tmp_path)).collect()}
    left = [(i, t) for i, t, *_ in rows if i in named]
    assert {i for i, t in left} == {i for i, t, *_ in rows if any(c.isalpha() for c in t or "")}
    comp, _ = brute_components([t for _, t in left])
    kept = {left[k][0] for k, c in enumerate(comp) if k == c} - {900}
    assert set(got) == kept
    p = pieces.pieces()
    for i, t in left:
        if i in kept:
            want = re.sub("(?i)token = [a-z]{12,}", "[assign]", t)
            assert p.decode(got[i].ids) == want and got[i].n_chars == len(want)
