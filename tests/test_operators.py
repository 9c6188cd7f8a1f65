import difflib
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import audit as A
from recordloom.operators import chapters as C
from recordloom.operators import match as M
from recordloom.operators import results as R
from recordloom.operators import review as V
from recordloom.operators.search import search
from recordloom.plans import layout as L
from recordloom.sources import ingest as I
from recordloom.sources.xlsx import XlsxSource, read_rows, write_rows
from recordloom.streaming.linkage import link_stream
from recordloom.vocab import DEFAULT


def tables(spark, n=60, m=80, seed=3):
    rnd = random.Random(seed)
    words = "alpha beta gamma delta omega sigma kappa theta zeta iota".split()
    name = lambda: " ".join(rnd.choices(words, k=rnd.randint(1, 4)))
    src = spark.createDataFrame([(i, name()) for i in range(n)], "q long, name string")
    return src, spark.createDataFrame([(i, f"C{i}", name()) for i in range(m)], "idx long, code string, name string")


def test_blocked_path_agrees_with_all_pairs(spark):
    """Fewer targets than can be candidates: the best of all that share a token, or of all within the length band, is found."""
    src, tgt = tables(spark, m=40)
    a, b = M.prepared(src), M.prepared(tgt)
    pairs = a.select("q").crossJoin(b.select("idx", F.lit(1).alias("rank")))
    scores = {(r.q, r.idx): r.score for r in M.scored(pairs, a, b, None, 0.7, sequences=False).collect()}
    sources, targets = {r.q: r.clean for r in a.collect()}, {r.idx: r.clean for r in b.collect()}
    got = {r.q: r for r in M.link(src, tgt, sequences=False).collect()}
    assert len(got) == len(sources)
    for q, name in sources.items():
        near = [i for i, t in targets.items() if set(name.split()) & set(t.split())]
        near = near or [i for i, t in targets.items() if abs(len(name) - len(t)) <= M.BAND * max(len(name), len(t))]
        best = max((scores.get((q, i), 0) for i in near), default=0)
        if name in targets.values():
            assert got[q].match_score == 100
        elif best >= 0.7:
            assert got[q].match_code and (abs(got[q].match_score - best * 100) <= 0.051 or got[q].match_score >= 98)
        else:
            assert (got[q].match_code, got[q].match_score) == ("", 0.0)


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_links_do_not_depend_on_partitions(spark, parts):
    src, tgt = tables(spark)
    want = sorted(map(tuple, M.link(src, tgt).collect()))
    assert sorted(map(tuple, M.link(src.repartition(parts), tgt.repartition(parts)).collect())) == want


def test_empty_catalogs(spark):
    src, tgt = tables(spark)
    assert M.link(src.limit(0), tgt).count() == 0
    assert {r.match_code for r in M.link(src, tgt.limit(0)).collect()} == {""}


def test_barrier_blocks_a_close_name(spark):
    src = spark.createDataFrame([(1, "Khâu phục hồi rách âm hộ")], "q long, name string")
    tgt = spark.createDataFrame([(1, "A", "Khâu phục hồi rách bờ mi")], "idx long, code string, name string")
    assert M.link(src, tgt, DEFAULT, 0.4).first().match_code == ""


def test_first_target_wins(spark):
    src = spark.createDataFrame([(1, "Cắt *ruột")], "q long, name string")
    tgt = spark.createDataFrame([(2, "B", "cắt ruột"), (1, "A", "Cắt-ruột")], "idx long, code string, name string")
    assert M.link(src, tgt, DEFAULT).first().match_code == "A"


def test_search_tiers(spark):
    items = spark.createDataFrame([(1, "K1", "khâu da"), (2, "K12", "khâu da đầu"), (3, "X", "cắt khâu da"), (4, "Y", "da khâu"), (5, "Z", "nội soi")], "idx long, code string, name string")
    q = spark.createDataFrame([(1, "khâu da"), (2, "K1"), (3, " "), (4, "noi")], "query_id long, query string")
    got = {}
    for r in search(q, items).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.idx, r.score, r.match_type))
    assert [x[0] for x in got[1]] == [1, 2, 3, 4] and [x[2] for x in got[1]] == ["EXACT", "PREFIX", "SUBSTRING", "ALL_WORDS"]
    assert got[2][0] == (1, 100.0, "CODE") and got[2][1][:2] == (2, 98.0)
    assert [x[0] for x in got[3]] == [1, 2, 3, 4, 5]
    assert got[4][0][0] == 5


def test_both_low_audits_make_medium(spark):
    df = spark.createDataFrame([("a b", "a c", "a d", 50.0, 50.0)], "g string, x string, y string, s double, t double")
    got = A.audit_row(A.audit_pair(A.audit_pair(df, "g", "x", "s", "p"), "g", "y", "t", "q"), "p", "q").first().audit
    assert (got.severity, got.flag, got.type) == ("MEDIUM", "BOTH", "LOW_CONFIDENCE")


def test_external_audit_falls_back(spark):
    def fails(pdf):
        raise RuntimeError

    rows = spark.createDataFrame([(1, "rule"), (2, "rule")], "row_id long, audit string")
    verdicts = A.external_audit(rows, lambda pdf: pdf.assign(audit="service")[lambda d: d.row_id == 1], "row_id long, audit string")
    assert {r.row_id: r.audit for r in A.merge_verdicts(rows, verdicts).collect()} == {1: "service", 2: "rule"}
    assert A.external_audit(rows, fails, "row_id long, audit string").count() == 0


def test_chapters_across_blocks(spark):
    rnd = random.Random(1)
    data = [(i, rnd.choice(["M", "N", None, None]), f"t{i}") for i in range(200)]
    df = spark.createDataFrame(data, "row_no long, kind string, t string")
    got = {r.row_no: r.chapter for r in C.fill_chapters(df, F.when(F.col("kind") == "M", F.col("t")), F.when(F.col("kind") == "N", F.col("t")), block=7).collect()}
    major = minor = None
    for i, kind, t in data:
        if kind == "M":
            major, minor = t, None
        elif kind == "N":
            minor = t
        assert got[i] == " > ".join(x for x in (major, minor) if x)


def test_edits_locks_and_sessions(spark, tmp_path):
    rows = spark.createDataFrame([(1, "A", "a", 90.0, False, False, None), (2, "B", "b", 80.0, True, True, None)], "row_id long, code_1 string, name_1 string, score_1 double, is_locked boolean, is_manual_override boolean, locked_at timestamp")
    cleared = {r.row_id: (r.code_1, r.score_1) for r in R.clear_match(rows, spark.createDataFrame([(1, "PL1"), (2, "PL2")], "row_id long, side string")).collect()}
    assert cleared == {1: ("", 0.0), 2: ("B", 80.0)}
    locked = {r.row_id: (r.is_locked, r.locked_at is not None) for r in R.toggle_lock(rows, rows.select("row_id")).collect()}
    assert locked == {1: (True, True), 2: (False, False)}
    path = str(tmp_path / "sessions")
    R.save_session(rows, path, "one")
    R.save_session(rows.limit(1), path, "two")
    R.save_session(rows.limit(1), path, "one")
    assert R.load_session(spark, path, "one").count() == 1
    assert {r.session_id: r.n_results for r in R.list_sessions(spark.read.parquet(path)).collect()} == {"one": 1, "two": 1}
    assert R.session_json(rows).first().value.startswith('{"row_id":1')


def test_specialties(spark):
    df = spark.createDataFrame([("I. Nội khoa > Tim mạch", "tim", "Tim mạch"), (None, None, "Mắt"), ("IX. Mắt", None, "mắt"), ("Da liễu", None, "Mắt")], "s string, a string, w string")
    assert [r.x for r in df.select(R.specialty_matches(F.col("s"), F.col("a"), F.col("w"), False).alias("x")).collect()] == [True, False, True, False]


def test_layout():
    cols = [{"id": c, "title": c.upper(), "order": i, "selected": c != "d"} for i, c in enumerate("abcd", 1)]
    order = lambda x: [c["id"] for c in sorted((c for c in x if c["selected"]), key=lambda c: c["order"])]
    assert order(L.move_to(cols, "a", 3)) == ["c", "b", "a"] and order(L.move_to(cols, "a", 9)) == ["a", "b", "c"]
    assert order(L.nudge(cols, "b", -1)) == ["b", "a", "c"] and order(L.insert_at(cols, "c", 1)) == ["c", "a", "b"]
    assert order(L.toggle(cols, "d")) == ["a", "b", "c", "d"] and order(L.toggle(cols, "a")) == ["b", "c"]
    assert order(L.reset(L.add_extra(cols, "E"), cols)) == ["a", "b", "c", "extra_1"]


def test_workbook_to_catalog(spark, tmp_path):
    path = str(tmp_path / "source.xlsx")
    sheet = [["Danh sách"], ["TT", "Mã TT 43", "Danh mục kỹ thuật", "A"], ["", "", "I. Nội khoa", ""], ["1", "01.01", "Siêu âm tim", "x"], ["", "", "TIM MẠCH", ""], ["2", "01.02", "Điện tim", ""], ["", "", "II. Ngoại khoa", ""], ["3", "02.01", "Cắt <ruột> & nối", ""]]
    write_rows(path, sheet)
    assert [c for _, c in read_rows(path)] == sheet
    spark.dataSource.register(XlsxSource)
    raw = spark.read.format("xlsx_rows").load(path)
    spec = I.inspect(raw)
    assert (spec.header_row, spec.name_col, spec.code_col, spec.ordinal_col) == (1, 2, 1, 0)
    got = [(r.code, r.ordinal, r.chapter) for r in I.catalog(raw, spec, DEFAULT).orderBy("idx").collect()]
    assert got == [("01.01", "1", "I. Nội khoa"), ("01.02", "2", "I. Nội khoa > TIM MẠCH"), ("02.01", "3", "II. Ngoại khoa")]


def test_stream(spark, tmp_path):
    src, tgt = tables(spark, n=20)
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    link_stream(stream, tgt, str(tmp_path / "out"), str(tmp_path / "check"), once=True).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out")).drop("batch")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, M.link(src, tgt).collect()))


def test_lite_profile(spark):
    src = spark.createDataFrame([(1, "Cắt gan"), (2, "Khâu rách âm hộ"), (3, "zzz")], "q long, name string")
    tgt = spark.createDataFrame([(1, "A", "cắt-gan"), (2, "B", "Cắt gan"), (3, "C", "Khâu rách bờ mi")], "idx long, code string, name string")
    assert {r.q: r.match_code for r in M.link_lite(src, tgt, DEFAULT).collect()} == {1: "A", 2: "", 3: ""}


def test_samples_and_export(spark, tmp_path):
    from recordloom.sources import samples, xlsx

    paths = samples.write_workbooks(str(tmp_path))
    spark.dataSource.register(XlsxSource)
    raw = spark.read.format("xlsx_rows").load(paths["source"])
    names = [r.name for r in I.catalog(raw, I.inspect(raw), DEFAULT).orderBy("idx").collect()]
    assert names == [n for _, c, n in samples.SOURCE if c]
    xlsx.export(samples.sources(spark).orderBy("q"), str(tmp_path / "out.xlsx"))
    assert [c[2] for _, c in xlsx.read_rows(str(tmp_path / "out.xlsx"))][1:] == names


def test_columns_are_told_apart():
    assert not I.is_ordinal_header("TT 43") and I.ordinal_column(["STT", "TT 43", "Tên"], [["1", "5", "a"]], 2, -1) == 0
    assert I.ordinal_column(["STT", "STT cột 2", "Tên"], [["1", "", "a"]], 2, -1) == 1
    assert I.ordinal_column(["STT", "STT cột b", "Tên"], [["1", "2", "a"]], 2, -1) == 0
    assert I.specialty_column(["Tên", "Chuyên khoa"]) == 1 and I.specialty_column(["Nhóm tên"]) == -1 and not I.is_ordinal_header("Mã TT 43")


def test_dismiss_pick_and_import(spark, tmp_path):
    rows = spark.createDataFrame([(1, True, "HIGH", "rules"), (2, True, "LOW", "rules")], "row_id long, warning boolean, severity string, audited_by string")
    assert [tuple(r) for r in R.dismiss_warning(rows, rows.filter("row_id = 1").select("row_id")).orderBy("row_id").collect()] == [(1, False, "SAFE", "user_reviewed"), (2, True, "LOW", "rules")]
    items = spark.createDataFrame([(i, f"C{i}", f"name {i}") for i in range(80)], "idx long, code string, name string")
    assert (R.picker(items, " NAME ").count(), R.picker(items, "").count(), R.picker(items, "c7").count()) == (50, 30, 11)
    (tmp_path / "s.json").write_text('{"results": [{"row_id": 1}]}')
    (tmp_path / "bad.json").write_text('{"other": 1}')
    assert R.load_json(spark, str(tmp_path / "s.json"), "struct<row_id: long>").first().row_id == 1
    with pytest.raises(ValueError):
        R.load_json(spark, str(tmp_path / "bad.json"), "struct<row_id: long>")


def test_kinds_of_sheets(spark):
    pl1 = [["Title"], [], [""], ["Stt (cột 1)", "Mã kỹ thuật (cột 2)", "Phân loại (cột 3)", "Tên kỹ thuật (cột 4)"], ["I", "", "", "A. Nội khoa"], ["1", "23.PL1.1", "Loại 1", "Siêu âm tim"], ["2", "23.PL1.2", "Loại 2", "Điện tim"], ["3", "", "", ""]]
    sheet = spark.createDataFrame(list(enumerate(pl1)), "row_no long, cells array<string>")
    spec = I.inspect(sheet, I.FIRST)
    assert (spec.header_row, spec.name_col, spec.code_col, spec.ordinal_col, spec.specialty_col) == (3, 3, 1, 0, -1)
    got = I.catalog(sheet, spec, DEFAULT, target=True).orderBy("idx").collect()
    assert [(r.id, r.code, r.name, r.chapter) for r in got] == [(1, "23.PL1.1", "Siêu âm tim", "A. Nội khoa"), (2, "23.PL1.2", "Điện tim", "A. Nội khoa")]
    with pytest.raises(ValueError):
        I.catalog(sheet.filter("row_no < 5"), spec, DEFAULT, target=True)
    assert I.header_by_keyword(pl1, ["no such"], 1) == 3 and I.header_by_keyword([["a"]], ["b"], 3) == 0
    assert I.header_by_clean_text(pl1, ["tên kỹ thuật"]) == 3 and I.header_by_clean_text(pl1, ["zz"]) == 1
    assert I.header_by_clean_text([["x"], ["Mã (kỹ-thuật)"]], ["kỹ thuật"], 0) == 1


def test_close_matches_are_difflibs(spark):
    rnd = random.Random(3)
    words = ["gan", "tim", "phoi", "ruot", "cat", "noi", "soi"]
    names = lambda n: [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 4))) for _ in range(n)]
    src, tgt = names(60), names(60)
    got = {r.q: (r.match_name, r.match_score) for r in M.close_match(spark.createDataFrame(list(enumerate(src)), "q long, name string"), spark.createDataFrame([(i, f"C{i}", n) for i, n in enumerate(tgt)], "idx long, code string, name string"), 0.6).collect()}
    for i, name in enumerate(src):
        if name in tgt:
            want = (name, 100.0)
        else:
            found = difflib.get_close_matches(name, list(dict.fromkeys(tgt)), n=1, cutoff=0.6)
            ratio = difflib.SequenceMatcher(None, name, found[0]).ratio() if found else 0
            want = (found[0], round(ratio * 100, 1)) if ratio >= 0.6 else ("", 0.0)
        assert got[i] == want


def test_sessions_go_out_and_in(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", True), (2, "b", None)], "row_id long, name string, is_locked boolean")
    R.export_json(rows, str(tmp_path / "s"), {"threshold": 0.8})
    back = R.load_json(spark, str(tmp_path / "s"), "struct<row_id: bigint, name: string, is_locked: boolean>")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    with pytest.raises(ValueError):
        R.export_json(rows.limit(0), str(tmp_path / "none"))
    assert R.restored({"threshold": 0.7, "filter": True}, {"threshold": 0, "filter": False, "x": None}) == {"threshold": 0.7, "filter": False}
    one, two = R.snapshot(rows, str(tmp_path / "store")), R.snapshot(rows.limit(1), str(tmp_path / "store"))
    assert one != two and R.load_session(spark, str(tmp_path / "store"), one).count() == 2 and R.load_session(spark, str(tmp_path / "store"), two).count() == 1
    items = spark.createDataFrame([(i,) for i in range(9)], "row_id long")
    assert [r.row_id for r in R.page_after(items, 3, 2).collect()] == [4, 5] and [r.row_id for r in R.page_after(items, None, 2).collect()] == [0, 1]


def test_auditors_are_asked_in_order(spark):
    rows = spark.createDataFrame([(i, "x") for i in range(5)], "row_id long, name string")

    def fails(pdf):
        raise OSError("busy")

    got = A.external_audit(rows, [fails, lambda pdf: pdf.assign(audit="second")[["row_id", "audit"]]], "row_id long, audit string", chunk=2, wait=0.01)
    assert {r.audit for r in got.collect()} == {"second"} and got.count() == 5
    merged = A.merge_verdicts(rows.withColumn("audit", F.lit("rules")), got.filter("row_id < 2"))
    assert {(r.row_id < 2, r.audit, r.audited_by) for r in merged.collect()} == {(True, "second", "service"), (False, "rules", "rules")}
    with pytest.raises(ValueError):
        A.require_items(rows.limit(0))


def test_semantic_rules_come_first(spark):
    rows = spark.createDataFrame([(1, "Đặt ống thông bàng quang", "Định lượng glucose", "", 90.0, 0.0), (2, "Khâu phục hồi rách âm hộ", "Khâu phục hồi bờ mi", "Khâu rách âm hộ", 90.0, 95.0)], "row_id long, name string, name_1 string, name_2 string, score_1 double, score_2 double")
    got = {r.row_id: r.audit for r in V.audit_rows(rows, DEFAULT).collect()}
    assert got[1].details[0].rule == "modality" and got[1].severity == "HIGH" and got[1].flag == "PL1"
    assert got[2].details[0].rule == "anatomy" and got[2].flag == "PL1"
    report = {r.row_id: r.report for r in V.audit_report(V.audit_rows(rows.withColumns({c: F.lit("c") for c in ("code", "code_1", "code_2")}), DEFAULT)).collect()}
    assert "Verdict: serious conflict" in report[1] and "1. MISMATCH_INTERVENTION (HIGH)" in report[1]


def test_extra_columns_of_a_layout():
    cols = L.add_extra(L.add_extra(L.EXPORT, "One"), "Two")
    assert [c["title"] for c in L.rename_extra(cols, "extra_1", "New")][-2:] == ["New", "Two"] and L.rename_extra(cols, "name", "x") == cols
    left = L.remove_extra(cols, "extra_1")
    assert [c["order"] for c in left] == [*range(1, 12)] and left[-1]["id"] == "extra_2" and len(L.remove_extra(cols, "name")) == len(cols)


def test_blocks_of_sparse_numbers(spark):
    rnd = random.Random(6)
    numbers = sorted(rnd.sample(range(10**9), 500))
    rows = spark.createDataFrame([(n, n % 3 == 0) for n in numbers], "row_no long, flag boolean").repartition(6)
    got = {r.row_no: r.ordinal for r in C.running_count(rows, F.col("flag"), block=40).collect()}
    count = 0
    for n in numbers:
        count += n % 3 == 0
        assert got[n] == count
    assert C._blocked(rows, "row_no", 40).groupBy("__block").count().agg(F.max("count")).first()[0] < 80
