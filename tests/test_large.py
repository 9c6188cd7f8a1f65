"""What only larger tables bring up: ties over many files, repeated names, long texts."""

import random

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from recordloom import queries as Q
from recordloom.operators import match as M
from recordloom.operators import results as R
from recordloom.operators import review as V
from recordloom.vocab import DEFAULT


def test_edits_with_one_number_are_told_apart_by_their_place_in_the_table(spark, tmp_path):
    """Spark reads the largest files first, so the first line of an order isn't the first one that it meets."""
    folder = tmp_path / "lineitem.parquet"
    folder.mkdir()
    con = duckdb.connect(config={"threads": 1})
    lines = "SELECT (i * 7 % 50)::BIGINT AS l_orderkey, (i % 3)::INTEGER AS l_linenumber, '{0}' || i AS l_returnflag, TIMESTAMP '1995-01-01' AS l_shipdate FROM range({1}) r(i)"
    for k, n in enumerate((40, 400, 90, 4000)):
        con.sql(f"COPY ({lines.format('abcd'[k], n)}) TO '{folder}/part-{k}.parquet'")
    con.sql(f"COPY (SELECT i AS o_orderkey, 'O' AS o_orderstatus, 'P' AS o_orderpriority FROM range(60) r(i)) TO '{tmp_path}/orders.parquet'")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    con.sql(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    got = sorted(tuple(r) for r in entry.queries()["edit_log_resolve"](spark, str(tmp_path)).collect())
    assert got == sorted(con.sql(entry.oracle_sql()["edit_log_resolve"]).fetchall())


def test_audit_with_a_vocabulary_takes_each_name_apart_once(spark, monkeypatch):
    tube, care = "Đặt ống thông bàng quang", "Khâu phục hồi rách âm hộ"
    base = [
        (tube, "Định lượng glucose", "", 90.0, 0.0, ["modality", "anatomy"], "HIGH", "PL1"),
        (care, "Khâu phục hồi bờ mi", care, 90.0, 95.0, ["anatomy"], "HIGH", "PL1"),
        (care, care.upper(), "Khâu phục hồi bờ mi", 100.0, 60.0, ["anatomy"], "HIGH", "PL2"),
        (tube, None, "Đặt ống thông bàng quang lần 2", 0.0, 50.0, [], "LOW", "PL2"),
        (None, "Siêu âm tim", "", 50.0, 0.0, [], "SAFE", "NONE"),
    ]
    rows = spark.createDataFrame([(i, *base[i % 5][:5]) for i in range(500)], "row_id long, name string, name_1 string, name_2 string, score_1 double, score_2 double")
    taken, decompose = [], V.D.decompose
    monkeypatch.setattr(V.D, "decompose", lambda df, *rest: taken.append(df.count()) or decompose(df, *rest))
    got = V.audit_rows(rows, DEFAULT).collect()
    assert sum(taken) <= 7 and sorted(r.row_id for r in got) == list(range(500))
    for r in got:
        *row, rules, severity, flag = base[r.row_id % 5]
        assert list(r[1:6]) == row and [d.rule for d in r.audit.details] == rules and (r.audit.severity, r.audit.flag) == (severity, flag)


TARGETS = [(10, "a", "Khâu vết rách bờ mi hai bên"), (11, "b", "Phẫu thuật cắt gan"), (12, "c", "Phẫu thuật cắt gan"), (13, "d", "Xét nghiệm máu nhiều lần")]
ASKED = {"Khâu vết rách bờ mi một bên": "a", "phẫu thuật, cắt gan": "b", "Xét nghiệm máu lần": "d", "***": ""}


def _repeated(spark, times=100):
    """Few names, many sources."""
    return spark.createDataFrame([(i, list(ASKED)[i % 4]) for i in range(4 * times)], "q long, name string"), spark.createDataFrame(TARGETS, "idx long, code string, name string")


def test_light_links_meet_each_name_once(spark, monkeypatch):
    asked, taken, candidates, decompose = [], [], M.candidates, M.D.decompose
    monkeypatch.setattr(M, "candidates", lambda sources, *rest, **named: asked.append(sources.count()) or candidates(sources, *rest, **named))
    monkeypatch.setattr(M.D, "decompose", lambda df, *rest: taken.append(df.count()) or decompose(df, *rest))
    got = M.link_lite(*_repeated(spark), DEFAULT, 0.5).collect()
    assert sum(asked) <= 3 and sum(taken) <= 7 and len(got) == 400
    assert {(r.name, r.match_code) for r in got} == set(ASKED.items())


def test_rows_of_large_links_are_not_broadcast(spark, monkeypatch):
    want = {tuple(r) for r in M.link(*_repeated(spark), DEFAULT, 0.5).collect()}
    monkeypatch.setattr(M, "MANY", 3)
    for made in (M.link, M.link_lite):
        found = made(*_repeated(spark), DEFAULT, 0.5)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("strategy=merge") >= 3
        if made is M.link:
            assert {tuple(r) for r in found.collect()} == want


def test_facets_keep_no_copies_of_the_texts(spark, monkeypatch):
    """Entries are found where the texts are; those beyond a number are met under ids, with the same counts."""
    rnd, letters = random.Random(4), ["aba", "bab", "ab", "cab cab", "a", "đa", "b-c", "cabab", ""]
    text = lambda most: " ".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
    labels = [(rnd.choice([None, "", "-", text(2)]), rnd.choice([None, text(12)])) for _ in range(300)]
    names = sorted({text(4) for _ in range(60)} | {"ABA, cab", "aba cab", "-", "cab cab zzz", "zzz zzz"})
    rows, entries = spark.createDataFrame(labels, "specialty string, anatomy string"), spark.createDataFrame([(n,) for n in names], "entry string")
    told = {n: rows.filter(R.specialty_matches(F.col("specialty"), F.col("anatomy"), F.lit(n), True)).count() for n in names[::6] + names[-3:]}
    kept, keep = [], R.Steps.keep
    monkeypatch.setattr(R.Steps, "keep", lambda self, df: kept.append(df.columns) or keep(self, df))
    once = {r.entry: r.n for r in R.facet_ontology(rows, entries).collect()}
    assert kept == [["entry", "w"]]
    assert once == {r.entry: r.n for r in R.facet_ontology(rows, entries, most=0).collect()}
    assert {n: once.get(n, 0) for n in told} == told and len(once) > 20


def test_procedures_are_sized_in_one_pass(spark, sf_dir):
    """The sizes of all parts were a broadcast table that grows with them."""
    for half in Q._procedure_halves(spark, sf_dir):
        assert "Join" not in half._jdf.queryExecution().optimizedPlan().toString()
